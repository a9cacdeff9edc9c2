"""Language of every word by a linear-chain CRF, and of a document by its words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceframe.llm.common import by_value, loaded, prepare
from raceframe.llm.textblocks import LOWER, mix, pieces, span_hashes, text_bytes, word_spans

UNDETERMINED = "und"
# Slots of the weight table; affixes, n-grams and whole words (the lexicon) share it by hash.
SLOTS = 1 << 17
AFFIX = 4
PIECE = 1 << 20
# Words per segment of a chain.
SEGMENT = 32
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3:] = True
# The letters among the code points below 0xC0, by their second byte: ª, µ and º.
LOW_LETTERS = np.array([0xAA, 0xB5, 0xBA], dtype=np.uint8)


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are or begin letters; signs from U+00C0 on count too, as bytes cannot tell them."""
    found = LETTER[data]
    found[:-1] |= (data[:-1] == 0xC2) & np.isin(data[1:], LOW_LETTERS)
    return found


@dataclass(frozen=True)
class Model:
    """Labels, a weight per (slot, label) and per (label, next label)."""

    labels: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x51_7CC1B727220A95 % 2**64)) >> np.uint64(47)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the word features: one array per affix and lexicon feature, and the trigrams.

    Trigrams come as one slot per byte of the words and the place where each word begins.
    Words are taken with a marker on both sides; -1 stands for a feature a word lacks.
    """
    length = ends - starts
    pad = np.concatenate((data, np.zeros(AFFIX, dtype=np.uint8))).astype(np.uint64)
    single = [_slot(span_hashes(data, starts, ends), 1)]
    head = np.zeros(len(starts), dtype=np.uint64)
    tail = np.zeros(len(starts), dtype=np.uint64)
    for k in range(AFFIX):
        head = head * np.uint64(257) + pad[starts + k] + np.uint64(1)
        tail = tail * np.uint64(257) + pad[np.maximum(ends - 1 - k, 0)] + np.uint64(1)
        longer = length > k
        single.append(np.where(longer, _slot(head, 10 + k), -1))
        single.append(np.where(longer, _slot(tail, 20 + k), -1))
    # Bytes of all words one after another, with the bytes beside them.
    first = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], length)
    inner_left = at > np.repeat(starts, length)
    inner_right = at + 1 < np.repeat(ends, length)
    left = np.where(inner_left, pad[at - 1], np.uint64(256))
    right = np.where(inner_right, pad[at + 1], np.uint64(256))
    return single, _slot((left * np.uint64(257) + pad[at]) * np.uint64(257) + right, 40), first[:-1]


def emissions(model_weights: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, labels) scores."""
    if len(starts) == 0:
        return np.zeros((0, model_weights.shape[1]), dtype=np.float32)
    single, grams, first = features(data, starts, ends)
    out = np.add.reduceat(model_weights[grams], first, axis=0)
    for slots in single:
        out += np.where((slots >= 0)[:, None], model_weights[slots], 0)
    return out


def _segments(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains cut into segments: word per (segment, step) or -1, chain and number in the chain."""
    chains, first, count = np.unique(rows, return_index=True, return_counts=True)
    per = -(-count // size)
    chain = np.repeat(np.arange(len(chains)), per)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    base = first[chain] + number * size
    word = base[:, None] + np.arange(size)[None, :]
    return np.where(word < (first + count)[chain][:, None], word, -1), chain, number


def posteriors(scores: np.ndarray, moves: np.ndarray, rows: np.ndarray, size: int = SEGMENT) -> np.ndarray:
    """(words, labels) probabilities by forward-backward over every chain of words.

    ``rows`` gives each word's chain, in order.  All segments advance at once: their
    transfer matrices first, then the states between segments, then the words inside.
    """
    n, labels = scores.shape
    if n == 0:
        return scores.astype(np.float64)
    weight = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
    step = np.exp(moves - moves.max())
    words, chain, number = _segments(rows, size)
    live = words >= 0
    e = np.where(live[:, :, None], weight[words], 1.0)
    total = np.broadcast_to(np.eye(labels), (len(words), labels, labels)).copy()
    for t in range(size):
        on = live[:, t]
        moved = (total[on] @ step) * e[on, t][:, None, :]
        total[on] = moved / moved.max(axis=(1, 2), keepdims=True)
    start = np.ones((len(words), labels))
    stop = np.ones((len(words), labels))
    last = np.append(chain[1:] != chain[:-1], True)
    for k in range(1, int(number.max()) + 1):
        at = np.flatnonzero(number == k)
        moved = np.einsum("ij,ijk->ik", start[at - 1], total[at - 1])
        start[at] = moved / moved.max(axis=1, keepdims=True)
    for k in range(int(number.max()) - 1, -1, -1):
        at = np.flatnonzero((number == k) & ~last)
        moved = np.einsum("ijk,ik->ij", total[at + 1], stop[at + 1])
        stop[at] = moved / moved.max(axis=1, keepdims=True)
    forward = np.empty((len(words), size, labels))
    state = start
    for t in range(size):
        on = live[:, t][:, None]
        moved = (state @ step) * e[:, t]
        state = np.where(on, moved / moved.max(axis=1, keepdims=True), state)
        forward[:, t] = state
    out = np.empty((n, labels))
    state = stop
    for t in range(size - 1, -1, -1):
        on = live[:, t]
        out[words[on, t]] = forward[on, t] * state[on]
        moved = (state * e[:, t]) @ step.T
        state = np.where(on[:, None], moved / moved.max(axis=1, keepdims=True), state)
    return out / out.sum(axis=1, keepdims=True)


def fit(texts: Sequence[str], langs: Sequence[str], *, seed: int = 1, chains: int = 640, length: int = SEGMENT, run: float = 16.0, rounds: int = 4, rate: float = 0.2) -> Model:
    """Train on code-switched chains: runs of words from labelled texts of changing languages.

    Maximises the chains' log-likelihood by AdaGrad; the gradient is observed minus
    expected counts, the latter by forward-backward.
    """
    labels = tuple(sorted(set(langs)))
    data, offsets = text_bytes(pa.array(list(texts), pa.large_string()))
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    weights = np.zeros((SLOTS, len(labels)), dtype=np.float32)
    moves = np.zeros((len(labels), len(labels)))
    of = np.array([labels.index(x) for x in langs])[rows] if len(rows) else np.zeros(0, dtype=np.int64)
    by_label = [np.flatnonzero(of == k) for k in range(len(labels))]
    usable = [k for k in range(len(labels)) if len(by_label[k])]
    if len(usable) < 2:
        return Model(labels, weights, moves)
    rng = np.random.default_rng(seed)
    picked = []
    for _ in range(chains):
        chain: list[int] = []
        while len(chain) < length:
            own = by_label[usable[int(rng.integers(len(usable)))]]
            at = int(rng.integers(len(own)))
            chain += own[at : at + 1 + int(rng.geometric(1 / run))].tolist()
        picked.append(chain[:length])
    picked = np.array(picked)
    grown, grown_moves = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(rounds):
        for group in np.array_split(rng.permutation(chains), max(1, chains // 32)):
            word = picked[group].ravel()
            y = of[word]
            single, grams, first = features(data, starts[word], ends[word])
            scores = np.add.reduceat(weights[grams], first, axis=0)
            for slots in single:
                scores += np.where((slots >= 0)[:, None], weights[slots], 0)
            chain_of = np.repeat(np.arange(len(group)), length)
            p, pairs = _expected(scores, moves, len(group), length)
            miss = -p
            miss[np.arange(len(word)), y] += 1
            gradient = np.zeros_like(weights)
            np.add.at(gradient, grams, np.repeat(miss, np.diff(np.append(first, len(grams))), axis=0).astype(np.float32))
            for slots in single:
                np.add.at(gradient, slots[slots >= 0], miss[slots >= 0].astype(np.float32))
            observed = np.zeros_like(moves)
            inside = chain_of[1:] == chain_of[:-1]
            np.add.at(observed, (y[:-1][inside], y[1:][inside]), 1)
            touched = np.flatnonzero(gradient.any(axis=1))
            grown[touched] += gradient[touched] ** 2
            weights[touched] += rate * gradient[touched] / np.sqrt(grown[touched])
            change = observed - pairs
            grown_moves += change**2
            moves += rate * change / np.sqrt(grown_moves)
    return Model(labels, weights, moves)


def _expected(scores: np.ndarray, moves: np.ndarray, chains: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors and expected transition counts of chains of one length."""
    p = posteriors(scores, moves, np.repeat(np.arange(chains), length), length)
    labels = scores.shape[1]
    weight = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64)).reshape(chains, length, labels)
    step = np.exp(moves - moves.max())
    forward = np.empty_like(weight)
    state = np.ones((chains, labels))
    for t in range(length):
        state = (state @ step) * weight[:, t]
        state /= state.max(axis=1, keepdims=True)
        forward[:, t] = state
    pairs = np.zeros((labels, labels))
    state = np.ones((chains, labels))
    for t in range(length - 1, 0, -1):
        back = state * weight[:, t]
        both = forward[:, t - 1][:, :, None] * step[None] * back[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        state = back @ step.T
        state /= state.max(axis=1, keepdims=True)
    return p, pairs


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and mean posterior per label of every text of a column."""
    data, offsets = text_bytes(column)
    lettered = letter_bytes(data)
    letters = np.concatenate(([0], np.cumsum(lettered)))
    worded = letters[offsets[1:]] > letters[offsets[:-1]]
    # Bytes above ASCII may be signs rather than letters: texts without an ASCII letter are looked at again.
    ascii_letters = np.concatenate(([0], np.cumsum(lettered & (data < 128))))
    for i in np.flatnonzero(worded & (ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]])):
        worded[i] = any(c.isalpha() for c in column[int(i)].as_py())
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    kept = letters[ends] > letters[starts]
    starts, ends, rows = starts[kept], ends[kept], rows[kept]
    p = posteriors(emissions(model.weights, data, starts, ends), model.moves, rows)
    n = len(offsets) - 1
    share = np.zeros((n, len(model.labels)))
    if len(rows):
        which, first, count = np.unique(rows, return_index=True, return_counts=True)
        share[which] = np.add.reduceat(p, first, axis=0) / count[:, None]
    best = share.argmax(axis=1)
    known = worded & (share.sum(axis=1) > 0)
    return [model.labels[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, np.clip(share[np.arange(n), best], 0, 1), 0.0), share


def training_rows(docs: DataFrame, *, id: str, text: str, lang: str, held_out, per_lang: int, sample_chars: int) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` labelled documents of each language, the first in hash order."""
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = docs.filter(F.col(lang).isNotNull() & F.col(id).isNotNull() & F.col(text).isNotNull() & ~held_out).select(
        F.col(id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(id).alias("h"))
    chosen = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).distinct()
    rows = docs.join(F.broadcast(chosen), (F.col(id) == F.col("__id")) & (F.col(lang) == F.col("__lang"))).select("__lang", F.substring(text, 1, sample_chars).alias("t"), "__id")
    rows = sorted({(r[2], r[0], r[1]) for r in rows.collect()})
    return [r[2] for r in rows], [r[1] for r in rows]


def identify(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 150, sample_chars: int = 4000,
) -> DataFrame:
    """(id, held_out, lang_pred, score, shares): the language of every whole text.

    The model is trained on documents with a language whose crc32 of the id modulo 4 is
    not 2 (``held_out`` marks those): at most ``per_lang`` documents per language and the
    first ``sample_chars`` characters of each; predictions read the text alone, all of it.
    ``shares`` maps each learned language to the mean posterior of the words; the largest
    is the prediction and its score.  Null texts and texts without a letter are ``und``
    with score 0, and so is everything if nothing is labelled.  A null id is not held out
    and not learned from; every row gets a row.
    """
    spark = prepare(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    texts, langs = training_rows(docs, id=id, text=text, lang=lang, held_out=held, per_lang=per_lang, sample_chars=sample_chars)
    model = by_value(spark, fit(texts, langs) if texts else None)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                column = piece.column(2)
                if m is None:
                    names, score, share = [UNDETERMINED] * len(column), np.zeros(len(column)), [[]] * len(column)
                    shares = pa.array(share, pa.map_(pa.string(), pa.float64()))
                else:
                    names, score, share = predict(m, column)
                    shares = pa.array([list(zip(m.labels, row)) for row in share.tolist()], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), shares], ["id", "held_out", "lang_pred", "score", "shares"])

    kind = dict(docs.dtypes)[id]
    rows = docs.select(F.col(id).alias("id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(compute, f"id {kind}, held_out boolean, lang_pred string, score double, shares map<string,double>").withColumnRenamed("id", id)


def keep_identified(docs: DataFrame, *, id: str = "doc_id", least: float = 0.35, **options) -> DataFrame:
    """The documents with a language, all columns kept: not ``und`` and a score of ``least`` or more.

    Rows are judged by id; rows that share an id go if any of them is rejected, rows with
    a null id stay.
    """
    found = identify(docs, id=id, **options)
    gone = found.filter((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least)).select(F.col(id).alias("__gone")).distinct()
    return docs.join(gone, F.col(id) == F.col("__gone"), "left_anti")
