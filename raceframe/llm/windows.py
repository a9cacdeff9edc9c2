"""Repeated byte windows by a depth-limited radix sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written
from raceframe.llm.textblocks import BASE, BASE_INVERSE, BYTE_VALUES, mix, pieces, powers, text_bytes

# Bytes of a suffix's first digit. Every window has a sampled suffix whose digit is inside it.
DIGIT = 16
# Text whose suffixes are found at once, whose suffixes are collected before they are dealt
# out, and that a bucket stands for.
PIECE, BATCH, BUCKET = 2 << 20, 16 << 20, 8 << 20
PLACE_BITS = 24
# Kinds of what is said about a window range of a document.
REPEAT, OPEN = 0, 1


def pack(columns: dict[str, np.ndarray | pa.Array]) -> bytes:
    """Columns as one compressed block of bytes."""
    table = pa.table({c: columns[c] for c in sorted(columns)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blocks: pd.Series) -> pa.Table | None:
    """All blocks of a column under each other."""
    tables = [pa.ipc.open_stream(b).read_all() for b in blocks]
    return pa.concat_tables(tables) if tables else None


def columns_of(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in table.column_names}


def rolling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given byte ranges."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def sampled(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray] | None:
    """The sampled suffixes of some texts, each with the run of windows it stands for.

    The suffix of a window is the one whose first ``DIGIT`` bytes hash lowest (leftmost of
    equals) among those that start in it and whose digit ends in it, so equal windows have
    equal suffixes at equal places.  ``low`` is the first window, ``n`` how many follow on,
    ``off`` the way to the suffix, ``digit`` its first digit and ``rest`` the hash of
    everything the windows cover.
    """
    n, reach = len(data), window - DIGIT + 1
    if n < window:
        return None
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
    inverse = powers(BASE_INVERSE, n + 1)
    digit = mix((sums[DIGIT:] - sums[:-DIGIT]) * inverse[: n - DIGIT + 1])
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    order = (digit & ~low_bits) | np.arange(len(digit), dtype=np.uint64)
    # Least value of every ``reach`` neighbours: running minima of blocks from either side.
    blocks = np.concatenate((order, np.full(-len(order) % reach, ~np.uint64(0)))).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    least = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
    del order, blocks, ahead, behind
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    inside = np.arange(count) + window <= offsets[1:][row]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return None
    at = (least[starts] & low_bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    low, high = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    at = at[first]
    rest = mix((sums[high + window] - sums[low]) * inverse[low] + (high - low + window).astype(np.uint64))
    return {"digit": digit[at], "rest": mix(rest + (at - low).astype(np.uint64)), "row": row[low], "low": low - offsets[row[low]], "n": (high - low + 1).astype(np.uint8), "off": (at - low).astype(np.uint8)}


def _slices(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, offsets, number of the first row and bytes before it; a very long row comes in overlapping parts."""
    at = 0
    for piece in pieces(batch, "text", PIECE):
        data, offsets = text_bytes(piece.column("text"))
        if len(data) <= 2 * PIECE:
            yield data, offsets, at, 0
        else:
            for k in range(0, len(data) - window + 1, PIECE):
                part = data[k : k + PIECE + window - 1]
                yield part, np.array([0, len(part)]), at, k
        at += piece.num_rows


def _texthash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint64).view(np.int64)


def _by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(edges, np.append(edges[1:], len(bucket)) if len(bucket) else []):
        yield int(bucket[a]), {c: v[order[a:b]] for c, v in columns.items()}


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts, for arrays sorted together."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _told(found: dict[str, np.ndarray], keep: np.ndarray, kind: int) -> dict[str, np.ndarray]:
    out = {c: found[c][keep] for c in ("doc", "text", "low", "n", "off")}
    out["kind"] = np.full(len(out["doc"]), kind, dtype=np.uint8)
    return out


def settle(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Over entries of suffixes: which repeat a smaller document's whole entry, and which are open.

    Of equal entries those of the smallest document stand for all.  Where suffixes with one
    first digit differ further on, the entries that stand are open: some of their windows
    may still be equal.
    """
    order = np.lexsort((found["doc"], found["rest"], found["digit"]))
    digit, rest, doc = found["digit"][order], found["rest"][order], found["doc"][order]
    new_digit, new_rest = _groups(digit), _groups(digit, rest)
    least = doc[new_rest][np.cumsum(new_rest) - 1]
    group = np.cumsum(new_digit) - 1
    firsts = np.flatnonzero(new_digit)
    several = (np.minimum.reduceat(doc, firsts) != np.maximum.reduceat(doc, firsts)) & (np.add.reduceat(new_rest, firsts) > 1)
    repeat, open_ = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    repeat[order] = doc > least
    open_[order] = several[group] & (doc == least)
    return repeat, open_


def _emit(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])


def _first_digits(window: int, buckets: int):
    """Map: sample suffixes, settle what one batch can, deal the rest by first digit."""

    def flush(found: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        every = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        # Repeats inside the batch are settled here: a common passage sends one entry per batch.
        repeat, _ = settle(every)
        told = _told(every, repeat, REPEAT)
        for bucket, part in _by_bucket(_doc_bucket(told["doc"], buckets), told):
            none = np.zeros(len(part["doc"]), dtype=np.uint64)
            yield _emit([(bucket, pack(part | {"digit": none, "rest": none}))])
        rest = {c: v[~repeat] for c, v in every.items()}
        rest["kind"] = np.full(len(rest["doc"]), OPEN, dtype=np.uint8)
        for bucket, part in _by_bucket((rest["digit"] % np.uint64(buckets)).astype(np.int64), rest):
            yield _emit([(bucket, pack(part))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for data, offsets, at, before in _slices(batch, window):
                held += len(data)
                part = sampled(data, offsets, window)
                if part is not None:
                    row = part.pop("row")
                    if before or len(data) > 2 * PIECE or len(offsets) == 2:
                        whole, edges = text_bytes(batch.column("text").slice(at, 1))
                        texts = _texthash(whole, edges)
                    else:
                        texts = _texthash(data, offsets)
                    part["low"] = (part["low"] + before).astype(np.int64)
                    found.append(part | {"doc": ids[at + row], "text": texts[row]})
                if held >= BATCH and found:
                    yield from flush(found)
                    found, held = [], 0
        if found:
            yield from flush(found)

    return compute


def _settle_bucket(buckets: int):
    """Reduce by first digit: (document bucket, ranges that repeat or are open)."""

    def compute(pdf: pd.DataFrame) -> pd.DataFrame:
        every = columns_of(unpack(pdf["block"]))
        done = every["kind"] == REPEAT
        out = []
        passed = _told(every, done, REPEAT)
        rest = {c: v[~done] for c, v in every.items()}
        parts = [passed]
        if len(rest["doc"]):
            repeat, open_ = settle(rest)
            parts += [_told(rest, repeat, REPEAT), _told(rest, open_, OPEN)]
        told = {c: np.concatenate([p[c] for p in parts]) for c in passed}
        for bucket, part in _by_bucket(_doc_bucket(told["doc"], buckets), told):
            order = np.lexsort((part["low"], part["text"], part["doc"]))
            out.append((bucket, pack({c: v[order] for c, v in part.items()})))
        return pd.DataFrame(out, columns=["bucket", "block"])

    return compute


def _packed_docs(buckets: int):
    """Map: documents dealt by id, many in one compressed block."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        doc, text = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        body = pa.concat_arrays([h[2] for h in held])
        for bucket, part in _by_bucket(_doc_bucket(doc, buckets), {"at": np.arange(len(doc))}):
            at = part["at"]
            yield _emit([(bucket, pack({"doc": doc[at], "text": text[at], "body": body.take(pa.array(at))}))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column("text").cast(pa.large_string()).fill_null("")
            data, offsets = text_bytes(column)
            held.append((batch.column("id").to_numpy(), _texthash(data, offsets), column.cast(pa.large_binary())))
            size += len(data)
            if size >= BATCH:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return compute


def _open_ranges(window: int, buckets: int):
    """Cogroup by document: the text of every open range, dealt by a longer digit.

    The windows of a range are parted in those that reach far to the right of the suffix
    and those that reach far to the left; either kind shares a longer string, whose hash
    deals them, so that a frequent first digit alone gathers nothing.
    """
    right = (window - DIGIT) // 2

    def compute(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        table = unpack(told["block"]) if len(told) else None
        if table is None or not len(docs):
            return pd.DataFrame({"bucket": pd.Series(dtype="int64"), "block": pd.Series(dtype=object)})
        told = columns_of(table)
        keep = told["kind"] == OPEN
        told = {c: v[keep] for c, v in told.items()}
        body = unpack(docs["block"])
        names = pd.MultiIndex.from_arrays([body.column("doc").to_numpy(), body.column("text").to_numpy()])
        names = pd.Series(np.arange(len(names)), index=names)
        where = names[~names.index.duplicated()].reindex(pd.MultiIndex.from_arrays([told["doc"], told["text"]])).to_numpy().astype(np.int64)
        data, offsets = _bytes_of(body.column("body"))
        out: dict[str, list[np.ndarray]] = {"doc": [], "text": [], "low": [], "start": [], "size": [], "core": []}
        last = told["low"] + told["n"].astype(np.int64) - 1
        suffix = told["low"] + told["off"]
        for core_from, core_to, low, high in (
            (suffix, suffix + window - right, np.maximum(told["low"], suffix - right), last),
            (suffix - right - 1, suffix + DIGIT, told["low"], np.minimum(last, suffix - right - 1)),
        ):
            some = np.flatnonzero(low <= high)
            base = offsets[where[some]]
            out["core"].append(rolling(data, base + core_from[some], base + core_to[some]))
            out["doc"].append(told["doc"][some])
            out["text"].append(told["text"][some])
            out["low"].append(low[some])
            out["start"].append(base + low[some])
            out["size"].append((high - low)[some] + window)
        every = {c: np.concatenate(v) for c, v in out.items()}
        rows = []
        for bucket, part in _by_bucket((every["core"] % np.uint64(buckets)).astype(np.int64), every):
            size = part["size"]
            first = np.concatenate(([0], np.cumsum(size)))
            at = np.arange(first[-1]) + np.repeat(part["start"] - first[:-1], size)
            chunk = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data[at].tobytes())])
            rows.append((bucket, pack({"doc": part["doc"], "text": part["text"], "low": part["low"], "chunk": chunk})))
        return pd.DataFrame(rows, columns=["bucket", "block"])

    return compute


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    n = len(whole)
    if n == 0 or whole.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + n + 1]
    return np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _settle_windows(window: int, buckets: int):
    """Reduce by longer digit: windows that a smaller document has, by the last digits of the suffixes."""

    def compute(pdf: pd.DataFrame) -> pd.DataFrame:
        table = unpack(pdf["block"])
        data, offsets = _bytes_of(table.column("chunk"))
        count = np.diff(offsets) - window + 1
        entry = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][entry] + step
        value = rolling(data, start, start + window)
        again = mix(rolling(data, start, start + DIGIT) + np.uint64(1)) ^ rolling(data, start + DIGIT, start + window)
        doc = table.column("doc").to_numpy()[entry]
        order = np.lexsort((doc, again, value))
        new = _groups(value[order], again[order])
        least = doc[order][new][np.cumsum(new) - 1]
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = doc[order] > least
        at = np.flatnonzero(hit)
        if not len(at):
            return pd.DataFrame({"bucket": pd.Series(dtype="int64"), "block": pd.Series(dtype=object)})
        # Neighbouring windows of an entry become one range.
        new = np.concatenate(([True], (entry[at][1:] != entry[at][:-1]) | (at[1:] != at[:-1] + 1)))
        first = at[new]
        length = np.diff(np.append(np.flatnonzero(new), len(at)))
        e = entry[first]
        told = {"doc": doc[first], "text": table.column("text").to_numpy()[e], "low": table.column("low").to_numpy()[e] + step[first], "n": length}
        return pd.DataFrame([(b, pack(p)) for b, p in _by_bucket(_doc_bucket(told["doc"], buckets), told)], columns=["bucket", "block"])

    return compute


def _finish(window: int, with_text: bool):
    """Cogroup by document: what is left of every text."""

    def compute(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if len(told):
            parts = []
            for block in told["block"]:
                t = pa.ipc.open_stream(block).read_all()
                keep = t.column("kind").to_numpy() == REPEAT if "kind" in t.column_names else slice(None)
                parts.append(tuple(t.column(c).to_numpy()[keep].astype(np.int64) for c in ("doc", "text", "low", "n")))
            doc, text, low, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
            order = np.lexsort((text, doc))
            doc, text, low, n = doc[order], text[order], low[order], n[order]
            edges = np.flatnonzero(_groups(doc, text)) if len(doc) else np.zeros(0, dtype=np.int64)
            for a, b in zip(edges, np.append(edges[1:], len(doc))):
                ranges[int(doc[a]), int(text[a])] = low[a:b], low[a:b] + n[a:b] + window - 1
        out = []
        for block in docs["block"]:
            body = pa.ipc.open_stream(block).read_all()
            data, offsets = _bytes_of(body.column("body"))
            for k, (d, t) in enumerate(zip(body.column("doc").to_pylist(), body.column("text").to_pylist())):
                own = data[offsets[k] : offsets[k + 1]]
                removed = spans = 0
                if (d, t) in ranges:
                    depth = np.zeros(len(own) + 1, dtype=np.int64)
                    low, high = ranges[d, t]
                    np.add.at(depth, low, 1)
                    np.add.at(depth, high, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    own = own[~gone]
                kept = own.tobytes()
                out.append((d, int(offsets[k + 1] - offsets[k]), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
        return pd.DataFrame(out, columns=names)

    return compute


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """What stays of every text when repeats of earlier documents go: (id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    Texts are UTF-8 bytes.  A byte goes if a ``window``-byte string that covers it also
    starts in a document with a smaller id; strings are judged on the input.  ``kept`` is
    binary, as a cut may split a character; ``with_text=False`` leaves it out.

    A radix sort, most significant digit first, limited to ``window`` bytes and to sampled
    suffixes (every window has one, the same in equal windows).  The first pass groups
    suffixes by their first ``DIGIT`` bytes: singles are done, whole equal runs of windows
    are repeats.  Only runs that share a digit and differ further on go to the second
    pass, which groups them by a longer digit and then by the whole window.  Digits are
    compared by 64-bit hashes, whole windows by 128 bits.

    Null texts are empty.  Rows without an id keep everything and are no one's repeat;
    rows that share an id are told apart by their text and don't repeat each other.
    Suffixes and texts travel in packed blocks per bucket; buckets follow the bytes of the
    input, and repeats inside a batch are settled before the shuffle.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))
    kind = "bucket long, block binary"
    named = rows.filter("id is not null")
    by_digit = named.mapInArrow(_first_digits(window, buckets), kind).groupBy("bucket").applyInPandas(_settle_bucket(buckets), kind)
    told = written(by_digit, "ranges")
    packed = named.mapInArrow(_packed_docs(buckets), kind)
    chunks = packed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(_open_ranges(window, buckets), kind)
    more = written(chunks.groupBy("bucket").applyInPandas(_settle_windows(window, buckets), kind), "windows")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    done = packed.groupBy("bucket").cogroup(told.unionByName(more).groupBy("bucket")).applyInPandas(_finish(window, with_text), schema)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    zero = F.lit(0).cast("long")
    other = rows.filter("id is null").select(
        F.col("id").alias("doc"), F.length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"),
        *([body.alias("kept")] if with_text else []),
    )
    return done.unionByName(other).withColumnRenamed("doc", id)
