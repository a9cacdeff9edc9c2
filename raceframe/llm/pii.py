"""Personal data: pattern spans, and more spans by a semi-Markov CRF."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceframe.llm.common import by_value, loaded, prepare

KINDS = ("email", "ip", "card", "phone", "secret")
OUTSIDE = 0
# An entity has at most this many tokens.
LONGEST = 14
# Characters of text kept around a trigger.
AROUND = 64

# Base patterns, with possessive runs so that no text takes more than linear time.
# The email pattern starts at the sign; the run before it is added afterwards.
AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]+")
TRIGGER = re.compile(r"[0-9@]")
# The part of an address from a spelled-out sign on, as the look "mail" has it.
SPELLED = re.compile(r"at(?:(?<=[\[(]at)[\])] ?|(?<= at) )[\w-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]++){1,4}")
TOKEN = re.compile(r"[^\W_]+|[^\s]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The pattern spans of a text, leftmost and non-overlapping per kind, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        free = 0
        for m in AFTER_AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m.group())) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Features of whole segments.

CONTEXT = frozenset(
    "mail email e-mail contact call phone tel telephone fax mobile card visa credit iban ip host address server "
    "password passwd pwd token secret key api apikey access pin login user version license page vol no section".split()
)


# What a whole span may look like; a candidate segment fits one of these.
LOOKS = (
    ("mail", re.compile(r"[\w.+-]+(?: ?@ ?| ?[\[(]at[\])] ?| at )[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]+){1,4}")),
    ("quad", re.compile(r"[0-9]{1,3}([.-])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}")),
    ("groups", re.compile(r"[+(]{0,2}[0-9]+(?:[ ().-]{1,2}[0-9]+)*")),
    ("opaque", re.compile(r"(?=[^\W_]*[0-9])(?=[^\W_]*[^\W\d_])[^\W_]{12,}")),
)


def _shape(s: str) -> str:
    kinds = ["9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c for c in s[:60]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)[:16]


def segment_features(s: str, before: str, after: str) -> list[str]:
    """Features of the whole span ``s`` between the tokens ``before`` and ``after``."""
    digits = [c for c in s if c.isdigit()]
    letters = sum(c.isalpha() for c in s)
    spaced = any(c.isspace() for c in s)
    out = ["bias", "shape=" + _shape(s), f"digits={min(len(digits), 20)}", f"length={min(6, len(s) // 6)}", f"ends={_shape(s[0])}{_shape(s[-1])}"]
    out.append(f"mix={letters > 0}{len(digits) > 0}{spaced}")
    out += ["looks=" + name for name, look in LOOKS if look.fullmatch(s)]
    out.append(f"dots={min(4, s.count('.'))}@{min(2, s.count('@'))}")
    if 13 <= len(digits) <= 19 and not letters:
        out.append(f"luhn={luhn(''.join(digits))}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts):
        out.append("octets")
    if not spaced and len(s) >= 12 and letters and digits and s.isalnum():
        counts = [s.count(c) for c in set(s)]
        entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
        out += ["opaque", f"entropy={min(4, int(entropy))}"]
    name = before.lower()
    out.append("before=" + (name if name in CONTEXT else "9" if name.isdigit() else "a" if name.isalpha() else name[:1]))
    out.append("after=" + ("9" if after.isdigit() else "a" if after.isalpha() else after[:1]))
    return out


class Decoder:
    """Weights per (feature, kind) and (kind, next kind), and the dynamic programmes over segments."""

    def __init__(self) -> None:
        self.kinds = len(KINDS) + 1
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((self.kinds, self.kinds))
        self.glued = np.zeros(self.kinds)

    def segments(self, text: str, tokens: list[tuple[int, int]]):
        """(first, last, string features, joined) of every candidate entity.

        A candidate holds a digit, ``@`` or a spelled-out sign, looks like one of ``LOOKS``
        and holds no gap wider than one space.
        """
        spoken = [text[a:b] for a, b in tokens]
        useful = [bool(TRIGGER.search(x)) or x == "at" for x in spoken]
        for i, (start, _) in enumerate(tokens):
            if not (spoken[i][0].isalnum() or spoken[i] in "+("):
                continue
            hit = False
            for j in range(i, min(i + LONGEST, len(tokens))):
                if j > i and (tokens[j][0] - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1] : tokens[j][0]]):
                    break
                hit = hit or useful[j]
                if not hit or not spoken[j][-1].isalnum():
                    continue
                end = tokens[j][1]
                if end - start < 6 or not any(look.fullmatch(text, start, end) for _, look in LOOKS):
                    continue
                before = spoken[i - 1] if i else ""
                # A sign between the name and the value is looked through.
                if before in ("=", ":", '"', "'") and i > 1:
                    before = next((x for x in reversed(spoken[max(0, i - 4) : i]) if x[0].isalnum()), before)
                joined = (i > 0 and tokens[i - 1][1] == start) + (j + 1 < len(tokens) and tokens[j + 1][0] == end)
                yield i, j, segment_features(text[start:end], before, spoken[j + 1] if j + 1 < len(tokens) else ""), joined

    def score(self, features: list[str], joined: int) -> np.ndarray:
        total = joined * self.glued
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total = total + w
        return total

    def lattice(self, text: str, tokens: list[tuple[int, int]]):
        """Scored candidates by last token."""
        by_end: list[list] = [[] for _ in tokens]
        for i, j, features, joined in self.segments(text, tokens):
            by_end[j].append((i, features, joined, self.score(features, joined)))
        return by_end

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation: boundaries and kinds together."""
        n = len(tokens)
        by_end = self.lattice(text, tokens)
        best = np.full((n + 1, self.kinds), -np.inf)
        best[0, OUTSIDE] = 0.0
        back: list[list] = [[None] * self.kinds for _ in range(n + 1)]
        for t in range(1, n + 1):
            into = best[t - 1] + self.moves[:, OUTSIDE]
            best[t, OUTSIDE], back[t][OUTSIDE] = into.max(), (t - 1, int(into.argmax()))
            for i, _, _, score in by_end[t - 1]:
                into = best[i][:, None] + self.moves[:, 1:]
                values, origin = into.max(axis=0) + score[1:], into.argmax(axis=0)
                for k in np.flatnonzero(values > best[t, 1:]):
                    best[t, k + 1], back[t][k + 1] = values[k], (i, int(origin[k]))
        out, t, k = [], n, int(best[n].argmax()) if n else 0
        while t > 0:
            origin, before = back[t][k]
            if k != OUTSIDE:
                out.append((KINDS[k - 1], tokens[origin][0], tokens[t - 1][1]))
            t, k = origin, before
        return out[::-1]

    def learn(self, text: str, gold: list[Span], rate: float) -> None:
        """One step of stochastic gradient ascent on the log-likelihood of a labelled text."""
        tokens = [m.span() for m in TOKEN.finditer(text)]
        n, by_end = len(tokens), self.lattice(text, tokens)
        at = {a: i for i, (a, _) in enumerate(tokens)}
        to = {b: i for i, (_, b) in enumerate(tokens)}
        truth = {(at[a], to[b]): KINDS.index(k) + 1 for k, a, b in gold if a in at and b in to}
        forward = np.full((n + 1, self.kinds), -np.inf)
        forward[0, OUTSIDE] = 0.0
        for t in range(1, n + 1):
            forward[t, OUTSIDE] = _logsum(forward[t - 1] + self.moves[:, OUTSIDE])
            for i, _, _, score in by_end[t - 1]:
                forward[t, 1:] = np.logaddexp(forward[t, 1:], _logsum0(forward[i][:, None] + self.moves[:, 1:]) + score[1:])
        whole = _logsum(forward[n])
        after = np.full((n + 1, self.kinds), -np.inf)
        after[n] = 0.0
        moved = np.zeros_like(self.moves)
        changes = []
        for t in range(n, 0, -1):
            out = after[t, OUTSIDE]
            step = np.exp(np.minimum(forward[t - 1] + self.moves[:, OUTSIDE] + out - whole, 0.0))
            moved[:, OUTSIDE] -= step
            after[t - 1] = np.logaddexp(after[t - 1], self.moves[:, OUTSIDE] + out)
            for i, features, joined, score in by_end[t - 1]:
                gain = score[1:] + after[t, 1:]
                p = np.exp(np.minimum(forward[i][:, None] + self.moves[:, 1:] + gain - whole, 0.0))
                moved[:, 1:] -= p
                after[i] = np.logaddexp(after[i], _logsum0((self.moves[:, 1:] + gain).T))
                miss = np.zeros(self.kinds)
                miss[1:] = -p.sum(axis=0)
                kind = truth.get((i, t - 1))
                if kind:
                    miss[kind] += 1
                if np.abs(miss).max() > 1e-4:
                    changes.append((features, joined, miss))
        ends = {i: (j, k) for (i, j), k in truth.items()}
        t, k = 0, OUTSIDE
        while t < n:
            j, kind = ends.get(t, (t, OUTSIDE))
            moved[k, kind] += 1
            t, k = j + 1, kind
        self.moves += rate * moved
        for features, joined, miss in changes:
            self.glued += rate * 0.2 * joined * miss
            for f in features:
                self.weights[f] = self.weights.get(f, 0.0) + rate * miss


def _logsum(x: np.ndarray) -> float:
    top = x.max()
    return top if top == -np.inf else float(top + np.log(np.exp(x - top).sum()))


def _logsum0(x: np.ndarray) -> np.ndarray:
    top = np.maximum(x.max(axis=0), -1e300)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(axis=0))


# Training texts: invented entities of every kind in invented sentences, with look-alikes.

PLAIN = (
    "the order of was sent to our office and will be ready on monday please see page chapter version release section about years people "
    "der die und nicht mit von das eine le la les des est une pour el los las que por una con for more details write or ask us now"
).split()


def labelled_text(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """An invented text with the spans of its entities."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(pick(of) for _ in range(n))

    def card() -> str:
        body = pick("3456") + number(int(rng.integers(12, 16)) - 1)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        by = pick(["", "", " ", "-", "."])
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if by else digits

    def entity(kind: str) -> str:
        if kind == "email":
            at, dot = pick([("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "."), (" @ ", ".")])
            end = "." if at == "@" else dot
            return letters(int(rng.integers(3, 9))) + pick(["", "." + number(2), "_" + letters(3), "." + letters(5)]) + at + letters(5) + pick(["", number(1)]) + end + pick(["example", letters(6)]) + end + pick(["com", "org", "net", "de"])
        if kind == "ip":
            return pick([".", ".", ".", "-"]).join(str(rng.integers(1, 255)) for _ in range(4))
        if kind == "card":
            return card()
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(10, 99)} {a} {b} {c}", f"00{rng.integers(10, 99)} {a} {b}{c}", f"{a}.{b}.{c}"])
        return pick([
            "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), letters(40, "0123456789abcdef"), letters(18, "0123456789abcdef"),
            letters(32, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"),
        ])

    def lookalike() -> str:
        return pick([
            f"{rng.integers(1, 9)}.{rng.integers(0, 20)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 30)}", f"{rng.integers(1900, 2030)}",
            f"{rng.integers(1, 31)}.{rng.integers(1, 12)}.{rng.integers(1990, 2030)}", f"{rng.integers(1990, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 31)}",
            f"{number(2)}:{number(2)}", f"{number(3)},{number(3)},{number(3)}", f"{number(2)} %", f"CC BY-NC {rng.integers(1, 4)}.0", letters(7) + number(2),
            f"{number(1)} {number(2)} {number(3)}", number(7), number(12), f"ISBN 978-{number(1)}-{number(5)}-{number(3)}-{number(1)}", f"@{letters(8)}", f"fig{number(1)}",
        ])

    lead = {
        "email": ["", "mail ", "email: ", "contact "], "ip": ["", "host ", "server ", "ip: "], "card": ["", "card ", "visa: "], "phone": ["", "call ", "phone: ", "tel "],
        "secret": ["", "password=", 'token = "', "api_key: ", "secret "],
    }
    text, spans = "", []
    for _ in range(int(rng.integers(3, 6))):
        text += " ".join(pick(PLAIN) for _ in range(int(rng.integers(1, 5)))) + pick([" ", " ", ", ", ". ", "\n"])
        if rng.random() < 0.45:
            text += lookalike()
        else:
            kind = pick(KINDS)
            before = pick(lead[kind])
            value = entity(kind)
            # A bare short key says nothing by itself.
            if kind == "secret" and len(value) < 20 and not before:
                before = "password="
            text += before
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + ('"' if before.endswith('"') else "")
        text += pick([" ", " ", ", ", ". ", ".\n", "\n"])
    return text.rstrip(), spans


@lru_cache(maxsize=4)
def train(seed: int = 7, texts: int = 500, rounds: int = 3, rate: float = 0.25) -> Decoder:
    """A decoder fitted to invented labelled texts; the same seed gives the same decoder."""
    rng = np.random.default_rng(seed)
    data = [labelled_text(rng) for _ in range(texts)]
    model = Decoder()
    for r in range(rounds):
        for i in rng.permutation(texts):
            model.learn(*data[int(i)], rate / (1 + r))
    return model


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text within reach of a digit, ``@`` or spelled-out sign, cut at white space where there is one."""
    start = end = -1
    for first, last in heapq.merge(((m.start(), m.start()) for m in TRIGGER.finditer(text)), ((m.start(), m.end() - 1) for m in SPELLED.finditer(text))):
        if end < 0:
            start, end = first, first
        elif first - end > 2 * AROUND:
            yield _part(text, start, end)
            start = first
        end = max(end, last)
        if end - start > 4096:
            yield _part(text, start, end)
            start, end = -1, -1
    if end >= 0:
        yield _part(text, start, end)


def _part(text: str, start: int, end: int) -> tuple[int, int]:
    a = max(0, start - AROUND)
    cut = text.find(" ", a, start) if a else -1
    b = min(len(text), end + AROUND)
    last = text.rfind(" ", end, b) if b < len(text) else -1
    return (cut + 1 if cut >= 0 else a), (last if last >= 0 else b)


def find_spans(text: str, model: Decoder) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base): the pattern spans, and the model's that touch none of them."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken = [(a, b) for _, a, b in base]
    for a, b in windows(text):
        tokens = [(m.start() + a, m.end() + a) for m in TOKEN.finditer(text[a:b])]
        for kind, start, end in model.decode(text, tokens):
            if not any(start < y and x < end for x, y in taken):
                out.append((kind, start, end, False))
                taken.append((start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, *, id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """(id, spans): personal data in every whole text, by start and kind; offsets in code points.

    ``base`` marks spans of the patterns (email, ip, card, phone).  The semi-Markov CRF
    adds spans that touch none of them: spellings the patterns miss, and secrets (keys,
    tokens, passwords).  It scores whole candidate segments of up to ``LONGEST`` tokens
    near a digit, ``@`` or a spelled-out sign with a domain behind it; text out of reach of
    one holds no candidate.  Null and empty texts have no spans; every row gets a row, repeated ids too.
    """
    spark = prepare(docs.sparkSession)
    model = by_value(spark, train(seed))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base")
        decoder = loaded(model)
        for batch in batches:
            found = []
            for value in batch.column(1):
                t = value.as_py() or ""
                found.append([dict(zip(names, s)) for s in find_spans(t, decoder)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    of = dict(docs.dtypes)[id]
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(compute, f"id {of}, spans {SPANS}").withColumnRenamed("id", id)
