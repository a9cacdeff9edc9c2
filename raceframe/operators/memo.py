"""Keyword rules over a table of texts.

The keywords of all rules are one trie, compiled into one pattern.  It travels as a literal,
as do the rules, so the plan has the same steps for any number of rules, and a text is read
once; no join is needed.  Positions count characters from 0.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.functions import constants as K

_BLANK = " \t\n\r\f\u000b　"
# Characters that are walked at a time, so that the list of hits in hand stays short.
STRETCH = 4096
# Two characters that no text should hold; in a text they match no keyword.
MARKS = ("\ufdd0", "\ufdd1")


@dataclass(frozen=True)
class Rule:
    """A keyword that stands for a value of a category; ``every`` finds all its places, else the first.

    ``weighed`` lets words before the keyword weigh it (by default where every place counts),
    ``negatable`` lets words around it negate it.  ``polarity`` turns round when negated,
    unless it is neutral.  ``needs_feature``, ``is_warning`` and ``warning`` go to the chip,
    ``reason`` too.
    """

    category: str
    value: str
    keyword: str
    label: str = ""
    every: bool = True
    reason: str = ""
    weighed: bool | None = None
    negatable: bool = True
    polarity: str | None = None
    needs_feature: bool = False
    is_warning: bool = False
    warning: str = ""

    def __post_init__(self):
        if not self.keyword:
            raise ValueError("empty keyword")
        if self.weighed is None:
            object.__setattr__(self, "weighed", self.every)


@dataclass(frozen=True)
class Wording:
    """Texts that negate or weigh a keyword."""

    after: Sequence[str] = tuple(K.NEGATION_AFTER)
    before: Sequence[str] = tuple(K.NEGATION_BEFORE)
    doubt: Sequence[str] = tuple(K.DOUBT_AFTER)
    intensity: Mapping[float, Sequence[str]] = field(default_factory=lambda: dict(K.INTENSITY))


def trie(keywords: Sequence[str]) -> str:
    """A pattern that matches the longest keyword at a place: a trie, so that a place tries each letter once."""
    root: dict = {}
    for keyword in keywords:
        node = root
        for c in keyword:
            node = node.setdefault(c, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        # Letters as code points: no character of a keyword means anything to the pattern.
        parts = [f"\\x{{{ord(c):x}}}{spelled(child)}" for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return spelled(root)


def _literal(value, kind: str) -> Column:
    """One literal for a whole list: parsed once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _overlaps_itself(keyword: str) -> bool:
    return any(keyword.startswith(keyword[k:]) for k in range(1, len(keyword)))


def _apart(places: Column, size: int) -> Column:
    """Of places in order, those a search from left to right without overlap finds."""
    start = F.struct(F.lit(-size).alias("last"), F.expr("cast(array() as array<int>)").alias("kept"))
    walk = F.aggregate(
        places, start,
        lambda s, p: F.when(p >= s["last"] + size, F.struct(p.alias("last"), F.array_append(s["kept"], p).alias("kept"))).otherwise(s),
    )
    return walk["kept"]


def _hits(text: Column, rules: Sequence[Rule]) -> Column:
    """Array of (rule, position) of every place of every keyword.

    A pass over the text sets two marks around a copy of the longest keyword at each place
    where one starts; cut at the marks, the pieces give the places.  Shorter keywords that
    start there are its beginnings, which are known beforehand.
    """
    keywords = list(dict.fromkeys(r.keyword for r in rules))
    if any(m in k for k in keywords for m in MARKS):
        raise ValueError("keywords hold the marks of the search")
    begun = {k: [i for i, r in enumerate(rules) if k.startswith(r.keyword)] for k in keywords}
    names, starts = _literal(keywords, "array<string>"), _literal([begun[k] for k in keywords], "array<array<int>>")
    heads = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({k[0] for k in keywords}))
    pattern = f"(?=[{heads}])(?=({trie(keywords)}))"
    reach = max(map(len, keywords)) - 1
    # Marks in a text are not keywords: another character keeps the places.
    clean = F.translate(text, "".join(MARKS), "\ufffd\ufffd")
    pieces = F.regexp_extract_all(clean, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def places(piece: Column, number: Column) -> Column:
        def walk(parts: Column) -> Column:
            def step(s: Column, part: Column) -> Column:
                rest = F.substring_index(part, MARKS[1], -1)
                here = F.struct(s["at"].alias("at"), F.substring_index(part, MARKS[1], 1).alias("keyword"))
                return F.struct((s["at"] + F.length(rest)).alias("at"), F.array_append(s["found"], here).alias("found"))

            start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.expr("cast(array() as array<struct<at int, keyword string>>)").alias("found"))
            return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda s: F.filter(s["found"], lambda h: h["at"] < STRETCH))

        def numbered(h: Column) -> Column:
            at = number * STRETCH + h["at"]
            found = F.get(starts, (F.array_position(names, h["keyword"]) - 1).cast("int"))
            return F.transform(found, lambda r: F.struct(r.alias("rule"), at.alias("position")))

        # Cut once, then used twice: an array of one value is a name for it.
        cut = F.array(F.split(F.regexp_replace(piece, pattern, f"{MARKS[0]}$1{MARKS[1]}"), MARKS[0], -1))
        return F.flatten(F.transform(F.get(F.transform(cut, walk), F.lit(0)), numbered))

    def with_next(pieces: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, reach)))

    named = F.get(F.transform(F.array(pieces), with_next), F.lit(0))
    return F.flatten(F.transform(named, places))


def _kept(body: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Of the places ``__h``, the first of rules that want only it, and none that overlap one of the same keyword."""
    firsts = [i for i, r in enumerate(rules) if not r.every]
    selfish = [i for i, r in enumerate(rules) if r.every and _overlaps_itself(r.keyword)]
    if not firsts and not selfish:
        return body
    hits, some = F.col("__h"), _literal(firsts + selfish, "array<int>")
    # A column of its own: inside the lambda below the expression would be worked out for every place.
    body = body.withColumn("__f", F.array_sort(F.filter(hits, lambda h: F.array_contains(_literal(firsts, "array<int>"), h["rule"]))))
    first = F.filter("__f", lambda h, i: (i == 0) | (F.get(F.col("__f"), i - 1)["rule"] != h["rule"]))
    parts = [F.filter(hits, lambda h: ~F.array_contains(some, h["rule"])), first]
    for i in selfish:
        def of(h: Column, i=i) -> Column:
            return h["rule"] == i

        def found(p: Column, *, i=i) -> Column:
            return F.struct(F.lit(i).alias("rule"), p.alias("position"))

        places = F.transform(F.filter(hits, _one(of)), lambda h: h["position"])
        parts.append(F.transform(_apart(F.array_sort(places), len(rules[i].keyword)), _one(found)))
    return body.withColumn("__h", F.concat(*parts)).drop("__f")


def _one(fn):
    return lambda x: fn(x)


def _any(values: Sequence[str], test) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return out


def _intensity(before: Column, wording: Wording) -> Column:
    out = F.lit(1.0)
    chain = [(w, m) for m, words in wording.intensity.items() for w in words]
    for word, factor in reversed(chain):
        out = F.when(before.endswith(word), float(factor)).otherwise(out)
    return out


def told(rules: Sequence[Rule]) -> Column:
    """The rules as one array of structs, for lookup by number."""
    kinds = "category string, value string, keyword string, label string, every boolean, reason string, weighed boolean, negatable boolean, polarity string, needs_feature boolean, is_warning boolean, warning string"
    return _literal([asdict(r) for r in rules], f"array<struct<{kinds.replace(' string', ':string').replace(' boolean', ':boolean')}>>")


def matches(df: DataFrame, doc: str | Sequence[str], text: str, rules: Sequence[Rule], wording: Wording = Wording()) -> DataFrame:
    """One row per keyword found: rule, category, value, keyword, position, negation, intensity, polarity.

    ``doc`` names the column, or columns, that tell documents apart.  Blanks around a text do
    not count; NULL and empty texts have no matches.  Places of one keyword do not overlap.
    """
    keys = [doc] if isinstance(doc, str) else list(doc)
    body = df.select(*keys, F.btrim(F.col(text), F.lit(_BLANK)).alias("__t"))
    body = body.withColumn("__h", _hits(F.col("__t"), rules))
    body = _kept(body, rules)
    t, size = F.col("__t"), _literal([len(r.keyword) for r in rules], "array<int>")

    def hit(h: Column) -> Column:
        p, end = h["position"], h["position"] + F.get(size, h["rule"])
        start = F.greatest(p - 5, F.lit(0))
        return F.struct(
            h["rule"].alias("rule"), p.alias("position"), t.substr(start + 1, p - start).alias("before"),
            t.substr(end + 1, F.lit(8)).alias("after"),
        )

    rows = body.select(*keys, F.explode(F.transform("__h", hit)).alias("m")).select(*keys, "m.*").withColumn("r", F.get(told(rules), F.col("rule")))
    before, after = F.col("before"), F.col("after")
    six, five = F.substring(after, 1, 6), F.substring(after, 1, 5)
    negated = (
        _any(wording.after, lambda w: six.startswith(w) | five.contains(w)) | _any(wording.before, before.endswith)
        | _any(wording.doubt, after.contains)
    )
    negated = F.col("r.negatable") & negated
    weight = F.when(F.col("r.weighed"), _intensity(before, wording)).otherwise(1.0)
    turned = F.when(F.col("r.polarity") == "positive", "negative").when(F.col("r.polarity") == "negative", "positive").otherwise(F.col("r.polarity"))
    return rows.select(
        *keys, "rule", "r.category", "r.value", "r.keyword", "position", negated.alias("is_negated"), weight.alias("intensity"),
        F.when(negated, turned).otherwise(F.col("r.polarity")).alias("polarity"),
    )


def scores(found: DataFrame, doc: str) -> DataFrame:
    """Sum of intensities per value, negated ones subtracted."""
    signed = F.when(F.col("is_negated"), -F.col("intensity")).otherwise(F.col("intensity"))
    return found.groupBy(doc, "category", "value").agg(F.sum(signed).alias("score"), F.min("rule").alias("first_rule"))


def suggestions(found: DataFrame, doc: str) -> DataFrame:
    """Best value per category where it is positive; ties go to the value listed first."""
    s = scores(found, doc).withColumn("score", F.round("score", 9))
    best = s.groupBy(doc, "category").agg(F.max_by(F.struct("value", "score"), F.struct(F.col("score"), -F.col("first_rule"))).alias("b"))
    return best.select(doc, "category", F.col("b.value").alias("value"), F.col("b.score").alias("score")).filter("score > 0")


def conflicts(found: DataFrame, doc: str, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Pairs of values (``category.value``) that contradict each other and both occur, not negated."""
    key = F.concat_ws(".", "category", "value")
    sides = sorted({s for a, b, _ in pairs for s in (a, b)})
    seen = found.filter(~F.col("is_negated") & key.isin(sides)).groupBy(doc).agg(
        *[F.max(key == s).alias(f"__{i}") for i, s in enumerate(sides)]
    )
    at = {s: F.col(f"__{i}") for i, s in enumerate(sides)}
    hits = F.array_compact(
        F.array(
            *[
                F.when(at[a] & at[b], F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(m).alias("message")))
                for a, b, m in pairs
            ]
        )
    )
    return seen.select(doc, F.explode(hits).alias("c")).select(doc, "c.*")


# Names of negated values by category, and the form fields that a chip may fill.
NEGATED = {
    "lane_bias": {"inner": "内伸び", "middle": "中央", "outer": "外伸び"}, "style_bias": {"front": "前残り", "closer": "差し届き"},
    "pace": {"S": "スロー", "M": "ミドル", "H": "ハイペース"}, "track_condition": {"良": "良馬場", "稍重": "稍重", "重": "重馬場", "不良": "不良馬場"},
}
APPLIED = ["track_condition", "lane_bias", "style_bias", "pace", "tag"]


def chips(found: DataFrame, doc: str, rules: Sequence[Rule], pairs: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """One chip per (document, category, value) from its first match, and one per conflict.

    ``payload`` is what the chip sets in a form, ``field`` to value.  A negated first match
    gives a warning chip that sets nothing and is not turned into its opposite.
    """
    first = found.groupBy(doc, "category", "value").agg(
        F.min_by(F.struct("rule", "is_negated", "intensity", "keyword"), F.struct("rule", "position")).alias("m")
    ).withColumn("r", F.get(told(rules), F.col("m.rule")))
    own = F.concat_ws(".", "category", "value")
    label = F.coalesce(F.when(F.col("r.label") != "", F.col("r.label")), own)
    named = F.lit(None).cast("string")
    for category, names in NEGATED.items():
        for value, name in names.items():
            named = F.when((F.col("category") == category) & (F.col("value") == value), name).otherwise(named)
    no = F.col("m.is_negated")
    nothing = F.expr("cast(map() as map<string, string>)")
    sets = F.when(~no & F.col("category").isin(APPLIED), F.create_map("category", "value")).otherwise(nothing)
    out = first.select(
        doc, F.when(no, F.concat(F.lit("negated."), own)).otherwise(own).alias("chip"),
        F.when(no, F.concat(F.coalesce(named, label), F.lit("否定"))).otherwise(label).alias("label"),
        F.when(no, "negation").otherwise(F.col("category")).alias("kind"),
        F.when(no, F.col("m.intensity")).otherwise(F.least(F.lit(1.0), F.col("m.intensity"))).alias("confidence"), (no | F.col("r.is_warning")).alias("is_warning"),
        F.when(no, F.concat(F.lit("「"), "m.keyword", F.lit("」が否定されています"))).otherwise(F.col("r.reason")).alias("reason"),
        (~no & F.col("r.needs_feature")).alias("needs_feature"), F.when(~no & F.col("r.is_warning"), F.col("r.warning")).alias("warning"), sets.alias("payload"),
    )
    if not pairs:
        return out
    c = conflicts(found, doc, pairs).select(
        doc, F.concat(F.lit("conflict."), "first", F.lit("_"), "second").alias("chip"), F.lit("矛盾注意").alias("label"),
        F.lit("conflict").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_warning"), F.col("message").alias("reason"),
        F.lit(False).alias("needs_feature"), F.lit(None).cast("string").alias("warning"), nothing.alias("payload"),
    )
    return out.unionByName(c)
