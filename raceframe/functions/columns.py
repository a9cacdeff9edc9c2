"""Column expressions: parsing, encoding, labels and simple transforms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from raceframe.functions import constants as K


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dates ------------------------------------------------------------------------


def normalize_date(c: Column | str) -> Column:
    """Text in one of three date formats to a date, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(_c(c)), F.lit(f)) for f in K.DATE_FORMATS]).cast("date")


def date_from_event_id(c: Column | str) -> Column:
    """Date in the first eight digits of an event id, NULL if they are no date."""
    head = F.regexp_extract(_c(c).cast("string"), r"^(\d{8})", 1)
    return F.try_to_timestamp(F.when(head != "", head), F.lit("yyyyMMdd")).cast("date")


def event_year(c: Column | str) -> Column:
    """First four characters as a year."""
    return F.substring(_c(c).cast("string"), 1, 4).try_cast("int")


def date_parts(c: Column | str) -> dict[str, Column]:
    """Year, month and weekday (Monday = 0)."""
    return {"year": F.year(_c(c)), "month": F.month(_c(c)), "weekday": F.weekday(_c(c))}


# --- codes ------------------------------------------------------------------------


def code(c: Column | str, table: Mapping[str, int]) -> Column:
    """Code of a trimmed text by a fixed table, NULL if unknown."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.trim(_c(c)))


def _steps(c: Column, steps: Sequence[tuple], last) -> Column:
    out = None
    for bound, value in steps:
        test = c < bound
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(c.isNotNull(), last)


def distance_step(c: Column | str) -> Column:
    """Distance category in ten steps."""
    return _steps(_c(c), K.DISTANCE_STEPS, K.DISTANCE_STEP_LAST)


def distance_range(c: Column | str, surface: Column | str) -> Column:
    """Distance category by exact ranges, own codes over obstacles, NULL in a gap."""
    d = _c(c)
    flat = F.when(d >= K.DISTANCE_RANGE_LAST[0], K.DISTANCE_RANGE_LAST[1])
    for low, high, value in K.DISTANCE_RANGES:
        flat = flat.when(d.between(low, high), value)
    return F.when(_c(surface).contains("障"), _steps(d, K.STEEPLE_STEPS, K.STEEPLE_LAST)).otherwise(flat)


def distance_name(c: Column | str) -> Column:
    """Distance as short, mile, middle or long; unknown if missing."""
    return F.coalesce(_steps(_c(c), K.DISTANCE_NAMES, K.DISTANCE_NAME_LAST), F.lit("unknown"))


def distance_band(c: Column | str) -> Column:
    """Distance as short (to 1400), medium (to 2000) or long."""
    d = _c(c)
    return F.when(d <= 1400, "short").when(d <= 2000, "medium").otherwise("long")


def class_id(c: Column | str) -> Column:
    """Class id by the first text contained, longest spelling first."""
    t = _c(c)
    out = None
    for texts, value in K.CLASS_IDS:
        test = F.lit(False)
        for s in texts:
            test = test | t.contains(s)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(t.isNotNull(), K.CLASS_ID_OTHER)


def class_rank(c: Column | str, grade: Column | str | None = None) -> Column:
    """Strength of a class, 0 if unknown; a grade goes before the class text."""
    t = _c(c)
    out = F.when(t.isNull(), 0)
    if grade is not None:
        g = F.upper(_c(grade))
        for s, value in K.GRADE_RANKS:
            out = out.when(g.contains(s), value)
        out = out.when(g.isin("L", "LISTED"), 7)
    for s, value in K.CLASS_RANKS:
        out = out.when(t.contains(s), value)
    return out.otherwise(0)


def invalid_status(c: Column | str) -> Column:
    """True for a result that must not become a target."""
    t = F.trim(_c(c))
    return F.coalesce(t.isin(K.INVALID_STATUS) | t.contains(K.INVALID_STATUS_TEXT), F.lit(False))


# --- packed text --------------------------------------------------------------------


def positions(c: Column | str) -> Column:
    """"1-2-3-4" to an array of ints; parts that are no number are left out."""
    parts = F.split(F.regexp_replace(_c(c), " ", ""), "-")
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda v: v.isNotNull())


def four_positions(c: Column | str) -> Column:
    """Struct c1..c4 of the first four positions, NULL where missing."""
    parts = F.transform(F.split(F.regexp_replace(_c(c), " ", ""), "-"), lambda x: x.try_cast("int"))
    return F.struct(*[F.try_element_at(parts, F.lit(i)).alias(f"c{i}") for i in range(1, 5)])


def corner_order(c: Column | str) -> Column:
    """"(3,5),1=2" to an array of (number, position).

    Parentheses act as commas, ``=`` joins numbers that share a position.
    """
    places = F.filter(F.transform(F.split(F.regexp_replace(_c(c), r"[()]", ","), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.flatten(
        F.transform(
            places,
            lambda place, i: F.transform(
                F.filter(F.transform(F.split(place, "="), lambda s: s.try_cast("int")), lambda v: v.isNotNull()),
                lambda no: F.struct(no.alias("no"), (i + 1).alias("pos")),
            ),
        )
    )


def weight_of(c: Column | str) -> Column:
    """Leading number of "502(-4)"."""
    s = F.regexp_extract(_c(c).cast("string"), r"^(\d+)", 1)
    return F.when(s != "", s.try_cast("int"))


def weight_change_of(c: Column | str) -> Column:
    """Number in parentheses of "502(-4)"."""
    s = F.regexp_extract(_c(c).cast("string"), r"\(([+-]?\d+)\)", 1)
    return F.when(s != "", s.try_cast("int"))


def seconds_of(c: Column | str) -> Column:
    """"1:34.5" or "59.8" to seconds."""
    t = F.trim(_c(c))
    parts = F.split(t, ":")
    minutes = F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(t.contains(":"), minutes).otherwise(t.try_cast("double"))


def amount_of(c: Column | str) -> Column:
    """"1,230" to a number."""
    return F.regexp_replace(F.trim(_c(c)), ",", "").try_cast("long")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    s = F.regexp_extract(c, pattern, group)
    return F.when(s != "", s)


def course_text(c: Column | str) -> dict[str, Column]:
    """Surface, turn, distance, in/out, weather, going and start time of a course line."""
    t = _c(c)
    head = r"(芝|ダート|ダ|障)(右|左|直)?(\d+)m"
    going = _first(t, r"(?:芝|ダート|ダ)\s*:\s*(良|稍重|稍|重|不良|不)")
    surface, turn = _first(t, head, 1), _first(t, head, 2)
    return {
        "surface": F.when(surface == "芝", "turf").when(surface.startswith("ダ"), "dirt").when(surface == "障", "steeple"),
        "turn": F.when(turn == "右", "right").when(turn == "左", "left").when(turn == "直", "straight"),
        "distance": _first(t, head, 3).try_cast("int"),
        "inout": F.when(t.contains("内"), "inner").when(t.contains("外"), "outer"),
        "weather": _first(t, r"天候\s*:\s*(\S+)"),
        "going": F.when(going == "稍", "稍重").when(going == "不", "不良").otherwise(going),
        "start": _first(t, r"発走\s*:\s*(\d{1,2}:\d{2})"),
    }


def meeting_text(c: Column | str) -> dict[str, Column]:
    """Date, meeting number, place, meeting day and class of a meeting line."""
    t = _c(c)
    ymd = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
    meet = r"(\d+)回([\x{4e00}-\x{9fff}]+?)(\d+)日目"
    classes = [
        "(新馬)", "(未勝利)", "(1勝クラス|500万下)", "(2勝クラス|1000万下)", "(3勝クラス|1600万下)",
        "(オープン|OP)", r"(\d歳以上\d勝クラス)", r"(\d歳\d勝クラス)",
    ]
    parts = [_first(t, ymd, i).try_cast("int") for i in (1, 2, 3)]
    text = F.format_string("%04d%02d%02d", *parts)
    return {
        "date": F.when(parts[0].isNotNull(), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")),
        "meeting": _first(t, meet, 1).try_cast("int"),
        "place": _first(t, meet, 2),
        "meeting_day": _first(t, meet, 3).try_cast("int"),
        "race_class": F.coalesce(*[_first(t, p) for p in classes]),
    }


# --- styles, labels, gate, odds -------------------------------------------------------


def style_by_ratio(passing: Column | str, field_size: Column | str) -> Column:
    """Style from the mean passing position relative to the field."""
    pos = positions(passing)
    n = _c(field_size)
    total = F.aggregate(pos, F.lit(0), lambda s, v: s + v)
    ratio = total.cast("double") / F.size(pos) / n.cast("double")
    ok = (n > 0) & (F.size(pos) > 0)
    out = F.when(~F.coalesce(ok, F.lit(False)), K.STYLE_UNKNOWN)
    for bound, name in K.STYLE_RATIOS:
        out = out.when(ratio <= bound, name)
    return out.otherwise(K.STYLES[3])


def style_by_rank(corner1: Column | str, field_size: Column | str, surface: Column | str, distance: Column | str) -> Column:
    """Style from the rank at the first corner with limits per surface and distance band."""
    c1, n, s = _c(corner1), _c(field_size), _c(surface)
    band = distance_band(distance)
    lead, forward = F.lit(K.STYLE_RANK_DEFAULT[0]), F.lit(K.STYLE_RANK_DEFAULT[1])
    for (surf, b), limits in K.STYLE_RANKS.items():
        if limits != K.STYLE_RANK_DEFAULT:
            hit = (s == surf) & (band == b)
            lead, forward = F.when(hit, limits[0]).otherwise(lead), F.when(hit, limits[1]).otherwise(forward)
    rel = c1.cast("double") / n
    return (
        F.when(c1.isNull() | n.isNull(), K.STYLE_UNKNOWN)
        .when(c1 <= lead, K.STYLES[0])
        .when(c1 <= forward, K.STYLES[1])
        .when(rel > K.STYLE_CLOSER_RATIO, K.STYLES[3])
        .otherwise(K.STYLES[2])
    )


def style_score(style: Column | str) -> Column:
    """Aggressiveness of a style, NULL for an unknown one."""
    pairs = [F.lit(x) for kv in K.STYLE_SCORES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(style))


def late_start(remarks: Column | str) -> Column:
    """True when a remark tells of a late start."""
    return F.coalesce(_c(remarks), F.lit("")).rlike(K.LATE_START)


def within(outcome: Column | str, k: int) -> Column:
    """1 when the outcome is at most ``k``, else 0."""
    return F.when(_c(outcome) <= k, 1).otherwise(0)


def value_label(outcome: Column | str, odds: Column | str, min_odds: float = 10.0) -> Column:
    """1 for an in-three outcome at long odds."""
    return F.when((_c(outcome) <= 3) & (_c(odds) >= min_odds), 1).otherwise(0)


def gate_position(gate: Column | str, number: Column | str, field_size: Column | str) -> dict[str, Column]:
    """Relative gate, inner/outer flags and distance to the edge; NULL becomes 0.5."""
    n = F.greatest(_c(field_size), F.lit(1)).cast("double")
    g = _c(gate)
    pct = g / n
    g1 = F.coalesce(g, F.lit(1))
    edge = F.least(g1 - 1, n - g1) / F.greatest(n - 1, F.lit(1.0))
    half = F.lit(0.5)
    return {
        "ax5_waku_pct": F.coalesce(pct, half),
        "ax5_umaban_pct": F.coalesce(_c(number) / n, half),
        "ax5_is_inner": F.when(pct <= 0.5, 1).otherwise(0),
        "ax5_is_outer": F.when(pct > 0.5, 1).otherwise(0),
        "ax5_gate_distance_to_edge_norm": F.coalesce(edge, half),
    }


def odds_features(odds: Column | str) -> dict[str, Column]:
    """Raw, log and implied probability; invalid odds take the default of 999."""
    o = F.when(_c(odds) > 0, _c(odds).cast("double"))
    return {
        "odds_raw": F.coalesce(o, F.lit(K.ODDS_DEFAULT)),
        "odds_log": F.coalesce(F.ln(o), F.lit(math.log(K.ODDS_DEFAULT))),
        "odds_implied_prob": F.coalesce(1 / o, F.lit(1 / K.ODDS_DEFAULT)),
    }


# --- numbers --------------------------------------------------------------------------


def clip(c: Column | str, low, high) -> Column:
    """Value held between two bounds; NULL stays NULL."""
    v = _c(c)
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high) if not isinstance(high, Column) else high),
                                            F.lit(low) if not isinstance(low, Column) else low))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def sanitize(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    v = _c(c)
    return F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v)


def one_hot(c: Column | str, values: Sequence[str], unknown: str = "first", prefix: str = "") -> dict[str, Column]:
    """One column per listed value; an unknown value follows the given strategy."""
    v = _c(c)
    known = F.coalesce(v.isin(list(values)), F.lit(False))
    out = {}
    for i, value in enumerate(values):
        other = {"first": 1.0 if i == 0 else 0.0, "uniform": 1.0 / len(values), "zeros": 0.0}[unknown]
        out[f"{prefix}{value}"] = F.when(known, (v == value).cast("double")).otherwise(other)
    return out


def weight_flags(std: Column | str, trend: Column | str) -> dict[str, Column]:
    """Volatile, gaining and losing flags; a missing value gives False."""
    no = F.lit(False)
    return {
        "is_weight_volatile": F.coalesce(_c(std) > 4.0, no),
        "is_gaining_weight": F.coalesce(_c(trend) > 2.0, no),
        "is_losing_weight": F.coalesce(_c(trend) < -2.0, no),
    }


def mean_of_two(a: Column | str, b: Column | str) -> Column:
    """Mean of two readings, or the one present."""
    return F.coalesce((_c(a) + _c(b)) / 2, _c(a), _c(b))


# --- feature names -----------------------------------------------------------------------


def feature_safety(
    name: Column | str,
    more_unsafe: Sequence[str] = (),
    more_warn: Sequence[tuple[str, str]] = (),
) -> tuple[Column, Column]:
    """(label, reason) of a feature name: exact names, unsafe patterns, warn patterns."""
    full = _c(name)
    bridged = full.startswith(K.BRIDGE_PREFIX)
    own = F.when(bridged, F.substring(full, len(K.BRIDGE_PREFIX) + 1, 1_000_000)).otherwise(full)
    low = F.lower(own)
    names = [*K.UNSAFE_NAMES, *more_unsafe]
    exact = own.isin(names) | low.isin(names)
    why = None
    for pattern, text in K.UNSAFE_NAME_REASONS:
        why = F.when(low.rlike(pattern), text) if why is None else why.when(low.rlike(pattern), text)
    why = why.otherwise(K.UNSAFE_NAME_REASON_OTHER)
    label, reason = F.when(exact, "unsafe"), F.when(exact, why)
    for pattern, text in K.UNSAFE_PATTERNS:
        label, reason = label.when(low.rlike(pattern), "unsafe"), reason.when(low.rlike(pattern), text)
    for pattern, text in [*K.WARN_PATTERNS, *more_warn]:
        label, reason = label.when(low.rlike(pattern), "warn"), reason.when(low.rlike(pattern), text)
    reason = reason.otherwise("")
    noted = F.when(bridged, F.trim(F.concat(F.lit(K.BRIDGE_NOTE + " "), reason))).otherwise(reason)
    return label.otherwise("safe"), noted


def availability_level(name: Column | str) -> Column:
    """When a feature becomes known; the first rule that fits wins."""
    n = _c(name)
    out = None
    for exact, level in K.LEVEL_BY_NAME.items():
        out = F.when(n == exact, level) if out is None else out.when(n == exact, level)
    for level, pattern in K.LEVEL_PATTERNS:
        out = out.when(F.lower(n).rlike(pattern), level)
    return out.otherwise(K.LEVELS[0])


def level_order(level: Column | str) -> Column:
    """Position of a level in time, from 0."""
    return (F.array_position(F.array(*[F.lit(x) for x in K.LEVELS]), _c(level)) - 1).cast("int")


def feature_group(name: Column | str) -> Column:
    """Group of a feature by the first prefix that fits."""
    n = _c(name)
    out = None
    for group, prefixes in K.FEATURE_GROUPS:
        test = F.lit(False)
        for p in prefixes:
            test = test | n.startswith(p)
        out = F.when(test, group) if out is None else out.when(test, group)
    return out.otherwise("other")


def prefix_group(name: Column | str) -> Column:
    """Text up to the first underscore, or "other"."""
    n = _c(name)
    return F.when(n.contains("_"), F.concat(F.substring_index(n, "_", 1), F.lit("_"))).otherwise("other")


def failure_category(message: Column | str) -> Column:
    """Category of an error message by the first text it contains."""
    m = F.lower(_c(message))
    out = None
    for name, texts in K.FAILURE_TEXTS:
        test = F.lit(False)
        for s in texts:
            test = test | m.contains(s)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def paid_places(field_size: Column | str) -> Column:
    """Number of paid places: 3 from 8 entries, 2 from 5, else 0."""
    n = _c(field_size)
    return F.when(n >= 8, 3).when(n >= 5, 2).otherwise(0)
