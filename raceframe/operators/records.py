"""As-of records of several keys and conditions at once.

Every row belongs to one cell per record (say: its entity, its actor, its pair of both):
the key, the day and the values of the conditions.  One partitioning by key serves all
running totals, whatever the number of conditions.  Rows of ordinary keys run through the
windows themselves.  Where a key has very many rows, cells are summed first and the totals
go back to the rows over the cell: it has only as many cells as days and condition values.
The number of shuffles does not depend on the number of keys or conditions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceframe.operators.grouping import _AGG, _MERGE, BUCKETS, CROWDED, Measures
from raceframe.operators.history import ROW, ratio, result_measures, spread

RATES = ("n", "wins", "in3")
# What each aggregate gives for a single row.
_ONE = {"sum": lambda c: c, "min": lambda c: c, "max": lambda c: c, "count": lambda c: F.when(c.isNotNull(), 1).otherwise(0).cast("long")}


@dataclass(frozen=True)
class Record:
    """What a key had done before: ``keys``, ``conditions`` by suffix, the ``days`` of a recent span.

    ``full`` adds means, spreads and extremes of outcome, section time, prize and weight;
    ``detailed`` names the suffixes that get the means of outcome and section time.
    """

    prefix: str
    keys: Sequence[str]
    conditions: Mapping[str, str] = field(default_factory=dict)
    days: int | None = None
    full: bool = False
    detailed: Sequence[str] = ()


def _cell(number: int, record: Record, slots: Sequence[str]) -> Column:
    """Record, key and condition values of a row, in numbers: 128 bits of hash stand for a key.

    Numbers sort and join several times faster than the texts they stand for.  An unknown or
    unused condition is 0, and no value's hash is.
    """
    known = F.lit(True)
    for k in record.keys:
        known = known & F.col(k).isNotNull()
    halves = [F.xxhash64(F.lit(seed), F.lit(number), *[F.col(k).cast("string") for k in record.keys]) for seed in (1, 2)]
    values = [F.when(F.col(s).isNotNull(), F.xxhash64(s).bitwiseOR(F.lit(1).cast("long"))) if s in record.conditions.values() else F.lit(None) for s in slots]
    return F.struct(
        F.when(known, F.lit(number)).alias("b"), halves[0].alias("h"), halves[1].alias("g"),
        *[F.coalesce(v, F.lit(0).cast("long")).alias(f"c{i}") for i, v in enumerate(values)], F.col("day").alias("day"),
    )


def _totals(records: Sequence[Record], slots: Sequence[str], measures: Measures) -> dict[str, Column]:
    """Running totals of the days before, by name: ``t_`` overall, ``r_`` recent, ``s<slot>_`` per condition."""
    out = {}

    def add(prefix: str, window, names: Sequence[str], known: Column) -> None:
        for name in names:
            total = F.when(known, _MERGE[measures[name][0]](name).over(window))
            out[prefix + name] = F.coalesce(total, F.lit(0).cast("long")) if measures[name][0] == "count" else total

    ordered = Window.partitionBy("h", "g").orderBy("day")
    add("t_", ordered.rangeBetween(Window.unboundedPreceding, -1), list(measures), F.lit(True))
    spans = {r.days for r in records if r.days is not None}
    if len(spans) > 1:
        raise ValueError(f"recent spans differ: {sorted(spans)}")
    if spans:
        # Counts can be taken off: a sliding frame would add up all its rows for every row.
        add("r_", ordered.rangeBetween(Window.unboundedPreceding, -spans.pop() - 1), RATES, F.lit(True))
        out |= {f"r_{n}": out[f"t_{n}"] - out[f"r_{n}"] for n in RATES}
    detailed = {r.conditions[s] for r in records for s in r.detailed}
    for i, slot in enumerate(slots):
        more = [m for m in ("o_sum", "l_n", "l_sum") if m in measures] if slot in detailed else []
        same = Window.partitionBy("h", "g", f"c{i}").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
        # An unknown value is no condition to share.
        add(f"s{i}_", same, [*RATES, *more], F.col(f"c{i}") != 0)
    return out


def _used(record: Record, slots: Sequence[str], totals: Sequence[str]) -> list[str]:
    """The totals that the record's features read."""
    prefixes = {"t_"} | ({"r_"} if record.days is not None else set())
    rich = {f"s{slots.index(record.conditions[x])}_" for x in record.detailed} | ({"t_"} if record.full else set())
    prefixes |= {f"s{slots.index(c)}_" for c in record.conditions.values()}
    parts = [(n, n[: n.index("_") + 1], n[n.index("_") + 1 :]) for n in totals]
    return [n for n, prefix, name in parts if prefix in prefixes and (name in RATES or prefix in rich)]


def _features(record: Record, slots: Sequence[str], x: Mapping[str, Column]) -> dict[str, Column]:
    """Columns of one record from its totals."""
    p = record.prefix

    def rates(n: str, start: str, end: str = "") -> dict[str, Column]:
        return {
            f"{p}{start}n_starts{end}": x[f"{n}n"], f"{p}{start}win_rate{end}": ratio(x[f"{n}wins"], x[f"{n}n"]),
            f"{p}{start}in3_rate{end}": ratio(x[f"{n}in3"], x[f"{n}n"]),
        }

    out = {**rates("t_", ""), f"{p}n_wins": x["t_wins"]}
    if record.days is not None:
        out |= rates("r_", f"recent{record.days}d_")
    for suffix, column in record.conditions.items():
        s = f"s{slots.index(column)}_"
        out |= rates(s, "", suffix)
        if suffix in record.detailed:
            out[f"{p}avg_finish{suffix}"] = ratio(x[f"{s}o_sum"], x[f"{s}n"])
            if f"{s}l_n" in x:
                out[f"{p}avg_last3f{suffix}"] = ratio(x[f"{s}l_sum"], x[f"{s}l_n"])
    if record.full:
        out |= {
            f"{p}n_in3": x["t_in3"], f"{p}avg_finish": ratio(x["t_o_sum"], x["t_n"]), f"{p}std_finish": spread(x["t_n"], x["t_o_sum"], x["t_o_sq"]),
            f"{p}best_finish": x["t_best"], f"{p}worst_finish": x["t_worst"], f"{p}is_first_run": F.when(x["t_n"] > 0, 0).when(x["t_n"] == 0, 1),
        }
        if "t_l_n" in x:
            out |= {f"{p}avg_last3f": ratio(x["t_l_sum"], x["t_l_n"]), f"{p}best_last3f": x["t_l_best"]}
        if "t_p_n" in x:
            out |= {f"{p}total_prize": F.when(x["t_n"].isNotNull(), F.coalesce(x["t_p_sum"], F.lit(0))), f"{p}avg_prize": ratio(x["t_p_sum"], x["t_p_n"]), f"{p}max_prize": x["t_p_max"]}
        if "t_w_n" in x:
            out |= {f"{p}avg_body_weight": ratio(x["t_w_sum"], x["t_w_n"]), f"{p}std_body_weight": spread(x["t_w_n"], x["t_w_sum"], x["t_w_sq"])}
    return out


def _told(df: DataFrame, wanted: Sequence[Record], numbers: Sequence[int], slots: Sequence[str], hot_rows: int) -> tuple[DataFrame, dict[int, list[str]], dict[str, str]]:
    """(event, entity, b, w, o): totals of every row under the records ``numbers``; the names of those of each record, and their types."""
    rich = [i for i in numbers if wanted[i].full or wanted[i].detailed]
    measures = result_measures(df, None if rich else RATES)
    cells = F.array(*[_cell(i, wanted[i], slots) for i in numbers])
    inputs = [c for c in ("outcome", "last3f", "prize", "weight") if c in df.columns and (rich or c == "outcome")]
    rows = df.select(*ROW, *dict.fromkeys(["day", *inputs]), F.explode(cells).alias("cell")).filter("cell.b IS NOT NULL")
    cell = ["b", "h", "g", *[f"c{i}" for i in range(len(slots))], "day"]
    told = F.col("cell.b").isin(rich)
    # Only some records read more than their rates: elsewhere the measures stay NULL.
    rows = rows.select(*ROW, *[F.when(told, F.col(c)).alias(c) if c != "outcome" else F.col(c) for c in inputs], *[F.col(f"cell.{c}").alias(c) for c in cell])
    told = F.col("b").isin(rich)
    counted = {n: (fn, c if n in RATES else F.when(told, c)) for n, (fn, c) in measures.items()}
    totals = _totals([wanted[i] for i in numbers], slots, measures)
    used = {i: _used(wanted[i], slots, list(totals)) for i in numbers}

    # Buckets of keys with more rows than a task should order at once; there are few, and of
    # few keys, as all others share theirs with keys of ordinary size.
    bucket = F.pmod("h", F.lit(BUCKETS))
    crowded = rows.groupBy("b", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select("b", "bucket")
    crowded = F.broadcast(crowded.withColumnsRenamed({"b": "__b", "bucket": "__bucket"}))
    inside = (F.col("b") == F.col("__b")) & (bucket == F.col("__bucket"))

    # Ordinary keys: a row is a cell of its own, and the windows run over the rows themselves.
    ordinary = rows.join(crowded, inside, "left_anti").repartition("h", "g")
    single = ordinary.select(*ROW, *cell, *[_ONE[fn](c).alias(n) for n, (fn, c) in counted.items()])
    single = single.select(*ROW, "b", "day", *[c.alias(n) for n, c in totals.items()]).filter("day IS NOT NULL")

    # Crowded ones: cells are summed first, and the totals go back to the rows over the cell.
    many = rows.join(crowded, inside, "left_semi")
    daily = many.groupBy(*cell).agg(*[_AGG[fn](c).alias(n) for n, (fn, c) in counted.items()])
    before = daily.repartition("h", "g").select(*cell, *[c.alias(n) for n, c in totals.items()])

    # Totals travel as two short arrays per row and record: whole numbers, and the others.
    types = dict(before.dtypes)

    def packed(whole: bool, kind: str) -> Column:
        out = F.lit(None).cast(f"array<{kind}>")
        for i, every in used.items():
            names = [n for n in every if (types[n] in ("bigint", "int")) == whole]
            if names:
                out = F.when(F.col("b") == i, F.array(*[F.col(n).cast(kind) for n in names])).otherwise(out)
        return out

    arrays = ["b", packed(True, "long").alias("w"), packed(False, "double").alias("o")]
    # Two hashes of a cell stand for it: rows and totals that travel to each other need no more.
    place = [F.xxhash64(F.lit(seed), *cell).alias(n) for seed, n in ((1, "x"), (2, "y"))]
    back = many.filter("day IS NOT NULL").select(*ROW, *place).join(before.select(*place, *arrays), ["x", "y"]).select(*ROW, "b", "w", "o")
    return single.select(*ROW, *arrays).unionByName(back), used, types


def records(df: DataFrame, wanted: Sequence[Record], hot_rows: int = CROWDED, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(event, entity, features): date-strict record of every row under each of ``wanted``.

    A row counts from the day after its own.  Rows without an outcome do not count.  An
    unknown condition gives 0 starts and NULL rates; a record with a NULL key is NULL
    throughout, and a row with no key at all has no row here.  (event, entity) is the row's
    key: rows that repeat it are told once.  A row without a day has no row here and counts as
    earlier than all others.  Keys in a bucket of more than ``hot_rows`` rows take
    the way over cells.  With ``store``, which writes a table and reads it back, the totals of
    one record are written after the other, so that the shuffle files of one are gone before the next.
    """
    slots = list(dict.fromkeys(c for r in wanted for c in r.conditions.values()))
    whole, other, types, pieces = {}, {}, {}, None
    for numbers in [[i] for i in range(len(wanted))] if store else [list(range(len(wanted)))]:
        told, lists, kinds = _told(df, wanted, numbers, slots, hot_rows)
        types |= kinds
        for i, names in lists.items():
            whole[i] = [n for n in names if kinds[n] in ("bigint", "int")]
            other[i] = [n for n in names if kinds[n] not in ("bigint", "int")]
        told = store(told, "record") if store else told
        pieces = told if pieces is None else pieces.unionByName(told)
    # Rows are dealt out before they are gathered: a row has few cells, so merging them before would only sort twice.
    held = pieces.repartition(*ROW).groupBy(*ROW).agg(*[
        F.max(F.when(F.col("b") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(wanted)) for c, lists in (("w", whole), ("o", other)) if lists[i]
    ])
    out = []
    for i, record in enumerate(wanted):
        x = {n: F.col(f"w{i}")[k].cast(types[n]) for k, n in enumerate(whole[i])} | {n: F.col(f"o{i}")[k].cast(types[n]) for k, n in enumerate(other[i])}
        out += [c.alias(n) for n, c in _features(record, slots, x).items()]
    return held.select(*ROW, *out)
