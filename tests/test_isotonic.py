"""Isotonic fits against the plain pool-adjacent-violators loop."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from raceframe.operators import grouping, isotonic


def plain(points):
    """[(low, high, value)] of (x, y, w) rows."""
    at = {}
    for x, y, w in points:
        a, b = at.get(x, (0.0, 0.0))
        at[x] = (a + w, b + w * y)
    out = []
    for x in sorted(at):
        w, s = at[x]
        out.append([x, x, w, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [(a, b, s / w, w) for a, b, w, s in out]


def shapes(kind, n, rng):
    if kind == "noise":
        return [(rng.random(), float(rng.random() < 0.3), 1.0) for _ in range(n)]
    if kind == "rising":
        return [(i / n, i / n, 1.0) for i in range(n)]
    if kind == "falling":
        return [(i / n, -float(i), 1.0) for i in range(n)]
    if kind == "dragged":  # one heavy point at the end pulls down all of a rise
        return [(i / n, i / n, 1.0) for i in range(n)] + [(2.0, 0.0, 50.0 * n)]
    if kind == "steps":
        return [(float(i // 7), float((i * i) % 13) + i // 50, 1.0 + i % 3) for i in range(n)]
    return [(rng.random() ** 4, float(rng.random() < rng.random()), 1.0) for _ in range(n)]


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "dragged", "steps", "skew"])
@pytest.mark.parametrize("piece", [40, 100_000])
def test_fit_equals_the_plain_loop(spark, kind, piece):
    data = shapes(kind, 600, random.Random(3))
    df = spark.createDataFrame(data, "x double, y double, w double")
    got = sorted((r.low, r.high, r.value, r.weight) for r in isotonic.fit(df, "x", "y", "w", piece=piece, slopes=4).collect())
    want = plain(data)
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in want]
    assert all(abs(g[2] - e[2]) < 1e-9 and abs(g[3] - e[3]) < 1e-6 for g, e in zip(got, want))


def test_applied_values(spark):
    rng = random.Random(5)
    data = shapes("noise", 300, rng)
    steps = isotonic.fit(spark.createDataFrame(data, "x double, y double, w double"), "x", "y")
    ends = sorted({(x, v) for a, b, v, _ in plain(data) for x in (a, b)})
    xs = [x for x, _ in ends]
    asked = [rng.uniform(-0.2, 1.2) for _ in range(200)] + xs[:20] + [None, float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i long, x double").withColumn("fitted", F.lit("old"))
    got = {r.i: r.fitted for r in isotonic.apply(steps, df, "x", "fitted", piece=25).collect()}
    assert len(got) == len(asked)
    for i, x in enumerate(asked):
        if x is None or x != x:
            assert got[i] is None
            continue
        k = bisect.bisect_right(xs, x)
        if k == 0:
            want = ends[0][1]
        elif k == len(xs) or xs[k - 1] == x:
            want = ends[k - 1][1]
        else:
            (a, u), (b, v) = ends[k - 1], ends[k]
            want = u + (x - a) / (b - a) * (v - u)
        assert abs(got[i] - want) < 1e-9


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([(None, 1.0, 1.0), (0.5, None, 1.0), (float("nan"), 1.0, 1.0), (0.5, 1.0, 0.0)], "x double, y double, w double")
    steps = isotonic.fit(empty, "x", "y", "w")
    assert steps.count() == 0
    assert [r.f for r in isotonic.apply(steps, empty.limit(2), "x", "f").collect()] == [None, None]


def test_pieces_are_even_and_ordered(spark):
    rows = [(rng,) for rng in [random.Random(1).random()] * 50] + [(0.5 + i / 1e6,) for i in range(3000)] + [(-float(i),) for i in range(100)]
    got = grouping.ordered_pieces(spark.createDataFrame(rows, "x double"), "x", "piece", 200).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.piece, []).append(r.x)
    assert len(got) == len(rows) and max(map(len, spans.values())) <= 500
    order = [spans[p] for p in sorted(spans)]
    assert all(max(a) <= min(b) for a, b in zip(order, order[1:]))
