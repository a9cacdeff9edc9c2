"""What is broadcast, and what travels beside the keys of lines."""

from pyspark.sql import functions as F

from raceframe.llm import lines, simhash
from raceframe.llm.common import prepare, written


def test_probes_are_never_broadcast(spark):
    table = prepare(spark).range(2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(table, 4, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def joined_types(plan):
    children = plan.children()
    children = [children.apply(i) for i in range(children.size())]
    own = [c.output().apply(i).dataType().typeName() for c in children for i in range(c.output().size())] if plan.nodeName() == "Join" else []
    return own + [t for c in children for t in joined_types(c)]


def test_line_keys_go_segment_by_segment_without_the_lines(spark, monkeypatch):
    long = "the quick brown fox jumps over the lazy dog"
    texts = [("a", f"{long}\nshort\n{long}!"), ("b", f"another line that is long enough\n{long[1:]}\nshort"), ("c", "nothing like the others in here, at all"), (None, None), ("d", f"{long}\nx")]
    docs = prepare(spark).createDataFrame(texts, "doc_id string, text string")
    found = []

    def seen(df, name, **options):
        found.append((name, joined_types(df._jdf.queryExecution().optimizedPlan())))
        return written(df, name, **options)

    monkeypatch.setattr(lines, "written", seen)
    out = sorted(map(tuple, lines.removed_lines(docs, exact_bytes=1).collect()), key=str)
    assert out == [("a", 1, "2"), ("b", 2, "1,2"), ("c", 0, ""), ("d", 1, "0"), (None, 0, "")]
    assert [name for name, _ in found].count("keys") == 3
    assert {t for name, types in found if name == "known" for t in types} == {"long"}
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, lines.removed_lines(docs, exact_bytes=1).collect()), key=str) == out


def test_texts_stay_where_only_numbers_of_lines_are_wanted(spark):
    docs = prepare(spark).createDataFrame([("a", "one line of some length, twice\none line of some length, twice"), ("b", None)], "doc_id string, text string")
    out = lines.removed_lines(docs, exact_bytes=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Join LeftOuter")[0] and "xxhash64(" not in plan[plan.index("Join LeftOuter") :].splitlines()[0]
    assert sorted(map(tuple, out.collect())) == [("a", 1, "1"), ("b", 0, "")]
