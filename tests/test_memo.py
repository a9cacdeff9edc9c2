"""Memo rules against plain search: many rules, keywords inside keywords, long texts, odd characters, chips."""

import random

import pytest

from raceframe.operators import memo


def plain(texts, rules, wording):
    """(doc, rule, position, negated, intensity) by one search per rule."""
    out = []
    for doc, text in texts:
        text = (text or "").strip(" \t\n\r\f\v　")
        for i, r in enumerate(rules):
            at = text.find(r.keyword)
            while at >= 0:
                before, after = text[max(0, at - 5) : at], text[at + len(r.keyword) :][:8]
                no = r.negatable and (
                    any(after[:6].startswith(w) or w in after[:5] for w in wording.after) or any(before.endswith(w) for w in wording.before)
                    or any(w in after for w in wording.doubt)
                )
                weight = next((m for m, ws in wording.intensity.items() for w in ws if before.endswith(w)), 1.0) if r.weighed else 1.0
                out.append((doc, i, at, no, weight))
                at = text.find(r.keyword, at + len(r.keyword)) if r.every else -1
    return sorted(out)


WORDING = memo.Wording(after=["no"], before=["un"], doubt=["??"], intensity={1.5: ["very "], 0.5: ["a "]})


def test_matches_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(memo, "STRETCH", 50)
    rng = random.Random(9)
    letters = "ab内伸😀é\\E$1(?."
    rules = [memo.Rule("c", str(i % 5), "".join(rng.choice(letters) for _ in range(rng.randint(1, 5))), every=rng.random() < 0.7, negatable=rng.random() < 0.8) for i in range(60)]
    rules += [memo.Rule("c", "x", "aa"), memo.Rule("c", "x", "aba"), memo.Rule("c", "y", "ab"), memo.Rule("c", "z", "abab"), memo.Rule("c", "q", "\\E"), memo.Rule("c", "w", "ab", False)]
    texts = [(0, None), (1, ""), (2, " 　\n"), (3, "a" * 300), (4, "ab" * 200), (5, "aba" * 90), (6, "﷐ab﷑﷐"), (7, "very ab a abno unab??")]
    texts += [(8 + i, "".join(rng.choice([*letters, "no", "un", "very ", "a ", "??"]) for _ in range(rng.randint(1, 160)))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc long, body string")
    got = memo.matches(df, "doc", "body", rules, WORDING).collect()
    assert sorted((r.doc, r.rule, r.position, r.is_negated, r.intensity) for r in got) == plain(texts, rules, WORDING)
    assert all(r.keyword == rules[r.rule].keyword and r.value == rules[r.rule].value for r in got)


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([(1, "w7 w13")], "doc long, body string")
    steps = {}
    for n in (5, 500):
        found = memo.matches(df, "doc", "body", [memo.Rule("c", "v", f"w{i}") for i in range(n)], WORDING)
        tree = found._jdf.queryExecution().optimizedPlan()
        steps[n] = (tree.toString().count("\n"), tree.expressions().size())
    assert steps[5] == steps[500]
    assert sorted((r.keyword, r.position) for r in found.collect()) == [("w1", 3), ("w13", 3), ("w7", 0)]


def test_documents_may_have_several_keys(spark):
    df = spark.createDataFrame([(1, 1000, "up"), (2, 0, "up"), (2, None, "up")], "conv long, turn long, body string")
    got = memo.matches(df, ["conv", "turn"], "body", [memo.Rule("c", "v", "up")]).collect()
    assert {(r.conv, r.turn) for r in got} == {(1, 1000), (2, 0), (2, None)}


def test_chips_carry_payload_flags_and_reasons(spark):
    rules = [
        memo.Rule("pace", "H", "fast", "high pace", reason="said fast"), memo.Rule("pedigree", "power", "sire", "pedigree", False, needs_feature=True),
        memo.Rule("frame_hint", "inner", "rail", "rail", False, is_warning=True, warning="not a bias"), memo.Rule("misc_tag", "weak", "tired", "", False, polarity="negative"),
    ]
    texts = [(1, "fast sire by the rail, tired"), (2, "unfast, untired")]
    found = memo.matches(spark.createDataFrame(texts, "doc long, body string"), "doc", "body", rules, WORDING)
    assert {(r.doc, r.value, r.polarity) for r in found.collect() if r.category == "misc_tag"} == {(1, "weak", "negative"), (2, "weak", "positive")}
    got = {(r.doc, r.chip): r for r in memo.chips(found, "doc", rules).collect()}
    assert got[1, "pace.H"].payload == {"pace": "H"} and got[1, "pace.H"].reason == "said fast"
    assert got[1, "pedigree.power"].needs_feature and got[1, "pedigree.power"].payload == {}
    assert got[1, "frame_hint.inner"].is_warning and got[1, "frame_hint.inner"].warning == "not a bias"
    assert got[1, "misc_tag.weak"].label == "misc_tag.weak"
    no = got[2, "negated.pace.H"]
    assert (no.label, no.kind, no.payload, no.is_warning, no.reason) == ("ハイペース否定", "negation", {}, True, "「fast」が否定されています")


def test_keywords_must_be_searchable():
    with pytest.raises(ValueError):
        memo.Rule("c", "v", "")
