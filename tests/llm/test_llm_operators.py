"""Corpus operators on small fixtures: against brute force, and on nulls, empties, ties and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from raceframe.llm import decontaminate, language, lines, mixing, pii, simhash, topk, url_filter, warc, windows
from raceframe.llm.common import connected_components, prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    """Rows with the given texts and every clashing name an operator could use inside."""
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "h", "h2", "no", "line", "n", "key", "size", "bucket", "block", "fp", "doc", "shuffle", "row", "spans", "kept"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


# Personal data


def plain_spans(text):
    luhn = lambda d: sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (309) 555-1438",
             "+49 30 1234567", "é", " ", ".", "-", "12", "+", "\n", "4111-1111-1111-1111 4111", "a@b", "a@b.c@d.e", "%", "1.2.3", "(", "00000000000000"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 50_000):
        pii.base_spans(text)


def test_semi_markov_model_finds_held_out_entities():
    model, rng = pii.train(), np.random.default_rng(1234)
    right = found = there = 0
    for _ in range(150):
        text, gold = pii.labelled_text(rng)
        got = set(model.decode(text, [m.span() for m in pii.TOKEN.finditer(text)]))
        right, found, there = right + len(got & set(gold)), found + len(got), there + len(gold)
    assert right / found > 0.95 and right / there > 0.95


def test_pii_rows(spark):
    texts = [None, "", "mail a@b.cc or 1.2.3.4", "version 2.0 of page 12", "password=e3f9af929f606539e9 of", "write to joe at mail dot example dot com now 1"]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, texts)).collect()}
    assert [s.kind for s in got[2]] == ["email", "ip"] and all(s.base for s in got[2])
    assert got[0] == got[1] == got[3] == []
    assert [(s.kind, s.base) for s in got[4]] == [("secret", False)]
    assert pii.find_pii(empty(spark)).count() == 0


# Top k


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k_against_sorting(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(40)]
    rows += [(100, None), (101, [float("nan")] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("inf")] * 4), (104, [1.0, 2.0]), (None, [0.0] * 4), (3, rows[3][1]), (5, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("q", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=k).collect())
    want = []
    # Rows that repeat an id are rows of their own: both sides of the search hold them.
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows[:40] + rows[-2:]]
    for n, (q, own) in enumerate(whole):
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(whole) if m != n)[:k]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_keeps_rows_of_one_id_and_scores_apart(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (0, [3.0]), (1, [float(1 << 45)]), (2, [float(1 << 45) + 1]), (50, [float(1 << 0)])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 50, k=9).orderBy("rank").collect()
    assert [(r.vec_id, r.score >> 16) for r in got] == [(2, (1 << 45) + 1), (1, 1 << 45), (0, 3), (0, 2), (0, 1)]
    # 3 * 2^60 is past the former end of the scores, and one more is told from it.
    big = spark.createDataFrame([(0, [3.0 * (1 << 22), 1 / 256]), (1, [float(1 << 22), 0.0]), (2, [float(1 << 22), 1 / 256])], "vec_id long, embedding array<double>")
    got = topk.top_k(big, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, (3 << 60) + 1), (1, 3 << 60)]


def test_top_k_large_values_and_nothing(spark):
    df = spark.createDataFrame([(0, [3e15, 1.0]), (1, [3e15, 2.0]), (2, [3e15, 3.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, k=1).collect()
    assert len(got) == 1 and got[0].score == topk.LIMIT and got[0].vec_id == 1
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


# Lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup_against_all_pairs(spark, edits):
    rng = random.Random(edits)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randint(10, 30))) for _ in range(12)]
    pool += ["the quick brown fox number %d jumps" % k for k in range(8)]

    def varied():
        s = list(rng.choice(pool))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(s)

    texts = [None, "", "short\n\r\n"] + ["\n".join([*(varied() for _ in range(rng.randint(0, 4))), "  " + rng.choice(pool) + "\r"]) for _ in range(40)]
    seen, want = [], set()
    for i, t in enumerate(texts):
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            raw = line.strip(" \r").encode()
            if len(raw) >= 12:
                if any(distance(raw, other) <= edits for other in seen):
                    want.add((i, no))
                seen.append(raw)
    got = {(r.id, r.no) for r in lines.duplicate_lines(docs(spark, texts), edits=edits, min_bytes=12).collect()}
    assert got == want


def test_edit_distance_is_exact_up_to_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for edits in (1, 2, 4):
        near = df.filter(F.length("a") - F.length("b") <= edits)
        assert near.filter(lines.edit_distance(F.col("a"), F.col("b"), edits) != F.least("d", F.lit(edits + 1))).count() == 0


def test_dedup_lines_keeps_columns(spark):
    text = "a line that is long enough to count\nother"
    df = docs(spark, [text, text, None, "x"])
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [text, "other", None, "x"]
    assert lines.dedup_lines(empty(spark)).count() == 0 and lines.removed_lines(empty(spark)).count() == 0


# Contamination


def test_containment_against_sets(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % k for k in range(30)] + ["Ä", "B,"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 3, 4, 5, 6, 9, 20, 40)] + [None, "", "  "]
    texts = [None, ""]
    for _ in range(40):
        p = (rng.choice(passages) or "").split()
        if len(p) > 6 and rng.random() < 0.5:
            p[rng.randrange(len(p))] = "changed"
        texts.append("\n".join([" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), " ".join(p).upper().replace("Ä", "Ä"), "end"]))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text, n):
        w = WORD.findall((text or "").translate(lower))
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for j, p in enumerate(passages):
        n = min(5, len(WORD.findall(p or "")))
        own = shingles(p, n) if n else set()
        for i, t in enumerate(texts):
            both = len(own & shingles(t, n)) if own else 0
            if own and both >= 0.8 * len(own) - 1e-9:
                want[i, j] = (both, len(own))
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("hash", F.lit("x"))
    got = {(r.doc_id, r.item_id): (r.shared, r.size) for r in decontaminate.contained_items(docs(spark, texts), items).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.remove_contaminated(docs(spark, texts), items).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.contained_items(docs(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.contained_items(empty(spark), items).count() == 0


# Archives


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/%0A\r\nx", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "u", "same"), (7, "u", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("digest", F.lit("x"))
    path = str(tmp_path / "archives")
    warc.write_warc(df, path, records_per_archive=2)
    got = warc.read_warc(spark, path).collect()
    assert not [r.error for r in got if r.error]
    assert sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted([
        ("1", "response", None, 4), ("2", "revisit", "1", 4), ("3", "response", None, 0), ("4", "revisit", "3", 0), ("5", "response", None, 10000),
        ("5", "response", None, 10000), ("", "response", None, 4), ("7", "response", None, 5)])
    assert {r.record_id: r.target_uri for r in got}["1"] == "http://a/%0A\r\nx"
    assert all(bytes(r.payload) == ("é" * 5000).encode() for r in got if r.record_id == "5")
    # Other readers see plain frames after the dictionary.
    for file in (tmp_path / "archives").glob("part-*"):
        data = file.read_bytes()
        if data:
            assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    warc.write_warc(df.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives_say_so():
    dictionary = warc.train_dictionary([b"<html>%d</html>" % k for k in range(50)], 1024)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    record = warc.build_record("9", "u", "2024-01-01T00:00:00Z", b"hello", None)
    head = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    good = head + warc.SPACER.encode() + pack.compress(record) + warc.SPACER.encode()
    assert [r["payload"] for r in warc.read_archive(good)] == [b"hello"]
    bad = [
        good[:-20], good + b"junk", head + pack.compress(record.replace(b"Content-Length: ", b"Content-Length: 1", 1)), head + pack.compress(record.replace(b"hello", b"jello")),
        head + pack.compress(record.replace(b"WARC/1.1", b"WARC/9.9")), head + pack.compress(record.replace(b"WARC-Date", b"X-Date")), head[:10],
    ]
    for content in bad:
        assert any(r["error"] for r in warc.read_archive(content)), content[:20]
    assert list(warc.read_archive(b"")) == []


# URLs


def test_url_verdicts(spark):
    urls = ["https://X.Example.ORG/es/1", "http://example.org/en/12?q", "http://org/", "http://norg/", "http://a.com/fr/x", "http://a.com/de", None, "", "no scheme",
            "http://www.listed.net/a/?utm_source=1&b=2&a=1#x", "https://listed.net:443/a?a=1&b=2", "http://listed.net/a?a=1", "http://org", "http://u://v/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("block", F.lit(1))
    listed = spark.createDataFrame([("http://listed.net/a?b=2&a=1",), (None,), ("",)], "url string")
    rules = [url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(rows, rules, listed).collect()}
    assert got == {
        0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: ("com/fr/", "allow"), 5: (None, "allow"),
        6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "block"), 11: (None, "allow"), 12: (None, "allow"), 13: (None, "allow"),
    }
    assert url_filter.judge_urls(rows.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(rows, [], listed.limit(0)).collect()} == {"allow"}


# Repeated windows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_all_windows(spark, seed, monkeypatch):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 120))) for _ in range(10)] + ["a" * 300, "ab" * 90, " "]
    texts = [None, "", "a" * 49, "a" * 50] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(50)]
    df = docs(spark, texts).unionByName(docs(spark, ["a" * 60]).withColumn("doc_id", F.lit(None).cast("long")))
    first: dict = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    monkeypatch.setattr(windows, "BUCKET", 1 << 10)
    monkeypatch.setattr(windows, "PIECE", 200)
    monkeypatch.setattr(windows, "BATCH", 1 << 10)
    got = {r.doc_id: r for r in windows.remove_repeats(df).collect()}
    assert got[None].n_removed == 0 and got[None].n_bytes == 60
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        r = got[i]
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (kept, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert windows.remove_repeats(empty(spark)).count() == 0


# Language


def test_posteriors_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    rows = np.array([0, 0, 0, 0, 0, 1, 1])
    got = language.posteriors(scores, moves, rows, 2)
    for chain in (0, 1):
        at = np.flatnonzero(rows == chain)
        total = np.zeros((len(at), 3))
        for path in np.ndindex(*[3] * len(at)):
            weight = sum(scores[i, y] for i, y in zip(at, path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            weight = np.exp(weight) * np.exp(moves[:, path[0]]).sum()
            for t, y in enumerate(path):
                total[t, y] += weight
        assert np.allclose(got[at], total / total.sum(axis=1, keepdims=True))


def test_language_of_code_switched_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.97 * got.count()


def test_language_edges(spark):
    texts = [None, "", "12 34 ...", "the and the house", "— … € « » ·", "日本"] + ["the and of house water"] * 9 + ["der und die haus wasser"] * 9
    df = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 15, "en").otherwise("de"))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(texts)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 4))
    assert all(r.lang_pred != "und" and r.score > 0 for r in language.identify(docs(spark, ["µ", "12 ª", "º.", "日"] + texts[6:]).withColumn("lang", F.when(F.col("doc_id") < 13, "en").otherwise("de"))).collect())
    assert got[6].lang_pred == "en" and got[20].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(empty(spark)).count() == 0
    assert language.keep_identified(df).columns == df.columns


# Mix


def test_mix_targets_and_limits(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), f"s{min(int(rng.expovariate(0.7)), 4)}") for i in range(400)] + [(400, None, "s0"), (401, "a b", None), (None, "c d e", None), (5, "x y", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("place", F.lit(1))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size)
    assert sorted(map(tuple, sorted(got, key=key)), key=str) == sorted(map(tuple, sorted(again, key=key)), key=str)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    of = {}
    for (i, t, s), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").split()))), sorted(got, key=key)):
        of.setdefault(s, []).append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in of.items()}
    order = sorted([s for s in of if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s, rs in of.items():
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= 1
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, ["", None])).collect()] == [0, 0]


@pytest.mark.parametrize("block", [16, 4096])
def test_small_sources_get_their_target(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "block_tokens", lambda total: block)
    texts = [("a b c", f"s{k:02}") for k in range(30)] + [(" ".join(["w"] * 100), "t")] * 100 + [("x " * 700, "u")] * 3
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    of = {}
    rows = mixing.mix(df).collect()
    for r, (_, s) in zip(sorted(rows), texts):
        of.setdefault(s, []).append(r)
    assert len(rows) == len(texts) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5 for rs in of.values())
    assert sum(sum(r.taken for r in of[f"s{k:02}"]) for k in range(30)) >= 150


def test_schedule_gives_every_source_its_slots_in_turn(spark):
    counted = spark.createDataFrame([(1, 640, 16, 40, 1, 100, 47), (2, 3, 16, 1, 2, 0, 2), (3, 160, 16, 10, 0, 16, 1)], "place int, source_size long, own long, blocks long, passes long, rest long, slots long")
    got = mixing.schedule(counted).orderBy("slot").collect()
    ranks = {p: [r["rank"] for r in got if r.place == p] for p in (1, 2, 3)}
    assert ranks == {1: list(range(47)), 2: [0, 1], 3: [0]}
    assert sorted((r.place, r.block, r.part) for r in got if r.part is not None) == [(1, 6, 4), (3, 0, 16)]


# SimHash


def test_simhash_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = ["W%d" % k for k in range(200)] + ["É"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 120))] for _ in range(25)]
    texts = [None, "", " \n"]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append("\n ".join(w))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        values = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)))
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    least[i] = min(least[i], least[j])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", least[i]) for i, p in enumerate(prints)}
    assert {r.doc_id for r in simhash.keep_first(docs(spark, texts)).collect()} == {i for i, x in enumerate(least) if x == i}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_segments_follow_the_cost():
    probes = lambda count: sum(len(simhash.ball(bits, radius)) for _, bits, radius in simhash.segments(count, 4))
    assert [len(simhash.segments(1 << k, 4)) for k in (18, 22, 24, 28)] == [3, 3, 3, 2]
    assert probes(1 << 22) == probes(1 << 24) == 45


@pytest.mark.parametrize("count", [10, 10**4, 10**7, 10**12])
def test_segments_cover_every_pair(count):
    for distance in range(1, 7):
        cuts = simhash.segments(count, distance)
        assert sum(r + 1 for _, _, r in cuts) > distance
        rng = random.Random(distance)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), distance))
            assert any((flips >> a & ((1 << n) - 1)).bit_count() <= r for a, n, r in cuts)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (-5, 300), (300, -5), (300, -7)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {-5: -7, 300: -7, -7: -7}
    assert got == want
