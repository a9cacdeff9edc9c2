"""Stages of the pipeline against plain Python, on small fixtures with planted cases."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import WORD, distance, docs

import corpus_pipeline
from raceframe.llm import minhash, mixing, simhash
from raceframe.llm.common import prepare

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def shingles(text, width=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def first_of_classes(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {i for i, x in enumerate(label) if i == x}


def test_near_dedup_removes_planted_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, similar = ["", None, " \n", "one two", "One  two", "one three"], []
    for n in (60, 200, 1000):
        for k in range(12):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            copy = list(base)
            for _ in range(1 + n * k // 400):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
            a, b = map(shingles, texts[-2:])
            similar.append(len(a & b) / len(a | b))
    # A chain: the ends are below the bound, the middle links them.
    base = [word() for _ in range(100)]
    chain = [base, [*base[:90], *(word() for _ in range(10))]]
    chain.append([*(word() for _ in range(10)), *chain[1][10:]])
    texts += [" ".join(x) for x in chain]
    assert sum(0.8 <= s < 0.95 for s in similar) >= 8 and min(similar) < 0.8
    kept = {r.doc_id for r in STAGES["near_dedup"](spark, docs(spark, texts), None).collect()}
    assert kept == first_of_classes(texts)


def kept_lines(texts, near):
    """Texts without equal lines and, from 24 bytes on, lines ``near`` an earlier one."""
    seen, long, out = set(), set(), []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            bare = line.strip(" \r")
            if not bare or not (bare in seen or len(bare.encode()) >= 24 and any(near(bare, x) for x in long)):
                kept.append(line)
            seen.add(bare)
            long |= {bare} if len(bare.encode()) >= 24 else set()
        out.append(None if t is None else "\n".join(kept))
    return out


def stage_lines(spark, texts):
    return [r.text for r in STAGES["line_dedup"](spark, docs(spark, texts), None).orderBy("doc_id").collect()]


def test_line_dedup_removes_short_repeats(spark):
    rng = random.Random(4)
    pool = ["Les.", "é", "All rights reserved.", "x", "Les", "", "  ", "une ligne de vingt-trois"]
    texts = [None, ""] + ["\n".join([f"own {i}", *(rng.choice(["", " "]) + rng.choice(pool) + rng.choice(["", "\r"]) for _ in range(6))]) for i in range(30)]
    assert stage_lines(spark, texts) == kept_lines(texts, lambda a, b: False)


def test_line_dedup_counts_characters(spark):
    lines = [
        "L'été dernier nous sommes allés à la mer", "L'ete dernier nous sommes allés à la mer", "Eine schöne Idee für den nächsten Tag", "Eine schone Idee fur den nächsten Tag",
        "это очень длинная строка текста", "это очень длиннжая стфрока текста", "это очешь длинжая стфрока текста", "这是一个很长的中文句子用于测试", "这是一個很長的中文句子用于测试",
        "a smile 😀 and another 😀 in a line", "a smile 😁 and another 🙈 in a line", "a smile 😀 and another 😀 in one lane", "日本語の行はとても短いです",
    ]
    rng = random.Random(5)
    for line in lines[:9:2] * 6:
        s = list(line)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "ж", "語", "😀"])
        lines.append("".join(s))
    texts = ["\n".join(lines[k : k + 3]) for k in range(0, len(lines), 3)]
    assert stage_lines(spark, texts) == kept_lines(texts, lambda a, b: distance(a, b) <= 2)


def test_source_mix_meets_small_targets_with_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "block_tokens", lambda total: 4096)
    sizes = {"a": 600_000, "b": 500, "c": 1000, "d": 2000, "e": 5000, "f": 10_000, "g": 300_000}
    rows = [(k * 1000 + j, " ".join(["w"] * (n // 50)), s) for k, (s, n) in enumerate(sizes.items()) for j in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r for r in STAGES["source_mix"](spark, df, None).join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    for s, r in got.items():
        assert abs(r.taken - r.target) <= 40 + 0.03 * r.target, (s, r.taken, r.target)


def test_benchmark_free_removes_documents_that_hold_an_item(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (3, 8, 20, 40, 120)]
    spark.createDataFrame(list(enumerate([*items, "", None])), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [None, "", "a b", *items]
    for item in items:
        for share in (1, 0.9, 0.8, 0.6, 0.3):
            part = item.split()[: max(1, round(share * len(item.split())))]
            texts.append(" ".join([*(word() for _ in range(30)), *part, *(word() for _ in range(30))]).upper())
    texts += [" ".join(word() for _ in range(60)) for _ in range(5)]

    def held(text):
        words = WORD.findall((text or "").lower())
        for item in items:
            width = min(5, len(item.split()))
            own = shingles(item, width)
            if len(own & {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}) >= 0.8 * len(own) - 1e-9:
                return True
        return False

    kept = {r.doc_id for r in STAGES["benchmark_free"](spark, docs(spark, texts), str(tmp_path)).collect()}
    assert kept == {i for i, t in enumerate(texts) if not held(t)} and 10 < len(kept) < len(texts) - 10


# Repeated and null ids: a text is judged by itself, whatever its id


def repeated(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, n):
    return [rng.choice(["river", "stone", "cloud", "green", "seven", "north", "apple", "table", "quiet", "light"]) + str(rng.randrange(400)) for _ in range(n)]


def test_line_dedup_keeps_unique_lines_of_repeated_ids(spark):
    one, two = "a line that stands alone here", "another line of quite other words"
    rows = [(1, "first copy of the shared line"), (5, one), (5, f"first copy of the shared line\n{two}"), (None, "null and unique, line one"), (None, f"null too, this is line two\n{one}"), (5, one)]
    got = sorted(((r.doc_id, r.text) for r in STAGES["line_dedup"](spark, repeated(spark, rows), None).collect()), key=str)
    # The null id comes first, so its copy of ``one`` is the one that stays.
    want = [(1, "first copy of the shared line"), (5, ""), (5, two), (None, "null and unique, line one"), (None, f"null too, this is line two\n{one}"), (5, "")]
    assert got == sorted(want, key=str)


def test_near_dedup_keeps_unrelated_texts_of_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(prose(rng, 80)) for _ in range(4))
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (9, c), (4, d), (4, d), (None, b)]
    got = sorted(((r.doc_id, r.text) for r in STAGES["near_dedup"](spark, repeated(spark, rows), None).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (9, c), (4, d), (4, d)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(repeated(spark, rows)).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (9, c), (4, d), (4, d)], key=str)
    assert STAGES["near_dedup"](spark, repeated(spark, []), None).count() == 0


def open_links(df):
    """(nodes by id, links) of the prefix join with every node a class of its own, and how many pairs it verified."""
    found = minhash.nodes(df, "doc_id", "text", 5, 42)
    sets = minhash.shingle_sets(df.select(F.xxhash64("text").alias("t"), "text"), 5, 42)
    asked = []
    plain = minhash.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)

    minhash.verified = counted
    try:
        links = minhash.prefix_links(sets, found.select("node", F.col("node").alias("c")), found.select("node", "n", "t"), 0.8)
        return {r.id: r.node for r in found.collect()}, [(r.a, r.b) for r in links.collect()], sum(asked)
    finally:
        minhash.verified = plain


def joined(links, nodes):
    label = {n: n for n in nodes}
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {n: new if x == old else x for n, x in label.items()}
    return label


@pytest.mark.parametrize("own", [40, 18, 14, 4])
def test_shared_passage_costs_no_pair_per_pair_of_documents(spark, own):
    rng = random.Random(4)
    passage = prose(rng, 96)
    for n in (40, 80):
        df = repeated(spark, [(i, " ".join(prose(rng, own // 2) + passage + prose(rng, own - own // 2))) for i in range(n)])
        node, links, asked = open_links(df)
        similar = (96 - 4) / (96 - 4 + 2 * own) >= 0.8
        # Similar texts are one class before they come here, so only the others are counted.
        assert similar or asked <= 2 * n, (own, n, asked)
        assert len(set(joined(links, node.values()).values())) == (1 if similar else n)
        assert STAGES["near_dedup"](spark, df, None).count() == (1 if similar else n)


def test_prefix_join_loses_no_similar_pair(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(14):
        base, shared = prose(rng, 50), prose(rng, 12)
        for edits in (0, 1, 1, 2, 4):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(50)] = "other" + str(rng.randrange(99))
            texts.append(" ".join(words + shared))
    node, links, _ = open_links(repeated(spark, list(enumerate(texts))))
    plain = [shingles(t) for t in texts]
    similar = [(node[i], node[j]) for i in range(len(texts)) for j in range(i) if plain[i] != plain[j] and len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]
    assert len(similar) > 10 and joined(similar, node.values()) == joined(links, node.values())


def test_near_dedup_asks_the_fingerprints_and_settles_classes_without_idle_rounds(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    texts = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 400, 40)] + [" ".join(word() for _ in range(60)) for _ in range(8)] + ["", None]
    found, settled, pairs, components = [], [], minhash.print_pairs, minhash.connected_components
    monkeypatch.setattr(minhash, "print_pairs", lambda table: found.append(pairs(table)) or found[-1])
    monkeypatch.setattr(minhash, "connected_components", lambda edges: settled.append(1) or components(edges))
    kept = {r.doc_id for r in STAGES["near_dedup"](spark, docs(spark, texts), None).collect()}
    assert kept == first_of_classes(texts)
    # SimHash finds copies that differ in one word, and no pair of other texts.
    node = {r.id: r.node for r in minhash.nodes(docs(spark, texts), "doc_id", "text", 5, 42).collect()}
    copies = {node[k] for k in range(10)}
    asked = {(r.a, r.b) for r in found[0].collect()}
    assert asked and all(a < b and {a, b} <= copies for a, b in asked)
    assert len(settled) == 1
