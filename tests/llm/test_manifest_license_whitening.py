"""Merkle manifest, license scan and whitening: against brute force, and on nulls, empties, ties and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from raceframe.llm import licenses, merkle, queries, whitening
from raceframe.llm.common import prepare

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
CLASHES = ("id", "leaf", "pos", "tree", "block", "size", "nodes", "path", "root", "range", "row", "key", "places", "offset", "spans", "x", "index", "dim", "of", "c")


def clashing(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def stored(df, tmp_path, name):
    """The table as a folder of parquet files, for the registered query."""
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(leaves, arity=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + arity])) for k in range(0, len(levels[-1]), arity)])
    return levels


def plain_path(levels, at, arity=3):
    path = []
    for row in levels[:-1]:
        first = at // arity * arity
        run = row[first : first + arity]
        path.append((run[: at - first], run[at - first + 1 :]))
        at //= arity
    return path


def plain_manifest(rows):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0], plain_leaf(row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in order}
    levels = {s: plain_levels([x[1] for x in trees[s]]) for s in order}
    top = plain_levels([levels[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, (doc, leaf, row) in enumerate(trees[s]):
            path = plain_path(levels[s], at) + plain_path(top, place)
            changed = row
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            node = plain_leaf(changed)
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join("".join(before + after) for before, after in path))
            out.append((doc, leaf, levels[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_plain_hashing(spark, tmp_path, monkeypatch, height):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    rng = random.Random(height)
    rows = [(i, rng.choice(["a", "é", "日本", "b"]) if i % 3 else "hot", rng.choice([None, "en"]), rng.choice([None, 7]), rng.choice([None, "", "line\nline", "é\n\n" * 9, "x" * 5000])) for i in range(300)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, "\n"), (None, None, None, None, None), (5, "hot", "en", 1, "a\nb"), (5, "hot", "en", 1, "a\nb"), (-3, "", "en", 1, "z\n")]
    rows += [(1000, "alone", "en", 3, "a\nb")]
    df = clashing(spark.createDataFrame(rows, DOCS))
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verify(df, [*map(F.col, merkle.LEAF_COLUMNS[:-1]), text], height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x\n")]])
def test_manifest_of_few_rows(spark, tmp_path, rows):
    got = queries.QUERIES["op11_merkle_manifest"](spark, stored(spark.createDataFrame(rows, DOCS), tmp_path, "documents"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_layout_is_a_permutation_with_whole_subtrees_in_a_run():
    for arity, height in ((2, 5), (3, 4), (3, 6), (4, 3)):
        where = merkle.layout(height, arity)
        flat = sorted(int(a) for depth in where for a in depth)
        assert flat == list(range(len(flat))) and where[0][0] == 0
        upper = (height + 1) // 2
        for k in range(arity**upper):
            width = arity ** (height - upper)
            below = sorted(int(a) for depth in range(upper, height + 1) for a in where[depth][k * arity ** (depth - upper) : (k + 1) * arity ** (depth - upper)])
            assert below == list(range(below[0], below[0] + len(below))) and len(where[height][k * width : (k + 1) * width]) == width


def test_proofs_hold_every_sibling(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(20)]
    made = merkle.manifest(spark.createDataFrame(rows, DOCS), height=2)
    levels = plain_levels([plain_leaf(r) for r in rows])
    for row in merkle.proofs(made).collect():
        want = [("".join(a), "".join(b)) for a, b in plain_path(levels, row["pos"])]
        assert [(s.before, s.after) for s in row["path"]] == want and row["root"] == levels[-1][0]


# License scan

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_base(text):
    held = plain_words(text)
    hits = [(i, label) for label, phrase in PHRASES.items() for i in range(len(held)) if held[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return len(held), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places_equal_plain_search(spark, tmp_path):
    rng = random.Random(5)
    parts = ["under", "The", "MIT", "license", "apache", "License,", "version", "2", "2.0", "CC", "by", "nc", "CC BY-NC", "under the mit license", "é", "ключ", "\n", "Apache License, Version 2.0", "x" * 50]
    texts = [None, "", " ", "cc by", "cc-by-nc", "ccbync", "under the MIT\x00license", "cc by nc " * 4000, "word " * 30000 + "Cc By Nc"]
    texts += [rng.choice([" ", "-", ", "]).join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["released UNDER the mit license"] * 40
    rows = [(i, None, None, None, t) for i, t in enumerate(texts)] + [(3, None, None, None, "cc by nc"), (None, None, None, None, "cc by nc"), (None, None, None, None, None)]
    got = queries.QUERIES["op12_license_scan"](spark, stored(clashing(spark.createDataFrame(rows, DOCS)), tmp_path, "documents")).collect()
    told = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert told == sorted(((r[0], *plain_base(r[4])) for r in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1.0 or not r.n_base) and 0 <= r.score <= 1 for r in got)


def changed(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(1, len(words) - 1)
        step = rng.choice(["put", "leave", "swap"])
        words[k : k + (step != "put")] = ["other"] if step != "leave" else []
    return words


def test_changed_notices_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(11)
    filler = [f"w{k}" for k in range(500)]
    texts, wanted = [], []
    for notice in licenses.NOTICES:
        for edits in (0, 1):
            body = changed(plain_words(notice.text), rng, edits)
            before = rng.choices(filler, k=rng.randint(0, 60))
            texts.append(" ".join([*before, *body, *rng.choices(filler, k=30)]))
            wanted.append(notice.label)
    texts += [" ".join(rng.choices(filler, k=200)) for _ in range(20)] + ["this program is licensed software under the general terms of the public", "version 2 version 2 " * 500]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels = {r.doc_id: [s.label for s in r.spans] for r in rows}
    # A changed version number may fit the notice of a sister license equally well.
    family = lambda label: label.split("-")[0]
    assert all(label in labels[i] if i % 2 == 0 else family(label) in map(family, labels[i]) for i, label in enumerate(wanted))
    assert all(not labels[i] for i in range(len(wanted), len(texts)))


def test_alignment_equals_a_plain_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        n, start, stop = licenses.aligned(a, b)
        assert n == best[-1][-1] and stop - start >= n
        inner = licenses.aligned(a[start:stop], b)
        assert inner[0] == n


def test_scan_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.template_places([licenses.Template("x", "two words")], 3)


# Whitening


def plain_whitening(vectors, components=4):
    """Per vector: whole x; n, sums, eigenvalues and vectors of the distinct ones."""
    xs = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors]
    distinct = np.array(sorted(set(xs)), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    moved = distinct.astype(float) - (sums / n).astype(float)
    values, columns = np.linalg.eigh(moved.T @ moved / n)
    return xs, n, sums, values[::-1], columns[:, ::-1]


def test_whitening_equals_numpy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "VALUES", 96)
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    monkeypatch.setattr(whitening, "RANGE_ROWS", 50)
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(200, 6)) @ np.diag([3, 2, 1.5, 1, 0.2, 0.1])).tolist()
    good += [good[0]] * 150 + [[-0.0] * 6, [0.0] * 6]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(7, good[3], 0), (None, good[4], 0)]
    bad = [(900, None, 0), (901, [None, *good[0][1:]], 0), (902, [float("nan"), *good[0][1:]], 0), (903, [float("inf"), *good[0][1:]], 0), (904, [], 0), (905, [1.0], 0)]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int"))
    got = queries.QUERIES["op13_whitening"](spark, stored(df, tmp_path, "embeddings")).collect()
    xs, n, sums, values, columns = plain_whitening([r[1] for r in rows])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got)
    signs, want = {}, {}
    for (vec, _, _), x in zip(rows, xs, strict=True):
        z = (np.array(x, dtype=float) - (sums / n).astype(float)) @ columns[:, :4] / np.sqrt(values[:4])
        for k in range(4):
            want.setdefault((vec, k + 1), []).append((z[k], int(((n * np.array(x, dtype=object) - sums) ** 2).sum())))
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        options = want[r.vec_id, r.component]
        fit = [(z, d) for z, d in options if d == r.deviation and abs(abs(z) - abs(r.whitened)) < 1e-8]
        assert fit
        if abs(r.whitened) > 1e-3 and len({z > 0 for z, _ in fit}) == 1:
            assert signs.setdefault(r.component, fit[0][0] * r.whitened > 0) == (fit[0][0] * r.whitened > 0)


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    equal = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(equal) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in equal)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert {(r.component, r.explained, None if r.whitened is None else round(abs(r.whitened), 9)) for r in line} == {(1, 1.0, 1.0), (2, 0.0, None)}
    assert all(r.identity_error < 1e-12 for r in line)


def test_large_components_stay_exact(spark):
    rows = [(1, [3.0e9, 1.0]), (2, [-3.0e9, 2.0]), (3, [0.0, 5.0])]
    xs, n, sums, _, _ = plain_whitening([r[1] for r in rows])
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for (vec, _), x in zip(rows, xs, strict=True):
        want = int(((n * np.array(x, dtype=object) - sums) ** 2).sum())
        assert got[vec] == (want if want < 1 << 63 else None)
