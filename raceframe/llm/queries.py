"""One query per operator over the supplied tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceframe.llm import decontaminate, language, licenses, lines, merkle, mixing, pii, simhash, topk, url_filter, warc, whitening, windows
from raceframe.llm.common import prepare, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the pattern spans, and all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)
    counts = [F.size(F.filter(base.kind, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS[:4]]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


@query("op2_topk", """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v q JOIN v ON q.row <> v.row AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0
)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_line_dedup", """
WITH l AS (
  SELECT doc_id, no - 1 AS no, trim(x, ' ' || chr(13)) AS line FROM (
    SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), f AS (
  SELECT line, length(line) AS n, min(ROW(doc_id, no)) AS first FROM l WHERE line <> '' GROUP BY line
), w AS (
  SELECT * FROM f WHERE strlen(line) >= 24
), k AS (
  SELECT line, n, first, i, n // 3 * i + greatest(n % 3 - (3 - i), 0) + 1 AS pos, n // 3 + CASE WHEN n % 3 >= 3 - i THEN 1 ELSE 0 END AS size
  FROM w, (SELECT unnest([0, 1, 2]) AS i)
), g AS (
  SELECT line, n, first, n AS own, i, substr(line, pos, size) AS piece FROM k
), p AS (
  SELECT w.line, w.n, w.first, k.n AS own, k.i, substr(w.line, k.pos + s, k.size) AS piece
  FROM w JOIN (SELECT DISTINCT n, i, pos, size FROM k) k ON w.n - k.n BETWEEN 0 AND 2, (SELECT unnest([-2, -1, 0, 1, 2]) AS s) WHERE k.pos + s >= 1
), near AS (
  SELECT DISTINCT g.line AS a, p.line AS b, g.first AS fa, p.first AS fb FROM g JOIN p USING (own, i, piece) WHERE g.line <> p.line
), late AS (
  SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS line FROM near WHERE levenshtein(a, b) <= 2
), gone AS (
  SELECT doc_id, no FROM l JOIN f USING (line) WHERE ROW(doc_id, no) <> first OR line IN (SELECT line FROM late)
)
SELECT doc_id, coalesce(count(no), 0) AS n_removed, coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no), '') AS removed
FROM documents LEFT JOIN gone USING (doc_id) GROUP BY doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go from every document: repeats of any earlier line, and near repeats from 24 bytes on."""
    return lines.removed_lines(table(spark, sf_dir, "documents"), exact_bytes=1)


@query("op4_decontaminate", r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), s AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS width, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), n AS (
  SELECT item_id, count(*) AS size FROM s GROUP BY item_id
), d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[k:k + width - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, (SELECT DISTINCT width FROM s) WHERE len(w) >= width)
)
SELECT doc_id, item_id, count(*) AS shared, size, count(*) / size AS containment
FROM t JOIN s USING (width, shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, size HAVING count(*) >= size * 0.8 - 1e-9
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds 80 % or more."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_warc_zstd", """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first_id FROM p
), bits AS (
  SELECT *, [CAST(instr('0123456789abcdef', substr(hex, i, 1)) - 1 AS INTEGER) FOR i IN range(1, 41)] AS n FROM d
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    CASE (5 * k) % 4
      WHEN 0 THEN n[5 * k // 4 + 1] * 2 + (n[5 * k // 4 + 2] // 8)
      WHEN 1 THEN (n[5 * k // 4 + 1] % 8) * 4 + (n[5 * k // 4 + 2] // 4)
      WHEN 2 THEN (n[5 * k // 4 + 1] % 4) * 8 + (n[5 * k // 4 + 2] // 2)
      ELSE (n[5 * k // 4 + 1] % 2) * 16 + n[5 * k // 4 + 2] END AS INTEGER), 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM bits
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to dictionary-compressed WARC archives and read them back."""
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    rows = warc.read_warc(spark, path)
    fine = F.when(F.col("error").isNull(), F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.col("error"))))
    return rows.select(
        F.when(fine != "", fine).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


# The rules of the URL query, and the words in a host that put its URLs on the list.
RULES = [
    url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]
LISTED_HOSTS = "casino|spam|poker|adult"


@query("op6_url_filter", r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS asked
  FROM p
), k AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS key
  FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM k
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN key <> '' AND key IN (SELECT key FROM k WHERE regexp_matches(host, 'casino|spam|poker|adult')) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the list holds the URLs of hosts with a listed word."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(url_filter.host(F.col("url")).rlike(LISTED_HOSTS))
    return url_filter.judge_urls(pages, RULES, listed).drop("url")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text when 50-byte repeats of earlier documents go."""
    return windows.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op8_language_crf")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents")).drop("shares")


@query("op9_source_mix", r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM src
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after FROM w
), c AS (
  SELECT *, cap / weight * weight_after <= total - capped_before AS capped FROM r
), t AS (
  SELECT source, source_size, place, least(CASE WHEN capped THEN cap ELSE
    (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (sum(weight) FILTER (NOT capped) OVER ()) * weight END, cap) AS target FROM c
), k AS (
  SELECT *, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) // source_size AS passes, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) % source_size AS rest
  FROM t WHERE source_size > 0
), stream AS (
  SELECT doc_id, size, passes, rest, coalesce(sum(size) OVER (PARTITION BY place ORDER BY shuffle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source WHERE size > 0
), taken AS (
  SELECT doc_id, passes * size + greatest(least(begin + size, rest) - begin, 0) AS taken FROM stream
)
SELECT s.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def _crc32(text: Column) -> Column:
    return F.crc32(text.cast("string").cast("binary"))


@query("op11_merkle_manifest", r"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS row, list_reduce(list_prepend(4294967295, CAST(range(0, 8 * strlen(CAST(doc_id AS VARCHAR))) AS BIGINT[])),
    lambda a, k: xor(CASE WHEN k % 8 = 0 THEN xor(a, CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE a END >> 1,
      CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(a, CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE a END) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), shown AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM d
), fields AS (
  SELECT doc_id, source, row, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(changed) || ':' || changed, '-') AS changed_tail FROM shown
), hashed AS (
  SELECT doc_id, source, row, sha256(head || tail) AS leaf, sha256(head || changed_tail) AS changed FROM fields
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), inner_nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM inner_nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n
), subroots AS (
  SELECT tree, digest AS subroot, level AS height FROM inner_nodes WHERE n = 1
), outer_nodes AS (
  SELECT 0 AS level, tree - 1 AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM outer_nodes WHERE n > 1 GROUP BY level, pos // 3, n
), nodes AS (
  SELECT tree, level, pos, digest, n FROM inner_nodes WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + o.level, o.pos, o.digest, o.n FROM outer_nodes o, subroots s
), steps AS (
  SELECT l.row, s.height + o.level AS level, (l.tree - 1) // (3 ** o.level)::BIGINT AS pos FROM leaves l JOIN subroots s USING (tree), (SELECT DISTINCT level FROM outer_nodes WHERE n > 1) o
  UNION ALL
  SELECT l.row, i.level, l.pos // (3 ** i.level)::BIGINT FROM leaves l JOIN (SELECT DISTINCT tree, level FROM inner_nodes WHERE n > 1) i USING (tree)
), runs AS (
  SELECT l.row, s.level, string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < s.pos) AS before, string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > s.pos) AS after
  FROM steps s JOIN leaves l USING (row) JOIN nodes n ON n.tree = l.tree AND n.level = s.level AND n.pos // 3 = s.pos // 3 GROUP BY l.row, s.level
), told AS (
  SELECT row, list([coalesce(before, ''), coalesce(after, '')] ORDER BY level) AS path FROM runs GROUP BY row
), folded AS (
  SELECT l.*, coalesce(path, []) AS path, list_reduce(list_prepend([changed], coalesce(path, [])), lambda node, step: [sha256(step[1] || node[1] || step[2])])[1] AS folded_root
  FROM leaves l LEFT JOIN told USING (row)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[1] || s[2]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), (SELECT digest AS root FROM outer_nodes WHERE n = 1)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; every second one has lost its line ends."""
    text = F.when(_crc32(F.col("doc_id")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(table(spark, sf_dir, "documents"), [*map(F.col, merkle.LEAF_COLUMNS[:-1]), text])


@query("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    labels = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base.start).alias("first_word"), F.array_max(base.start).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.cover)), F.lit(0.0)).alias("score"),
    )


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
