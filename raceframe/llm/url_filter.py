"""URL verdicts: rules by host and path, then a list behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4
# Filters of at most this many blocks (48 bytes each as rows) are broadcast; larger ones are joined by shuffle.
BROADCAST_BLOCKS = 1 << 18
BITS_PER_URL = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: query parameters that do not change what a URL shows.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling per page: no scheme, default port, ``www.``, trailing slash, fragment or
    tracking parameter; the other parameters sorted.  Without ``://``: empty."""
    name = F.regexp_replace(F.regexp_replace(host(url), ":(80|443)$", ""), "^www\\.", "")
    asked = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.coalesce(F.concat(name, F.regexp_replace(path(url), "/+$", ""), query), F.lit(""))


def by_rule(host: Column, path: Column, rules: Sequence[Rule], values: Sequence[str]) -> Column:
    """The value of the first of the rules, sorted longest first, that fits; else null."""
    found = F.lit(None).cast("string")
    for rule, value in reversed(list(zip(rules, values, strict=True))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value)).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _lanes(key: Column) -> list[Column]:
    """Two bits in each of the four 64-bit lanes of a block."""
    h = F.xxhash64(key, F.lit("lanes"))

    def bit(k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(63).cast("int"))

    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)).alias(f"lane{k}") for k in range(LANES)]


def judge_urls(urls: DataFrame, rules: Sequence[Rule], listed: DataFrame, *, url: str = "url", listed_url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to rows with a ``url``.

    A fitting rule decides, the longest first.  Other URLs are blocked if their canonical
    form is that of a listed one.  The list becomes a blocked Bloom filter: 256-bit blocks,
    built by ``bit_or`` per block.  URLs the filter does not pass are allowed at once; the
    possible hits go to an exact join with the list, which removes the false positives.
    Null urls and urls without ``://`` have an empty host and path and are never listed.
    Repeated rows stay; columns named like the new ones are replaced.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    others = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    names = F.col("__host"), F.col("__path")
    rows = urls.select(*others, host(F.col(url)).alias("__host"), path(F.col(url)).alias("__path"), canonical(F.col(url)).alias("__key")).select(
        *others, "__host", "__path", "__key", by_rule(*names, ranked, [r.text for r in ranked]).alias("__rule"),
        by_rule(*names, ranked, [r.verdict for r in ranked]).alias("__verdict"),
    )
    keys = listed.select(canonical(F.col(listed_url)).alias("__key")).filter("__key <> ''").distinct()
    count = keys.count()
    # A power of two of blocks, from the size of the list.
    blocks = 1 << max(0, (count * BITS_PER_URL // 256).bit_length())
    table = keys.select(_block(F.col("__key"), blocks), *_lanes(F.col("__key"))).groupBy("block").agg(
        *[F.bit_or(f"lane{k}").alias(f"filter{k}") for k in range(LANES)]
    )
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    asked = rows.filter(F.col("__verdict").isNull())
    probe = _lanes(F.col("__key"))
    passed = F.lit(True)
    for k in range(LANES):
        passed = passed & (F.col(f"filter{k}").bitwiseAND(probe[k]) == probe[k])
    probed = asked.withColumn("block", _block(F.col("__key"), blocks)).join(table, "block", "left").withColumn("__maybe", F.coalesce(passed, F.lit(False)))
    names = rows.columns
    exact = probed.filter("__maybe").select(*names).join(keys.withColumn("__listed", F.lit("block")), "__key", "left")
    done = [
        rows.filter(F.col("__verdict").isNotNull()),
        probed.filter("not __maybe").select(*names).withColumn("__verdict", F.lit("allow")),
        exact.withColumn("__verdict", F.coalesce("__listed", F.lit("allow"))).select(*names),
    ]
    out = done[0].unionByName(done[1]).unionByName(done[2])
    return out.select(*others, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
