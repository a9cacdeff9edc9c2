"""Near-duplicate lines by a segment-partition edit join, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceframe.llm.common import prepare, written

# Key tables of at most this many rows (8 bytes each) are broadcast.
BROADCAST_KEYS = 1 << 19
# Letters counted in the signature, 16 four-bit counts per long.
COUNTED = ["abcdefghijklmnop", "qrstuvwxyz .,-01"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(docs: DataFrame, id: str, text: str, min_bytes: int) -> DataFrame:
    """(id, doc, no, line): lines of at least ``min_bytes`` bytes, without the spaces and carriage
    returns around them; ``no`` starts at 0, ``doc`` is the hash of the text."""
    found = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("doc"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("no", "line"))
    found = found.select("id", "doc", "no", F.btrim("line", F.lit(" \r")).alias("line"))
    return found.filter(F.octet_length("line") >= min_bytes)


def letters_of(line: Column, letter: int) -> tuple[Column, Column]:
    """``wide``, the letters of a line at ``letter`` bytes each, and their number ``n``.

    One byte: the letters are the line's bytes; four: its characters, in UTF-32.
    """
    return (line.cast("binary").alias("wide"), F.octet_length(line).alias("n")) if letter == 1 else (F.encode(line, "UTF-32").alias("wide"), F.char_length(line).alias("n"))


def part(wide: Column, start: Column | int, size: Column, letter: int = 1) -> Column:
    """``size`` letters from ``start``, counted from 1."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.substring(wide, start, size) if letter == 1 else F.substring(wide, (start - 1) * letter + 1, size * letter)


def spelled(wide: Column, letter: int = 1) -> Column:
    """A string with one character per letter."""
    return F.decode(wide, "ISO-8859-1" if letter == 1 else "UTF-32")


Place = tuple[int, Column, Column, Column]


def segments(base: Column, rest: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of ``parts`` even segments, given the length divided by
    ``parts`` and the remainder; the last segments are one longer."""
    out = []
    for i in range(parts):
        start = base * i + 1 if i else F.lit(1)
        if i > 1:
            start = start + F.greatest(rest - (parts - i), F.lit(0))
        out.append((start, base + (rest >= parts - i).cast("int") if i else base))
    return out


def divided(lines: DataFrame, edits: int) -> DataFrame:
    """Add the segment length and remainder for a line's own length and each shorter one."""
    parts = edits + 1
    return lines.select("*", *[F.expr(f"cast((n - {d}) div {parts} as int)").alias(f"base{d}") for d in range(parts)], *[((F.col("n") - d) % parts).alias(f"rest{d}") for d in range(parts)])


def index_places(edits: int) -> list[Place]:
    """(segment, line length, start, size) of the ``edits + 1`` segments of a line."""
    return [(i, F.col("n"), start, size) for i, (start, size) in enumerate(segments(F.col("base0"), F.col("rest0"), edits + 1))]


def probe_places(edits: int, *, exact: bool) -> list[Place]:
    """The substrings that can equal a segment of a line up to ``edits`` shorter.

    For segment i of a line shorter by d, a substring may start up to i places off on the
    left side and up to ``edits - i`` off, shifted by d, on the right: the edits before the
    first segment that matches and those after it have to add up.  ``exact`` leaves out the
    unshifted substrings for equal lengths, which are the line's own index places.  A place
    beyond the line's ends gives a shorter substring, which equals no segment.
    """
    out = []
    for d in range(edits + 1):
        for i, (start, size) in enumerate(segments(F.col(f"base{d}"), F.col(f"rest{d}"), edits + 1)):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                if d or shift or not exact:
                    out.append((i, F.col("n") - d, start + shift if shift else start, size))
    return out


def keys(places: list[Place], letter: int = 1) -> Column:
    """Hashes of segment number, line length and letters at every place."""
    return F.array(*[F.xxhash64(F.lit(i), length, part(F.col("wide"), start, size, letter)) for i, length, start, size in places])


def signature(text: Column) -> list[Column]:
    """Counts of single characters modulo 16, packed: an edit changes at most two counts by one."""
    left = lambda c: F.octet_length(F.replace(text, c, F.lit("")))
    count = lambda c: ((F.octet_length(text) - left(c)) % 16).cast("long")
    return [
        F.aggregate(F.array(*[F.lit(c) for c in letters]), F.lit(0).cast("long"), lambda packed, c: F.shiftleft(packed, 4).bitwiseOR(count(c)))
        for letters in COUNTED
    ]


def count_distance(a: Column, b: Column) -> Column:
    """At least this many unit changes turn one packed row of counts into the other.

    All counts at once: differences modulo 16, the shorter way round, summed.
    """
    of = lambda byte: F.lit(int.from_bytes(bytes([byte] * 8), "big")).cast("long")
    total = F.lit(0).cast("long")
    for shift in (0, 4):
        own, other = (F.shiftrightunsigned(x, shift).bitwiseAND(of(0x0F)) for x in (a, b))
        off = (own.bitwiseOR(of(0x10)) - other).bitwiseAND(of(0x0F))
        total = total + off - _wrapped(off, of)
    # The sum of the bytes: 256 leaves 1 when divided by 255.
    return total % 255


def _wrapped(off: Column, of: Callable[[int], Column]) -> Column:
    """Per count, what the shorter way round saves: 2 * off - 16 for counts of 8 and more."""
    high = F.shiftrightunsigned(off, 3).bitwiseAND(of(0x01))
    return F.shiftleft(off.bitwiseAND(F.shiftleft(high, 3) - high).bitwiseAND(of(0x07)), 1)


def common(a: Column, b: Column, size_a: Column, size_b: Column, letter: int = 1, *, end: bool) -> Column:
    """Letters that two strings share at the start, or at the end."""
    least = F.least(size_a, size_b)

    def longer(p: Column, k: Column) -> Column:
        at = lambda size: (size - p - k + 1) if end else (p + 1)
        same = (p + k <= least) & (part(a, at(size_a), k, letter) == part(b, at(size_b), k, letter))
        return F.when(same, p + k).otherwise(p)

    steps = F.array(*[F.lit(1 << k) for k in range(26, -1, -1)])
    return F.aggregate(steps, F.lit(0), longer)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else ``edits + 1``.

    The banded bit-parallel recurrence: a word of ``2 * edits + 2`` bits slides down the
    diagonal, one step per character of ``b``; its bits are the vertical differences of
    the band.  ``a`` is the string that is not shorter; lengths differ by ``edits`` at most.
    """
    width = 2 * edits + 2
    mask = (1 << width) - 1
    long = lambda v: F.lit(v).cast("long")
    inverse = lambda x: x.bitwiseXOR(long(mask))

    def run(chars: Column, other: Column) -> Column:
        rows = F.size(chars)

        def matches(c: Column, j: Column) -> Column:
            total = long(0)
            for k in range(width):
                same = F.coalesce(F.get(chars, j + (edits + 1 - width + k)) == c, F.lit(False))
                total = total.bitwiseOR(F.when(same, long(1 << k)).otherwise(long(0)))
            return total

        start = F.struct(
            long(0).alias("j"), long(mask & (mask << (width - edits - 1))).alias("vp"), long(0).alias("vn"), long(edits).alias("dist"), long(1 << (width - 2)).alias("at"),
        )

        def step(s: Column, x: Column) -> Column:
            d0 = (x.bitwiseAND(s.vp) + s.vp).bitwiseAND(long(mask)).bitwiseXOR(s.vp).bitwiseOR(x).bitwiseOR(s.vn)

            def with_d0(d: Column) -> Column:
                def with_h(h: Column) -> Column:
                    down = F.shiftright(d, 1)
                    diagonal = s.j < rows - edits
                    moved = s.dist + F.when(diagonal, F.when(d.bitwiseAND(long(1 << (width - 1))) == 0, 1).otherwise(0)).otherwise(
                        F.when(h.hp.bitwiseAND(s.at) != 0, 1).otherwise(0) - F.when(h.hn.bitwiseAND(s.at) != 0, 1).otherwise(0)
                    )
                    return F.struct(
                        (s.j + 1).alias("j"), h.hn.bitwiseOR(inverse(down.bitwiseOR(h.hp))).alias("vp"), down.bitwiseAND(h.hp).alias("vn"),
                        moved.alias("dist"), F.when(diagonal, s.at).otherwise(F.shiftright(s.at, 1)).alias("at"),
                    )

                return let(F.struct(s.vn.bitwiseOR(inverse(d.bitwiseOR(s.vp))).alias("hp"), d.bitwiseAND(s.vp).alias("hn")), with_h)

            return let(d0, with_d0)

        return F.aggregate(F.transform(other, matches), start, step, lambda s: s.dist)

    # A common start changes no distance and makes the band fit inside short strings.
    lead = F.lit("." * (edits + 1))
    return F.least(run(F.split(F.concat(lead, a), ""), F.split(F.concat(lead, b), "")), long(edits + 1))


def shares_piece(a: Column, b: Column, base: Column, rest: Column, edits: int, letter: int = 1) -> Column:
    """Whether one of the ``edits + 1`` pieces of ``a`` is in ``b`` at most ``edits`` places off.

    ``base`` and ``rest`` are the length of ``a`` divided by ``edits + 1`` and the
    remainder.  Holds for any two strings within ``edits`` edits.
    """

    def shifted(shift: Column) -> Column:
        found = F.lit(False)
        for start, size in segments(base, rest, edits + 1):
            found = found | ((start + shift >= 1) & (part(a, start, size, letter) == part(b, F.greatest(start + shift, F.lit(1)), size, letter)))
        return found

    return F.exists(F.array(*[F.lit(s) for s in range(-edits, edits + 1)]), shifted)


def sized(table: DataFrame) -> DataFrame:
    """A written table of hashes to join: broadcast if it is small by its number of rows, else never."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table.hint("merge")


def near_links(lines: DataFrame, edits: int, letter: int = 1) -> DataFrame:
    """(a, b): hashes of different lines within ``edits`` edits of each other, once per pair.

    First only (key, line) pairs are counted: a key that two different lines share is
    kept, and lines without such a key are done.  The lines left are indexed by their
    segments and probed by substrings; letter counts cut the pairs in the join.  Pairs are
    freed of their common start and end, whose middles have to share a piece again, and
    what is left is verified by the bit-parallel distance.

    Keys of different segments never meet, so one segment is done after the other and its
    shuffle files go before the next.  Only hashes travel with the keys: the letters of the
    lines left are read again.
    """
    numbers = range(edits + 1)
    every = [*index_places(edits), *probe_places(edits, exact=True)]
    placed = divided(lines.select("h", *letters_of(F.col("line"), letter)), edits)
    known = None
    for i in numbers:
        keyed = placed.select("h", F.explode(keys([p for p in every if p[0] == i], letter)).alias("key"))
        shared = written(keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("key"), "keys", few=True)
        found = written(keyed.join(sized(shared), "key", "left_semi").select("h").distinct(), "known", few=True)
        known = found if known is None else known.union(found)
    known = written(known.distinct(), "known", few=True)
    left = lines.select("h", "line").join(sized(known), "h", "left_semi").distinct()
    left = left.select("h", *letters_of(F.col("line"), letter), *[c.alias(f"s{k}") for k, c in enumerate(signature(F.col("line")))])
    left = written(left, "left", few=True)
    marked = lambda c: [F.col("h").alias(c), F.col("n").alias(f"n{c}"), *[F.col(f"s{k}").alias(f"{c}{k}") for k in range(len(COUNTED))]]
    of_segment = lambda places, i: F.explode(keys([p for p in places if p[0] == i], letter)).alias("key")
    close = sum((count_distance(F.col(f"a{k}"), F.col(f"b{k}")) for k in range(len(COUNTED))), F.lit(0).cast("long")) <= 2 * edits
    different = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("a") < F.col("b")))
    pairs = None
    for i in numbers:
        held = divided(left, edits).select(*marked("a"), of_segment(index_places(edits), i))
        asked = divided(left, edits).select(*marked("b"), of_segment(probe_places(edits, exact=False), i))
        # Never broadcast: Spark's size of what an explode gives is that of its input.
        found = written(held.join(asked.hint("merge"), "key").filter(different & close).select("a", "b").distinct(), "pairs", few=True)
        pairs = found if pairs is None else pairs.union(found)
    pairs = pairs.distinct()
    of = lambda c: left.select(F.col("h").alias(c), F.col("wide").alias(f"w{c}"), F.col("n").alias(f"n{c}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b")
    full = full.withColumn("start", common(F.col("wa"), F.col("wb"), F.col("na"), F.col("nb"), letter, end=False))
    rest = lambda c: F.col(f"n{c}") - F.col("start")
    full = full.select("a", "b", *[part(F.col(f"w{c}"), F.col("start") + 1, rest(c), letter).alias(f"w{c}") for c in "ab"], *[rest(c).alias(f"n{c}") for c in "ab"])
    full = full.withColumn("end", common(F.col("wa"), F.col("wb"), F.col("na"), F.col("nb"), letter, end=True))
    middle = lambda c: part(F.col(f"w{c}"), 1, F.col(f"n{c}") - F.col("end"), letter).alias(f"w{c}")
    full = full.select("a", "b", middle("a"), middle("b"), (F.col("na") - F.col("end")).alias("n"))
    # Written before they are filtered: a filter would repeat the expressions that make them.
    full = divided(written(full, "middles", few=True), edits)
    full = full.filter(shares_piece(F.col("wa"), F.col("wb"), F.col("base0"), F.col("rest0"), edits, letter))
    # b is the line that is not shorter.
    return full.filter(edit_distance(spelled(F.col("wb"), letter), spelled(F.col("wa"), letter), edits) <= edits).select("a", "b").distinct()


def duplicate_lines(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", edits: int = 2, min_bytes: int = 24, exact_bytes: int | None = None, characters: bool = False,
) -> DataFrame:
    """(id, doc, no): the lines to remove; ``doc`` is the hash of the text, so that texts of one id stay apart.

    Lines are split at newlines and freed of spaces and carriage returns around them; those of at least ``min_bytes`` bytes
    take part.  Of equal lines the first is kept, by (id, hash of the text, line number); it goes as well if a
    different line within ``edits`` edits (inserted, deleted or replaced bytes, or ``characters``) occurs earlier.  With
    ``exact_bytes``, lines from that length on go as repeats of an equal line, though too short to have near repeats.  Null ids
    come first; null and empty texts have no lines.  Rows that repeat an id are texts of their
    own; rows equal in id and text are one, and what goes from it goes from each.
    """
    prepare(docs.sparkSession)
    least = min_bytes if exact_bytes is None else min(exact_bytes, min_bytes)
    lines = lines_of(docs, id, text, least).withColumn("h", F.xxhash64("line"))
    links = written(near_links(lines.filter(F.octet_length("line") >= min_bytes), edits, 4 if characters else 1), "links", few=True)
    spots = written(lines.select("id", "doc", "no", "h", F.xxhash64(F.lit(1), "line").alias("h2")), "spots")
    firsts = spots.groupBy("h", "h2").agg(F.min(F.struct("id", "doc", "no")).alias("first"), F.count(F.lit(1)).alias("copies"))
    linked = links.select(F.col("a").alias("h")).union(links.select(F.col("b").alias("h"))).distinct().withColumn("linked", F.lit(True))
    told = written(firsts.join(linked, "h", "left").filter("copies > 1 or linked").select("h", "h2", "first", "linked"), "told", few=True)
    place = told.filter("linked").groupBy("h").agg(F.min("first").alias("first"))
    both = links.join(place.withColumnRenamed("h", "a").withColumnRenamed("first", "fa"), "a").join(place.withColumnRenamed("h", "b").withColumnRenamed("first", "fb"), "b")
    later = both.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct().withColumn("late", F.lit(True))
    told = told.join(later, "h", "left").select(F.col("h").alias("th"), F.col("h2").alias("th2"), "first", "late")
    same = (F.col("h") == F.col("th")) & (F.col("h2") == F.col("th2"))
    # struct comparison, so that a null id equals a null id
    return spots.join(told, same).filter(F.col("late").isNotNull() | ~F.struct("id", "doc", "no").eqNullSafe(F.col("first"))).select("id", "doc", "no")


def _gone(docs: DataFrame, id: str, text: str, **options) -> DataFrame:
    found = duplicate_lines(docs, id=id, text=text, **options)
    return found.groupBy("id", "doc").agg(F.array_sort(F.collect_set("no")).alias("__no")).withColumnsRenamed({"id": "__id", "doc": "__doc"})


def _with_gone(docs: DataFrame, id: str, text: str, **options) -> DataFrame:
    gone = _gone(docs, id, text, **options)
    return docs.withColumn("__text_hash", F.xxhash64(F.col(text).cast("string"))).join(gone, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__doc")), "left")


def removed_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_removed, removed): per row how many lines go, and which, joined by commas."""
    rows = _with_gone(docs, id, text, **options)
    count = F.coalesce(F.size("__no"), F.lit(0))
    return rows.select(id, F.when(F.col("__no").isNull(), 0).otherwise(count).cast("long").alias("n_removed"), F.coalesce(F.array_join("__no", ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without the lines to remove, all columns kept; null texts stay null."""
    kept = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda line, k: ~F.array_contains(F.col("__no"), k))
    rows = _with_gone(docs, id, text, **options)
    names = [F.col(c) if c != text else F.when(F.col("__no").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) for c in docs.columns]
    return rows.select(*names)
