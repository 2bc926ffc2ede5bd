"""Line deduplication by a segment-partition edit join.

A line of a document goes when an equal line stands earlier in the corpus, or when it lies within
``edits`` edits of the line that stays of its class.  Two lines that near share one of ``edits + 1`` segments: the
line of length ``ell`` indexes its own, a line of up to ``edits`` characters more also
probes the segments that belong to ``ell``, moved as far as edits before and after them can.  Lines that meet in a key are verified with a banded
bit-parallel edit distance.

A key that very many lines share is never expanded into pairs.  Its lines agree outside one
region, and a single edit lies in the left or the right half of that region, so they move on to
two narrower keys, until a key is small or its region is a single character.  Lines that differ
anywhere else fall apart on the way, so the rows of each step shrink with the region.  More edits lie
in as many regions, of whose halves so many hold all edits (``_narrowed``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, sieve, sifted

EDITS = 1
#: Lines that one key may hold before it is narrowed.
GROUP = 24
#: A line with more than one in so many of all occurrences meets its verdict in a broadcast join.
SHARE = 4096
#: Parts into which the members of a class are dealt to meet the line that stays.
SALTS = 16


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def banded(a: str, b: str, limit: int = EDITS) -> int:
    """Edit distance of ``a`` and ``b``, or ``limit + 1`` if it is larger.

    Bit-parallel (Myers, 1999; Hyyrö, 2003) over a band of ``2 * limit + 1`` diagonals.  Bit ``k``
    of column ``j`` is row ``j - limit + k``; ``vp`` and ``vn`` hold its vertical differences.  Rows
    above the first have the distance ``j + |row|``, rows below the last grow by one.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    k = _common(a, b)
    a, b = a[k:], b[k:]
    if k := _common(a[::-1], b[::-1]):
        a, b = a[:-k], b[:-k]
    if len(a) > len(b):
        a, b = b, a
    m, n, width = len(a), len(b), 2 * limit + 1
    mask, middle = (1 << width) - 1, 1 << limit
    vp, vn, score = mask >> (limit + 1) << (limit + 1), (1 << (limit + 1)) - 1, 0
    for j in range(1, n + 1):
        vp, vn, eq, c = vp >> 1 | 1 << (width - 1), vn >> 1, 0, b[j - 1]
        for row in range(max(1, j - limit), min(m, j + limit) + 1):
            if a[row - 1] == c:
                eq |= 1 << (row - j + limit)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) << 1 | 1, (d0 & vp) << 1
        vp, vn = (hn | ~(d0 | hp)) & mask, hp & d0 & mask
        score += 0 if d0 & middle else 1
        if score - (n - m) > limit:
            return limit + 1
    for row in range(m + 1, n + 1):  # from the diagonal up to the last row of ``a``
        k = row - n + limit
        score -= (vp >> k & 1) - (vn >> k & 1)
    return min(score, limit + 1)


def _segment(ell: Column, i: int, moved: int, line: Column, edits: int) -> Column:
    """Hash of what ``line`` has, ``moved`` characters on, in place of segment ``i`` of a line of ``ell`` characters."""
    at, end = (F.floor(ell * k / (edits + 1)).cast("int") for k in (i, i + 1))
    return F.xxhash64(ell, F.lit(i), F.substring(line, at + 1 + moved, end - at))


def _keys(line: Column, edits: int) -> Column:
    """Hashes of the segments a line indexes, and of those it probes as the longer of a pair.

    Of the segments that two lines share one has no more edits before it than its number, and no more after it than segments follow.
    """
    n, own = range(edits + 1), F.length(line)
    found = [(i, more, d) for i in n for more in n for d in range(-i, i + 1) if abs(more - d) <= edits - i]
    return F.array(*[_segment(own - more, i, d, line, edits) for i, more, d in found])


def _children(line: Column, ell: Column, p: Column, q: Column) -> Column:
    """The two narrower regions of [p, ell - q), as struct(ell, p, q, key)."""
    m = F.floor((ell - p - q) / 2).cast("int")

    def child(p2: Column, q2: Column) -> Column:
        outside = F.xxhash64(ell, p2, q2, F.substring(line, F.lit(1), p2), F.when(q2 > 0, F.right(line, q2)).otherwise(""))
        return F.struct(ell.alias("ell"), p2.alias("p"), q2.alias("q"), outside.alias("key"))

    return F.array(child(p + m, q), child(p, q + (ell - p - q - m)))


def _narrowed(front: DataFrame, edits: int) -> DataFrame:
    """``lid, line, ell, bounds, key, wide`` of the narrower regions of ``front`` (``lid, line, ell, bounds``).

    ``bounds``: first and end of each of ``edits`` regions of a line of ``ell`` characters that hold all edits between it and ``line``.
    ``key`` tells what ``line`` has outside of the regions, moved by the edits in those before; ``wide`` if one is over a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out: list[tuple] = []
            for lid, line, ell, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = len(line) - ell
                halves = [h for a, b in zip(bounds[::2], bounds[1::2]) for h in ((a, (a + b) // 2), ((a + b) // 2, b))]
                for chosen in combinations(halves, edits):
                    inner = [x for h in chosen for x in h]
                    runs = list(zip([0, *inner[1::2]], [*inner[::2], ell]))
                    between = [range(-edits, edits + 1) if a < b else (None,) for a, b in runs[1:-1]]
                    for moved in product(*between):
                        path = [0, *(d for d in moved if d is not None), more]
                        parts = [(a + d, b + d) for (a, b), d in zip(runs, [0, *(d or 0 for d in moved), more])]
                        if sum(abs(x - y) for x, y in zip(path, path[1:])) > edits or any(a < 0 or b > len(line) for a, b in parts):
                            continue
                        outside = repr((ell, inner, [line[a:b] for a, b in parts])).encode("utf-8", "surrogatepass")
                        key = xxh64_intdigest(outside)
                        out.append((lid, line, ell, inner, key - (1 << 64) if key >> 63 else key, max(b - a for a, b in chosen) > 1))
            columns = list(zip(*out)) or [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    kind = pa.schema([("lid", pa.binary()), ("line", pa.string()), ("ell", pa.int32()), ("bounds", pa.list_(pa.int32())), ("key", pa.int64()), ("wide", pa.bool_())])
    return front.select("lid", "line", "ell", "bounds").mapInArrow(run, "lid binary, line string, ell int, bounds array<int>, key bigint, wide boolean")


def _crowded(hot: DataFrame, edits: int) -> DataFrame:
    """Links of ``hot`` lines (``lid, line``) within several edits, by ever narrower regions."""
    ell = F.explode(F.sequence(F.length("line") - edits, F.length("line"))).alias("ell")
    front = hot.select("lid", "line", ell)
    front = front.withColumn("bounds", F.array(*[F.floor(F.col("ell") * k / edits).cast("int") for x in range(edits) for k in (x, x + 1)]))
    found = None
    while True:
        step = _narrowed(front, edits)
        sizes = step.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        step = cut(step.join(sizes.select("key", "size"), "key"))
        last = (F.col("size") <= GROUP) | ~F.col("wide")
        links = _verified(step.where(last).select("key", "lid", "line"), edits)
        found = links if found is None else found.unionByName(links)
        front = step.where(~last).dropDuplicates(["lid", "ell", "bounds"])
        if front.isEmpty():
            return found


def _long_enough(line: Column, least: int) -> Column:
    """Whether ``line`` has ``least`` characters between its outer white space, a run of white space taken as one.

    The match ends at the last of these characters, so long lines are neither read to their end nor copied.
    """
    white = r"\x20\x09-\x0D"
    return line.rlike(rf"[^{white}](?:[{white}]++(?=[^{white}])|[^{white}]){{{least - 1}}}") if least > 0 else F.lit(True)


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``id, version, pos, line`` of every line of ``least`` characters or more.

    ``version`` tells rows with one id and different texts apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(_long_enough(F.col("line"), least))


def _line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def near_lines(lines: DataFrame, texts: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` that connect the ids of distinct lines within ``edits``, and ``lid, line`` of all of these.

    ``lines``: distinct ``lid`` with ``keys``.  ``texts``: ``lid, line``, repeats allowed; only lines
    that meet another in a key are fetched.
    """
    keyed = lines.select("lid", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    met = cut(keyed.join(shared.select("key", "size"), "key"))
    wanted = met.select("lid").distinct()
    # Most lines meet no other: a bitmap of those that do holds the rest back from the shuffle.
    some = sifted(texts, "lid", sieve(wanted, "lid")).where("__maybe").select("lid", "line")
    own = cut(some.join(wanted, "lid", "left_semi").groupBy("lid").agg(F.first("line").alias("line")))
    found = _verified(met.where(F.col("size") <= GROUP).select("key", "lid").join(own, "lid"), edits)
    # Large groups: all that the lines of such a key can be is told by their lengths.
    hot = met.where(F.col("size") > GROUP).select("lid").distinct().join(own, "lid")
    if edits > 1:
        return found.unionByName(_crowded(hot, edits)).distinct(), own
    root = [F.struct(ell.cast("int").alias("ell"), F.lit(0).alias("p"), F.lit(0).alias("q")) for ell in (F.length("line"), F.length("line") - 1)]
    front = hot.select("lid", "line", F.explode(F.array(*root)).alias("r")).select("lid", "line", "r.*")
    while True:
        step = front.select("lid", "line", F.explode(_children(F.col("line"), F.col("ell"), F.col("p"), F.col("q"))).alias("r")).select("lid", "line", "r.*")
        sizes = step.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        step = cut(step.join(sizes, "key"))
        last = (F.col("size") <= GROUP) | (F.col("ell") - F.col("p") - F.col("q") <= 1)
        found = found.unionByName(_verified(step.where(last).select("key", "lid", "line"), edits))
        front = step.where(~last).drop("size", "key")
        if front.isEmpty():
            return found.distinct(), own


def followers(classed: DataFrame, own: DataFrame, edits: int = EDITS) -> DataFrame:
    """``lid, stays`` of the lines within ``edits`` of the first line of their class, which is at ``stays``.

    ``classed``: ``lid, label, at``.  Chains make classes wider than that; what is farther from the first line is not here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([banded(a.as_py(), b.as_py(), edits) <= edits for a, b in zip(batch.column(1), batch.column(2), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near)], names=["lid"])

    head = classed.groupBy("label").agg(F.min(F.struct("at", "lid")).alias("h")).select("label", F.col("h.lid").alias("lid"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    head = head.join(own, "lid").select("label", F.col("lid").alias("head"), F.col("line").alias("first"), salts)
    members = classed.join(own, "lid").select("lid", "label", "line", F.pmod(F.xxhash64("lid"), F.lit(SALTS)).cast("int").alias("salt"))
    met = members.join(head, ["label", "salt"]).where("lid <> head")
    near = met.select("lid", "line", "first").mapInArrow(run, "lid binary")
    first = classed.groupBy("label").agg(F.min("at").alias("stays"))
    return near.join(classed.select("lid", "label"), "lid").join(first, "label").select("lid", "stays")


def _verified(members: DataFrame, edits: int) -> DataFrame:
    """Links within each key; ``members``: ``key, lid, line``.  Groups here are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for group in batch.column(0).to_pylist():
                head: dict[bytes, bytes] = {x["lid"]: x["lid"] for x in group}

                def top(x: bytes) -> bytes:
                    while head[x] != x:  # noqa: B023
                        x = head[x]  # noqa: B023
                    return x

                for k, x in enumerate(group):
                    for y in group[:k]:
                        if top(x["lid"]) != top(y["lid"]) and banded(x["line"], y["line"], edits) <= edits:
                            left.append(x["lid"])
                            right.append(y["lid"])
                            head[top(x["lid"])] = top(y["lid"])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    groups = members.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("lid", "line"))).alias("group"))
    return groups.where("size(group) > 1").select("group").mapInArrow(run, "a binary, b binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 16, near: int = 40, edits: int = EDITS) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_lines``, ``n_removed`` added.

    Lines of ``least`` characters (white space runs count as one) or more take part, those of ``near`` or more also by edit
    distance; shorter ones always stay.  Lines within ``edits`` edits form classes, through chains too; the line of a
    class with the smallest id, then the first in its text, stays.  Of the others those within ``edits`` of it go; those farther
    away are lines of their own, of which the first occurrence stays.  Null ids come first.  Rows with one id and one text are cleaned alike.  A null text stays null and has
    no lines; empty input gives no rows; other columns pass through, but those with the new names are replaced.
    """
    if not 0 < edits <= near // 4:
        raise ValueError("edits must be one or more, and a quarter of the characters of the lines they apply to at most")
    docs = docs.drop("n_lines", "n_removed")
    seen = occurrences(docs, id_col, text_col, least).withColumn("lid", _line_id(F.col("line")))
    place = F.struct("id", "version", "pos")
    lines = cut(
        seen.select("lid", place.alias("at"), F.when(F.length("line") >= near, _keys(F.col("line"), edits)).alias("keys"))
        .groupBy("lid")
        .agg(F.min("at").alias("at"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    )
    links, own = near_lines(lines.where("keys is not null").select("lid", "keys"), seen.select("lid", "line"), edits)
    label = components(links, "a", "b").withColumnRenamed("node", "lid")
    moved = followers(cut(lines.join(label, "lid").select("lid", "label", "at")), own, edits)
    # A line that occurs once, and follows none, needs no look at its occurrences.
    owner = lines.join(moved, "lid", "left").where("n > 1 or stays is not null").select("lid", "n", F.coalesce("stays", "at").alias("stays"))
    owner = cut(owner)
    total = lines.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") > total / SHARE  # so fewer than SHARE lines, which may be broadcast
    hot = owner.where(common).select("lid", F.col("stays").alias("early"))
    found = seen.select("lid", "id", "version", "pos").join(F.broadcast(hot), "lid", "left")
    spread = F.when(F.col("early").isNotNull(), F.unhex(F.md5(F.concat_ws(" ", "id", "version", "pos")))).otherwise(F.col("lid"))
    both = found.withColumn("lid", spread).join(owner.where(~common).select("lid", "stays"), "lid", "left")
    stays = F.coalesce("early", "stays")
    drops = both.where(stays.isNotNull() & ~place.eqNullSafe(stays))
    drops = drops.groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
    text = F.col(text_col)
    rows = docs.withColumn("__version", F.xxhash64(F.coalesce(text, F.lit("")))).alias("d")
    both = rows.join(drops.alias("x"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.id")) & (F.col("d.__version") == F.col("x.version")), "left")
    parts = F.split(F.col(f"d.`{text_col}`"), "\n")
    gone = F.coalesce(F.col("x.gone"), F.array().cast("array<int>"))
    kept = F.array_join(F.filter(parts, lambda _, k: ~F.array_contains(gone, k)), "\n")
    clean = F.when(F.size(gone) == 0, F.col(f"d.`{text_col}`")).otherwise(kept)
    others = [F.when(F.lit(True), clean).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    n_lines = F.when(F.col(f"d.`{text_col}`").isNull(), 0).otherwise(F.size(parts)).cast("bigint")
    return both.select(*others, n_lines.alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"))
