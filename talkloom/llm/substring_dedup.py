"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are five-word shingles.  Under one hash function the shingle sequences of a text that
share their smallest shingle form a compact window (l, c, r): every [i, j] with
l <= i <= c <= j <= r has its minimum at c.  The windows are the nodes of a Cartesian tree, and
only nodes of at least the passage length matter, about 2 n / length of them (Deng et al.,
2021).  Passages of two documents with Jaccard similarity J share a minimum under a hash with
probability J, so with several independent hashes few are missed.

Windows with the same minimum and the same shingles around it, a kind, meet the earliest of them,
so a passage in thousands of documents costs one row each.  The earliest of each kind all meet if
the minimum has up to ``GROUP`` places, else they are compared by these shingles (``meetings``), so
an earlier document that holds the minimum but not the passage hides no later one.  A passage reaching farther from the minimum than these shingles do is one
that has a minimum of its own there.  The intervals that a document shares with an earlier one
are merged over all hashes, and the words of both are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import cut, forget, kept, sieve, sifted, swept

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 3
#: Windows of a key that all meet one another.
GROUP = 16
#: Windows of a larger key, of different kinds, that meet one another in a task.
BLOCK = 1024
#: Texts whose words are hashed and whose windows are found at once.
TOGETHER = 64
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z taken as a-z."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _ODD + words[k : k + n]
    return mix(out)


def hashed_together(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of all ``texts`` in a row, and how many each has."""
    from xxhash import xxh64_intdigest

    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
        sizes[k] = len(own)
        words += own
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)), sizes


def shingled(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``shingles`` of each of the sequences of ``sizes`` words that stand in a row."""
    s, ends = shingles(words), np.cumsum(sizes)
    return [s[a : max(a, b - SHINGLE + 1)] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def windows(g: np.ndarray, least: int, walls: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (l, c, r) of ``least`` or more values; of equal minima the leftmost counts.

    With ``walls`` a zero ends each of several sequences of ``least`` or more values, and no window reaches over it.

    A node that wide is the minimum of half that width on one side at least, which a sliding
    minimum finds; its nearest smaller values on either side are such nodes too, so a monotone
    stack over these few positions gives the bounds.
    """
    n, half = len(g), (least + 1) // 2
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    low, width = g, 1  # low[i] = min g[i : i + width]
    while width < half:
        step = min(width, half - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    at = np.zeros(n, dtype=bool)
    at[half - 1 :] |= g[half - 1 :] == low
    at[: n - half + 1] |= g[: n - half + 1] == low
    at[1:] &= g[1:] != g[:-1]  # a run of one shingle counts once
    place = np.flatnonzero(at)
    values, places = g[place].tolist(), place.tolist()
    left, right = [0] * len(places), [n - 1] * len(places)
    stack: list[int] = []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[k] - 1
        left[k] = places[stack[-1]] + 1 if stack else 0
        stack.append(k)
    lo, hi = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    wide = (hi - lo + 1 >= least) & (g[place] > 0 if walls else True)
    lo, hi, c = lo[wide], hi[wide], place[wide]
    if len(c):  # a narrower node between two of these can only have bounded them sooner
        ends = np.stack([lo, hi + 1], axis=1).ravel()
        true = np.minimum.reduceat(np.append(g, np.uint64(0xFFFFFFFFFFFFFFFF)), ends)[::2] == g[c]
        lo, hi, c = lo[true], hi[true], c[true]
    return lo, c, hi


def window_rows(docs: DataFrame, id_col: str, text_col: str, hashes: int, least: int) -> DataFrame:
    """``key, id, c, l, r, near`` of every compact window under every hash; ``near`` tells the shingles around its minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [mix(np.array([k + 1], np.uint64) * _ODD)[0] for k in range(hashes)]
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                words, sizes = hashed_together(part.column(1).to_pylist())
                some = sizes - SHINGLE + 1 >= least
                if not some.any():
                    continue
                # The shingles of each text and one more, which reaches over its end and becomes a wall.
                many, first = sizes[some] - SHINGLE + 2, (np.cumsum(sizes) - sizes)[some]
                ends = np.cumsum(many)
                s = shingles(np.append(words, np.uint64(0)))[np.repeat(first - ends + many, many) + np.arange(ends[-1])]
                ids, starts = part.column(0).to_numpy()[some], ends - many
                upto = np.append(np.uint64(0), np.cumsum(mix(s + _ODD)))
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for seed in seeds:
                    g = mix(s ^ seed)
                    g[ends - 1] = 0
                    lo, c, hi = windows(g, least, walls=True)
                    a, b = around(c, lo, hi, least)
                    near = mix(upto[b + 1] - upto[a] + mix((c - a << 32 | b - c).astype(np.uint64)))
                    of = np.searchsorted(ends, c, "right")
                    start = starts[of]
                    for column, values in zip(columns, (g[c].view(np.int64), ids[of], *((x - start).astype(np.int32) for x in (c, lo, hi)), near.view(np.int64)), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "id", "c", "l", "r", "near"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(run, "key bigint, id bigint, c int, l int, r int, near bigint")


def around(c: np.ndarray, l: np.ndarray, r: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last shingle of a window within ``least`` of its minimum: what lies beyond is in a passage without it."""
    return np.maximum(l, c - least + 1), np.minimum(r, c + least - 1)


def contexts(rows: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``rows`` (``key, id, c, l, r, part, parts``) with ``near``: 32 bits of each shingle around the minimum; ``texts``: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1)
            own = dict(zip(("key", "c", "l", "r", "part", "parts"), found.flatten().flatten(), strict=True))
            a, b = around(*(own[x].to_numpy().astype(np.int64) for x in "clr"), least)
            a, b, near, first = a.tolist(), b.tolist(), [], 0
            many = found.value_lengths()
            for end, text in zip(np.cumsum(many.to_numpy()).tolist(), batch.column(2), strict=True):
                s = (shingles(word_hashes(text.as_py())) >> np.uint64(32)).astype(np.uint32)
                near += [s[x : y + 1].tobytes() for x, y in zip(a[first:end], b[first:end])]
                first = end
            ids = pa.array(np.repeat(batch.column(0).to_numpy(), many.to_numpy()), pa.int64())
            yield pa.RecordBatch.from_arrays([own["key"], ids, *(own[x] for x in ("c", "l", "r", "part", "parts")), pa.array(near, pa.binary())], schema=kind)

    kind = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("near", pa.binary())])
    packed = rows.groupBy("id").agg(F.collect_list(F.struct("key", "c", "l", "r", "part", "parts")).alias("found"))
    some = sifted(texts, "id", sieve(packed.select("id"), "id")).where("__maybe").select("id", "text")
    return packed.join(some, "id").select("id", "found", "text").mapInArrow(run, "key bigint, id bigint, c int, l int, r int, part int, parts int, near binary")


def meetings(ids: list[int], near: list[bytes], seeks: list[bool], holds: list[bool], least: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs (later, earlier) of the windows of one key, in order of ids, whose passages may match.

    Only shingles that two windows have count.  A window meets, of the leads with half the shingles of a passage in common, the one
    with most and each that adds to what it has in common with those before.  It is a lead itself unless these have all of it and the
    first so much that whatever has ``similarity`` of a passage in common with the window has half with that lead.
    """
    own = [np.unique(np.frombuffer(x, np.uint32), return_counts=True) for x in near]
    values, of, n = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True, return_counts=True)
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[of]
    ends = np.cumsum([len(x) for x, _ in own])[:-1]
    half, spare = least / 2, (similarity - 0.5) * least
    has = np.zeros((len(own), int((n > 1).sum())), np.uint8)
    leads: list[int] = []
    of_lead = np.zeros(len(own), np.int64)
    out: list[tuple[int, int]] = []
    for k, (at, (_, weights)) in enumerate(zip(np.split(place, ends), own, strict=True)):
        at, weights = at[at >= 0], weights[at >= 0].astype(np.float32)
        met, first, left = [], 0.0, weights.copy()
        if leads and len(at):
            common = has[: len(leads)][:, at].astype(np.float32)
            some = np.flatnonzero((common @ weights >= half) & (of_lead[: len(leads)] != ids[k]))
            common = common[some]
            while len(some) and (gain := common @ left).max() > 0:
                best = int(gain.argmax())
                first = first or float(gain[best])
                met.append(leads[some[best]])
                left[common[best] > 0] = 0
        if seeks[k]:
            out += [(k, x) for x in met]
        if holds[k] and len(at) and (left.any() or weights.sum() - first > spare):
            has[len(leads), at] = 1
            of_lead[len(leads)] = ids[k]
            leads.append(k)
    return out


def _crowded(rows: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """``id, lead, c, lc, l, r`` of windows (``key, id, c, l, r``) of large keys that may match."""
    spot = Window.partitionBy("key").orderBy("id", "c")
    part = ((F.row_number().over(spot) - 1) / BLOCK).cast("int")
    parts = F.ceil(F.count("*").over(Window.partitionBy("key")) / BLOCK).cast("int")
    full = contexts(rows.select("key", "id", "c", "l", "r", part.alias("part"), parts.alias("parts")), texts, least)
    # Blocks of a key meet in pairs (a, b), a <= b: those of b look for holders in a.
    dealt = full.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "id", "c", "l", "r", "near")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("c", "ascending")])
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        ids, own = table["id"].to_pylist(), table["part"].to_pylist()
        found = meetings(ids, table["near"].to_pylist(), [x == b for x in own], [x == a for x in own], least, similarity)
        later, earlier = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        x, y = table.take(later), table.take(earlier)
        return pa.table([x["id"], y["id"], x["c"], y["c"], x["l"], x["r"]], names=["id", "lead", "c", "lc", "l", "r"])

    return dealt.groupBy("key", "a", "b").applyInArrow(run, "id bigint, lead bigint, c int, lc int, l int, r int")


def meeting(found: DataFrame, path: str, texts: DataFrame, least: int, similarity: float, group: int = GROUP) -> DataFrame:
    """``id, lead, spans``: the windows (``c, lc, l, r``) of a document and an earlier one that share a minimum; ``texts``: id, text.

    ``path`` has all windows, as ``kept`` wrote them; it goes as soon as those that share a minimum are written.
    """
    spark = found.sparkSession
    shared = cut(found.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"))
    # Most windows are alone with their minimum: a bitmap of the others' keys holds them back from the shuffle.
    some = sifted(found, "key", sieve(shared, "key")).where("__maybe").drop("__maybe")
    some, held = kept(some.join(shared, "key"), "passages")
    forget(spark, path)
    kinds = cut(some.groupBy("key", "near").agg(F.min(F.struct("id", "c", "l", "r")).alias("first"), F.first("n").alias("n")))
    same = some.drop("n").join(kinds.select("key", "near", "first"), ["key", "near"]).where("id > first.id")
    same = same.select("id", F.col("first.id").alias("lead"), "c", F.col("first.c").alias("lc"), "l", "r")
    few = kinds.where(F.col("n") <= group).groupBy("key").agg(F.collect_list("first").alias("all")).where("size(all) > 1")
    few = few.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: y["id"] < F.col("x.id"))).alias("y"))
    few = few.select("x.id", F.col("y.id").alias("lead"), "x.c", F.col("y.c").alias("lc"), "x.l", "x.r")
    firsts = kinds.where(F.col("n") > group).select("key", "first.*")
    met = few.unionByName(same).unionByName(_crowded(firsts, texts, least, similarity))
    pairs = cut(met.groupBy("id", "lead").agg(F.collect_list(F.struct("c", "lc", "l", "r")).alias("spans")))
    forget(spark, held)
    return pairs


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def snippets(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, words``: the words of the earlier document (``texts``: lead, text) around what the two share, as they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, where = None, b"", np.zeros((0, 2), np.int64)
        for batch in batches:
            ids, out = [], []
            spans = batch.column(2)
            c, lc, l, r = (x.to_numpy() for x in spans.flatten().flatten())
            reach = list(zip(np.maximum(0, lc - (c - l)).tolist(), (lc + (r - c) + SHINGLE).tolist()))
            ends = np.cumsum(spans.value_lengths().to_numpy()).tolist()
            texts, first = batch.column(3), 0
            for k, (id_, lead, end) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, strict=True)):
                if lead != known:  # rows come sorted by the earlier document
                    known, raw = lead, (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
                    where = borders(raw)
                for a, b in _merged(reach[first:end]):
                    if b - a >= SHINGLE and a < len(where):
                        ids.append(id_)
                        out.append(raw[where[a, 0] : where[min(b, len(where) - 1), 1]])
                first = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "words"])

    return pairs.join(texts, "lead").select("id", "lead", "spans", "text").mapInArrow(run, "id bigint, words binary")


def matches(own: np.ndarray, other: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int]]:
    """Passages of ``own`` (word hashes) that ``other`` has too, as [first, last] words.

    Shingles of ``own`` found in ``other`` form runs; runs apart by at most two edited words are
    taken together if the shingle sets of both passages reach ``similarity``, else each counts for itself.
    """
    return matching(shingles(own), shingles(other), min_words, similarity)


def matching(s: np.ndarray, t: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int]]:
    """``matches`` of the shingles of both."""
    least = min_words - SHINGLE + 1
    if len(s) < least or len(t) < least:
        return []
    order = np.argsort(t, kind="stable")
    ranked = t[order]
    near = np.minimum(np.searchsorted(ranked, s), len(t) - 1)
    hit = ranked[near] == s
    at = np.flatnonzero(hit)
    if len(at) < similarity * least * 0.9:
        return []
    place = order[near]

    def good(a: int, b: int) -> bool:
        if b - a + 1 < least:
            return False
        where = place[a : b + 1][hit[a : b + 1]]
        mine, theirs = np.unique(s[a : b + 1]), np.unique(t[where.min() : where.max() + 1])
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        return both >= similarity * (len(mine) + len(theirs) - both)

    out: list[tuple[int, int]] = []
    breaks = np.flatnonzero(np.diff(at) > 2 * SHINGLE + 1)
    for first, last in zip(np.append(0, breaks + 1), np.append(breaks, len(at) - 1), strict=True):
        a, b = int(at[first]), int(at[last])
        if b - a + 1 < least:
            continue
        if b - a == last - first or good(a, b):  # without a gap it counts for itself anyhow
            out.append((a, b + SHINGLE - 1))
            continue
        part = at[first : last + 1]
        cuts = np.flatnonzero(np.diff(part) > 1)
        for x, y in zip(np.append(0, cuts + 1), np.append(cuts, len(part) - 1), strict=True):
            if part[y] - part[x] + 1 >= least:
                out.append((int(part[x]), int(part[y]) + SHINGLE - 1))
    return out


def borders(raw: bytes) -> np.ndarray:
    """First byte of each word of a text in UTF-8, and the byte after it."""
    white = np.append(_WHITE[np.frombuffer(raw, np.uint8)], True)
    return np.flatnonzero(white != np.append(True, white[:-1])).reshape(-1, 2)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, which are merged and sorted."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    where = borders(raw)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : where[a, 0]])
        at = where[b, 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_words``, ``n_removed``, ``spans`` added.

    A passage of ``min_words`` or more that nearly repeats one of a document with a smaller id is
    taken out; ``spans`` (arrays of [first, last] word, from 0) tells where it was in the whole text.  Ids are integers;
    rows that share one are taken as one document and never clean each other.  Rows with a null id and null or short
    texts pass unchanged.  Empty input gives no rows; other columns pass through, but those with the new names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "spans")
    least = min_words - SHINGLE + 1
    texts = docs.select(F.col(id_col).cast("bigint").alias("lead"), F.col(text_col).alias("text"))
    with swept(docs.sparkSession):
        found, path = kept(window_rows(docs, id_col, text_col, hashes, least), "windows")
        pairs = meeting(found, path, texts.withColumnRenamed("lead", "id"), least, similarity)
        texts = sifted(texts, "lead", sieve(pairs.select("lead").distinct(), "lead")).where("__maybe").drop("__maybe")
        # Documents that share nothing stay where they are.
        plain = sifted(docs.withColumn("__id", F.col(id_col).cast("bigint")), "__id", sieve(pairs.select("id").distinct(), "id"))
    parts = snippets(pairs, texts).groupBy("id").agg(F.collect_list("words").alias("others"))

    names = docs.columns
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, removed, all_spans = [], [], [], []
            for at in range(0, batch.num_rows, TOGETHER):
                wholes, found = (batch.column(k).slice(at, TOGETHER).to_pylist() for k in (place, len(names)))
                found = [list(dict.fromkeys(x or ())) for x in found]
                words, sizes = hashed_together(wholes)
                theirs = iter(shingled(*hashed_together([o for x in found for o in x])))
                for whole, size, own, others in zip(wholes, sizes.tolist(), shingled(words, sizes), found, strict=True):
                    spans = _merged([x for _ in others for x in matching(own, next(theirs), min_words, similarity)])
                    texts.append(without(whole, spans))
                    n_words.append(size)
                    removed.append(sum(b - a + 1 for a, b in spans))
                    all_spans.append([list(x) for x in spans])
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            columns += [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed", "spans"])

    own = [F.col(f"`{c}`") for c in names]
    n_words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")
    alone = plain.where("not __maybe").select(*own, n_words.alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.array().cast("array<array<int>>").alias("spans"))
    joined = plain.where("__maybe").join(parts.withColumnRenamed("id", "__id"), "__id", "left").select(*own, "others")
    cleaned = joined.mapInArrow(run, f"{kinds}, n_words bigint, n_removed bigint, spans array<array<int>>")
    return alone.unionByName(cleaned)
