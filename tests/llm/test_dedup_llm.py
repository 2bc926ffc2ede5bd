"""Deduplication operators against brute force, and their defined edge cases."""

import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkloom.llm import common, exact_dedup, line_dedup, near_dedup, simhash, substring_dedup

WORDS = [f"w{k}" for k in range(200)]
EXTRA = "doc_id long, text string, id string, fp string, line string, key string, n_words string"


def frame(spark, rows):
    """Rows of (doc_id, text) with other columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], EXTRA)


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def classes(pairs, nodes):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == classes([e for e in edges if e[0] != e[1]], nodes)


def test_spark_hash_is_xxh64(spark):
    r = spark.sql("SELECT xxhash64('wörd und so') AS h").first()["h"]
    assert r % 2**64 == xxhash.xxh64_intdigest("wörd und so".encode(), 42)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(s))


def test_masks_cover_radius_two():
    for i in range(64):
        for j in range(i):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in simhash.MASKS)


def test_simhash_is_brute_force(spark):
    draw = random.Random(3)
    base = [prose(draw, n) for n in (3, 40, 60, 400)]
    texts = base + base[:2] + [base[3] + f" tail{k}" for k in range(30)] + ["", None, " \t ", "one", "Two words", "two words", "É é É"]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    got = [(r["id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    links = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = classes(links, ids)
    assert len(got) == len(rows) and len(set(want.values())) < len(ids) - 20
    for i, fp, c in got:
        assert (fp % 2**64, c) == (fps[i], want[i])


@pytest.mark.parametrize("group", [2, 64, 1000])
def test_links_join_neighbours_of_a_full_ball(spark, group):
    """A value, its 64 neighbours, and a chain at distance two: one class; a value three bits off is apart."""
    draw = random.Random(1)
    z = draw.getrandbits(64)
    near = [z] + [z ^ (1 << k) for k in range(64)] + [z ^ 0b111 << 10 ^ 0b1 << 50 ^ 0b111 << 20]
    far = z ^ 0xFFFF << 8
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in {*near, far}], "fp long")
    label = {r["node"]: r["label"] for r in common.components(simhash.links(nodes, group), "fp", "head").collect()}
    assert len({label[simhash.signed(x)] for x in near[:65]}) == 1
    assert simhash.signed(far) not in label and simhash.signed(near[65]) not in label


@pytest.mark.parametrize("run", [lambda d: simhash.near_duplicates(d), lambda d: exact_dedup.dedup(d), lambda d: line_dedup.dedup_lines(d), lambda d: substring_dedup.dedup_passages(d)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], EXTRA)).count() == 0


def test_null_ids_do_not_crash(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (2, None)]
    assert {r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).where("fp <> 0").collect()} == {1}
    assert {r["keep_id"] for r in exact_dedup.dedup(frame(spark, rows)).collect()} == {1, 2}
    assert line_dedup.dedup_lines(frame(spark, rows)).count() == 4
    assert substring_dedup.dedup_passages(frame(spark, rows)).count() == 4


def test_exact_dedup_order_of_survivors(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "a\tb "), (4, None), (5, " "), (6, "x"), (7, "x"), (-9, "x"), (8, "long" * 30000)]
    got = {r["id"]: r for r in exact_dedup.dedup(frame(spark, rows), salts=3).collect()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {
        1: (2, 3, False), 2: (2, 3, True), 3: (2, 3, False), 4: (5, 2, False), 5: (5, 2, True), 6: (-9, 3, False), 7: (-9, 3, False), -9: (-9, 3, True), 8: (8, 1, True),
    }


def distance(a, b):
    k = len(os.path.commonprefix([a, b]))
    a, b = a[k:], b[k:]
    k = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - k], b[: len(b) - k]
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=9), st.text("ab", max_size=9), st.integers(1, 3))
def test_banded_distance(a, b, limit):
    assert line_dedup.banded(a, b, limit) == min(distance(a, b), limit + 1)


def plain_lines(rows, least=16, near=40):
    first, occurrences = {}, []
    for i, t in sorted(rows):
        for k, x in enumerate((t or "").split("\n")):
            if len(re.sub(r"[\x20\x09-\x0D]+", " ", x).strip()) >= least:
                first.setdefault(x, (i, k))
                occurrences.append((i, k, x))
    lines = sorted(first, key=first.get)
    links = [(first[a], first[b]) for a in lines for b in lines if first[a] < first[b] and min(len(a), len(b)) >= near and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1]
    top = classes(links, list(first.values()))
    heads = {first[x]: x for x in lines}
    stays = {x: top[first[x]] if distance(x, heads[top[first[x]]]) <= 1 else first[x] for x in lines}
    gone = {(i, k) for i, k, x in occurrences if stays[x] != (i, k)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup_is_brute_force(spark):
    draw = random.Random(9)
    base = "".join(draw.choice("abcdefgh ") for _ in range(60)).replace("  ", "xy").strip().ljust(60, "z")
    lines = [base]
    for _ in range(70):  # one key that far more lines share than a group may hold
        k, x = draw.randrange(len(base)), list(base)
        x[k : k + draw.randint(0, 1)] = [draw.choice("ABCDE")]
        lines.append("".join(x))
    for _ in range(40):
        lines.append(prose(draw, 12))
    lines += [draw.choice(lines) for _ in range(20)] + ["short", "short", ""]
    draw.shuffle(lines)
    rows = [(k, "\n".join(lines[at : at + 3])) for k, at in enumerate(range(0, len(lines), 3))] + [(900, "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)


@pytest.mark.parametrize("edits", [2, 3])
def test_lines_within_several_edits_are_brute_force(spark, edits):
    """Lines apart, and a key that far more of them share than a group may hold."""
    draw = random.Random(edits)

    def edited(line):
        x = list(line)
        for _ in range(draw.randint(1, edits + 1)):
            k = draw.randrange(len(x))
            x[k : k + draw.randint(0, 1)] = [draw.choice("ABCDE")] if draw.random() < 0.7 else []
        return "".join(x)

    base = "".join(draw.choice("abcdefgh") for _ in range(60))
    lines = [base] + [edited(base) for _ in range(50)]
    for _ in range(15):
        lines.append("".join(draw.choice("abcdefgh") for _ in range(55)))
        lines += [edited(lines[-1]) for _ in range(2)]
    draw.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    ends = range(len(lines))
    top = classes([(a, b) for b in ends for a in range(b) if distance(lines[a], lines[b]) <= edits], list(ends))
    want = {k for k in ends if top[k] != k and distance(lines[k], lines[top[k]]) <= edits}
    got = line_dedup.dedup_lines(frame(spark, list(enumerate(lines))), edits=edits).where("n_removed = 1")
    assert {r["doc_id"] for r in got.collect()} == want and len(want) > 10


def test_chained_lines_beyond_an_edit_of_the_first_stay(spark):
    """Lines that differ in a date alone form one class, but only those within an edit of its first line go."""
    lines = [f"This archive of records was last revised on {m:02d}/{d:02d} by the committee" for m in range(1, 13) for d in range(1, 29)]
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)
    assert {k for k, t in got.items() if not t} == {k for k, x in rows if k and distance(lines[0], x) <= 1}


def test_a_line_of_a_third_of_all_rows(spark):
    """Occurrences of a very common line and of its variants, in documents of null ids too."""
    common = "All rights to the contents of this page are reserved by the publisher"
    rows = [(k, f"{common}\nown line number {k * 7919:09d} of the document\n{common if k % 3 else common + '!'}") for k in range(200)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)
    assert sum(t.count(common) for t in got.values()) == 1


def test_lines_far_apart_in_a_hot_key_stay(spark):
    """Many lines that share all but a word of their own are no near-duplicates."""
    draw = random.Random(4)
    words = [draw.choice(WORDS) for _ in range(20)]
    lines = []
    for k in range(60):
        own = list(words)
        own[draw.randrange(20)] = f"own{k:03d}{k * 7919:06d}"
        lines.append(" ".join(own))
    got = line_dedup.dedup_lines(frame(spark, list(enumerate(lines))))
    assert got.agg(F.sum("n_removed")).first()[0] == 0


def test_windows_are_the_nodes_of_the_cartesian_tree():
    draw = np.random.default_rng(5)
    for n in (10, 46, 47, 300):
        g = draw.integers(0, 50 if n == 300 else 10**9, n).astype(np.uint64)
        want = set()
        for c in range(n):
            lo = c
            while lo and g[lo - 1] > g[c]:
                lo -= 1
            hi = c
            while hi < n - 1 and g[hi + 1] >= g[c]:
                hi += 1
            if hi - lo + 1 >= 46 and not (c and g[c - 1] == g[c]):
                want.add((lo, c, hi))
        assert {tuple(map(int, x)) for x in zip(*substring_dedup.windows(g, 46), strict=True)} == want


def test_repeated_passages_go_and_the_rest_stays(spark):
    draw = random.Random(8)
    passage, edited = prose(draw, 80).split(), None
    edited = list(passage)
    edited[40] = "changed"
    fresh = lambda n: " ".join(f"u{draw.randrange(10**9)}" for _ in range(n))
    rows = [(1, f"{fresh(30)} {' '.join(passage)} {fresh(20)}"), (2, f"{fresh(10)}\n{' '.join(passage)}\n{fresh(25)}"), (3, f"{fresh(40)} {' '.join(edited)}"), (4, fresh(200)), (5, f"{fresh(20)} {' '.join(passage[:30])}"), (6, None), (7, "few words")]
    rows += [(k, f"{fresh(15)} {' '.join(passage)}") for k in range(10, 60)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_passages(frame(spark, rows)).collect()}
    assert got[1]["spans"] == [] and got[2]["spans"] == [[10, 89]] and got[3]["spans"] == [[40, 119]]
    assert all(got[k]["n_removed"] == 0 and got[k]["text"] == dict(rows)[k] for k in (4, 5, 6, 7))
    assert all(got[k]["spans"] == [[15, 94]] for k in range(10, 60))
    assert got[2]["text"].split() == dict(rows)[2].split()[:10] + dict(rows)[2].split()[90:]


def test_recall_of_repeated_passages_against_all_pairs(spark):
    """Passages of 50 to 300 words in many documents, edited in places: nine in ten words that a comparison of all pairs removes."""
    draw = random.Random(21)
    vocabulary = [f"v{k}" for k in range(3000)]
    fresh = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passages = [fresh(draw.choice([50, 60, 80, 120, 300])) for _ in range(25)]
    rows = []
    for k in range(160):
        text = fresh(draw.randint(20, 150))
        for p in draw.sample(passages, draw.choice([0, 1, 1, 2])):
            own = list(p)
            for _ in range(draw.choice([0, 0, 1, len(p) // 60])):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**9)}"
            text += own + fresh(draw.randint(10, 100))
        rows.append((k, " ".join(text)))
    hashed = [substring_dedup.word_hashes(t) for _, t in rows]
    want = {(k, w) for k in range(len(rows)) for j in range(k) for a, b in substring_dedup.matches(hashed[k], hashed[j], 50, 0.8) for w in range(a, b + 1)}
    got = {(r["doc_id"], w) for r in substring_dedup.dedup_passages(frame(spark, rows)).collect() for a, b in r["spans"] for w in range(a, b + 1)}
    assert len(want) > 5000
    print("recall", len(got & want) / len(want), "precision", len(got & want) / len(got))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.98 * len(got)


@pytest.mark.parametrize("parts", [6, 90])
def test_earlier_holders_of_a_part_hide_no_passage(spark, parts):
    """Documents with 35 words of a passage, too few to match, stand before two that have all of it."""
    draw = random.Random(parts)
    fresh = lambda n: [f"u{draw.randrange(10**9)}" for _ in range(n)]
    passages, rows = [fresh(60) for _ in range(12)], []
    for p in passages:
        for k in range(parts):
            at = (k * 25 // (parts - 1)) if k else 0
            rows.append((len(rows), " ".join(fresh(50) + p[at : at + 35] + fresh(50))))
    for p in passages + passages:
        rows.append((len(rows), " ".join(fresh(20) + p + fresh(20))))
    got = {r["doc_id"]: r["spans"] for r in substring_dedup.dedup_passages(frame(spark, rows)).collect()}
    assert {k for k, x in got.items() if x} == set(range(len(rows) - 12, len(rows)))
    assert all(got[k] == [[20, 79]] for k in range(len(rows) - 12, len(rows)))


@pytest.mark.parametrize("block", [7])
def test_blocks_of_a_large_key_meet(spark, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    test_earlier_holders_of_a_part_hide_no_passage(spark, 30)


def plain_near(rows, similarity=0.8):
    def five(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    kept = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = five(t)
        if not any(len(s & x) >= similarity * len(s | x) for _, _, x in kept):
            kept.append((i, t, s))
    return sorted(((i, t) for i, t, _ in kept), key=repr)


def test_near_duplicates_of_the_pipeline_are_brute_force(spark, sf):
    """Copies edited to either side of 0.8, chains of them, and rows that share an id or have none."""
    import corpus_pipeline

    draw = random.Random(12)
    rows = []
    for n in (100, 300, 1000):
        for _ in range(6):
            text = prose(draw, n).split()
            rows.append((len(rows), " ".join(text)))
            for edits in (1, 3, n // 100 * 2, n // 100 * 6):
                other = list(text)
                for k in draw.sample(range(n), edits):
                    other[k] = f"edit{draw.randrange(10**9)}"
                rows.append((len(rows), " ".join(other)))
                text = draw.choice([text, other])
    draw.shuffle(rows)
    rows += [(500, prose(draw, 60)), (500, prose(draw, 60)), (None, prose(draw, 60)), (None, prose(draw, 60)), (501, "one two"), (502, "One  two"), (503, "one")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), sf).collect()
    want = plain_near(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == want
    assert 20 < len(want) < len(rows) - 20


def test_overlaps_are_sizes_of_intersections(monkeypatch):
    monkeypatch.setattr(near_dedup, "_COLUMNS", 16)
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 90, n)).astype(np.uint32) for n in (0, 1, 7, 30, 60, 200)]
    plain = lambda a, b: [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert near_dedup.overlaps(sets[:4], sets[2:]).tolist() == plain(sets[:4], sets[2:])
    within = near_dedup.overlaps(sets)
    assert np.triu(within, 1).tolist() == np.triu(plain(sets, sets), 1).tolist()
    assert not near_dedup.overlaps([sets[0]], [sets[0]]).any()


def test_large_keys_of_like_and_unlike_documents_are_brute_force(spark, monkeypatch):
    """One text in 160 forms, edited more and less: keys far larger than a front, whose members are near some and far from others."""
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    monkeypatch.setattr(near_dedup, "FRONT", 6)
    draw = random.Random(31)
    base, rows = prose(draw, 120).split(), []
    for i in range(160):
        text = list(draw.choice([base, base, rows[-1][1].split()]) if rows else base)
        for _ in range(draw.choice([0, 1, 1, 2, 4])):
            text[draw.randrange(120)] = f"edit{draw.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    draw.shuffle(rows)
    got = near_dedup.keep(frame(spark, rows)).collect()
    want = plain_near(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == want
    assert 12 < len(want) < 150


def test_queries_return_their_columns(spark, sf):
    from talkloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, columns in {"op7_line_dedup": "doc_id n_lines n_removed n_chars text_crc32", "op10_substring_dedup": "doc_id n_words n_removed spans n_chars text_crc32", "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op1_simhash": "doc_id fingerprint component_id"}.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.columns == columns.split() and df.count() == docs
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_lines(list(texts.items()))
    for r in queries.QUERIES["op7_line_dedup"](spark, sf).collect():
        assert r["text_crc32"] == zlib.crc32(want[r["doc_id"]].encode())


def test_line_length_needs_no_copy_of_the_line(spark):
    """Each of three passes replaced the white space of every line to measure it; equal lengths, read from the first characters."""
    draw = random.Random(3)
    lines = ["".join(draw.choice(" \t\x0b\x0c\r\x1c\x85\u00a0ab\U0001f600é") for _ in range(draw.randrange(24))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in [*lines, "", "a" * 5000, " " * 5000 + "b"]], "line string")
    for least in (0, 1, 2, 7, 16):
        plain = F.length(F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))) >= least
        assert df.where(~line_dedup._long_enough(F.col("line"), least).eqNullSafe(plain)).count() == 0
    rows = line_dedup.occurrences(df.select(F.lit(1).alias("doc_id"), F.col("line").alias("text")), "doc_id", "text", 16)
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_texts_in_a_row_are_those_of_each(spark):
    """Windows, words and shingles of many texts at once; before, some 130 calls of numpy for each text."""
    draw, least = np.random.default_rng(5), 9
    rows = [draw.integers(1, 40, n).astype(np.uint64) * substring_dedup._ODD for n in (9, 30, 200, 9, 77)]
    row = np.concatenate([np.append(x, np.uint64(0)) for x in rows])
    got = sorted(zip(*(x.tolist() for x in substring_dedup.windows(row, least, walls=True)), strict=True))
    want, at = [], 0
    for x in rows:
        want += [tuple(at + v for v in w) for w in zip(*(y.tolist() for y in substring_dedup.windows(x, least)), strict=True)]
        at += len(x) + 1
    assert got == sorted(want) and want
    texts = [None, "", "a B  c", "one two three four five six\ufffd", "x", " ".join(map(str, range(150)))] * 30
    words, sizes = substring_dedup.hashed_together(texts)
    for text, n, end, s in zip(texts, sizes, np.cumsum(sizes), substring_dedup.shingled(words, sizes), strict=True):
        assert (words[end - n : end] == substring_dedup.word_hashes(text)).all() and (s == substring_dedup.shingles(substring_dedup.word_hashes(text))).all()
    found = substring_dedup.window_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id", "text", 1, 46)
    assert {r["id"] for r in found.collect()} == {k for k, t in enumerate(texts) if len((t or "").split()) >= 50}
    assert substring_dedup.without(" é one\t two  日本 x ", [(1, 1), (3, 3)]) == " é \t two   x "


def test_passages_leave_no_windows_and_nothing_shuffled(spark):
    """All windows and those of shared minima stayed in the shared folder, and what had been shuffled until the driver collected its garbage."""
    draw = random.Random(4)
    common_part, other = prose(draw, 70), prose(draw, 70)
    rows = [(k, f"{prose(draw, 40)} {common_part if k % 2 else other} {prose(draw, 30)}") for k in range(60)]
    docs = frame(spark, rows)
    common.ensure_checkpoint_dir(spark)
    folder = re.sub(r"^file:/*", "/", spark.sparkContext.getCheckpointDir())
    local = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    kept = lambda: {x for x in os.listdir(folder) if x.startswith(("windows-", "passages-"))}
    shuffled = lambda: {x for top in local for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, before, conf = kept(), shuffled(), spark.conf.get(key)
    out = substring_dedup.dedup_passages(docs)
    for _ in range(50):  # they go in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert kept() == had and not left and spark.conf.get(key) == conf
    first = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in out.collect())
    assert [n > 0 for _, n, _ in first] == [k > 1 for k in range(60)]
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in out.collect()) == first


def test_snippets_are_no_larger_than_the_texts(spark):
    """They were eight bytes a word, which do not compress; a slice of the text has the same words."""
    text = " A b\tc  dé " * 40 + "last"
    texts = spark.createDataFrame([(1, text)], "lead long, text string")
    spans = "array<struct<c:int,lc:int,l:int,r:int>>"
    pairs = spark.createDataFrame([(2, 1, [(40, 30, 20, 90), (60, 50, 20, 95)]), (3, 1, [(5, 150, 0, 70)]), (4, 1, [(0, 158, 0, 0)])], f"id long, lead long, spans {spans}")
    got = {r["id"]: bytes(r["words"]) for r in substring_dedup.snippets(pairs, texts).collect()}
    words = substring_dedup.word_hashes(text)
    for k, (a, b) in {2: (10, 91), 3: (145, 161), 4: (158, 161)}.items():
        if k in got:
            own, _ = substring_dedup.hashed_together([got[k]])
            assert (own == words[a:b]).all() and len(got[k]) < 4 * len(own)
    assert set(got) == {2, 3, 4}
