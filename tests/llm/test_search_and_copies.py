"""Top-k search, exact and near duplicates and line deduplication against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import near_duplicates
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.content_dedup import exact_duplicates
from ledgerloom.llm.line_dedup import keep_bitmaps, kept_lines, line_digests, pack, without_frequent_lines
from ledgerloom.llm.near_duplicates import near_duplicate_groups, without_near_duplicates
from ledgerloom.llm.runtime import Stored
from ledgerloom.llm.simhash import BKTree, fingerprint, shingle_hashes, simhash_components, words_of
from ledgerloom.llm.voronoi_knn import sent_shares, voronoi_top_k

SPACE = re.compile("[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], DOCS)


def words(rng, n):
    return " ".join(rng.choice(["ba", "bo", "cu", "de", "fi"]) + rng.choice(["la", "mi", "no", "ru", "st"]) + str(rng.randint(0, 40)) for _ in range(n))


def test_top_k_equals_brute_force_with_ties_and_bad_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.126, 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # a hot vector
    bad = [(2000, None), (2020, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (2040, [math.nan] * 6), (2060, [math.inf] + [0.0] * 5), (None, [0.1] * 6)]
    other = [(3000, [0.5, 0.5]), (3001, [0.25, 0.5])]  # vectors of another length meet only each other
    table = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<float>").withColumn("grp", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi_top_k(table, F.col("vec_id") % 20 == 0, k=5, pivots=8, points_per_block=64, queries_per_group=10).collect()}
    ints = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows + other}
    want = {}
    for q in ints:
        if q % 20 == 0:
            scored = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:5]
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(scored)}
    assert got == want


def brute_top_k(rows, k):
    """Sorted (query_id, rank, vec_id, score); each distinct row whose id is a multiple of 20 asks."""
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ints if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ints if c != q)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_with_repeated_ids(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.126, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(20, [4.0, -4.0, 4.0, -4.0, 4.0, -4.0])] * 50  # copies of a query, nearest to their pivot
    rows += [(40, [4.0 + j / 64, -4.0, -4.0, -4.0, 4.0, 4.0]) for j in range(30)]  # one id, other vectors, several cells
    rows += [(501, [0.5] * 6)] * 9  # a repeated candidate counts each time
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = voronoi_top_k(table, F.col("vec_id") % 20 == 0, k=5, pivots=8, points_per_block=64, queries_per_group=10).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 5)


def test_top_k_sends_only_what_bounds_reach(spark):
    """Tight clusters: a query needs its own cluster and little else."""
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(24, 16)) * 2
    rows = [(i, [float(x) for x in (centres[i % 24] + rng.normal(size=16) * 0.05).astype(np.float32)]) for i in range(2400)]
    rows += [(5000, [2.0**25] + [0.0] * 15), (5001, [-1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    options = {"k": 5, "pivots": 24, "points_per_block": 64, "queries_per_group": 8}
    got = voronoi_top_k(table, F.col("vec_id") % 20 == 0, **options).filter("query_id < 5000").collect()
    assert sorted(map(tuple, got)) == [r for r in brute_top_k(rows, 5) if r[0] < 5000]
    points, queries = sent_shares(table, F.col("vec_id") % 20 == 0, **options)
    assert points < 0.3 and queries < 0.3, (points, queries)


def test_top_k_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert voronoi_top_k(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_exact_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, rng.choice(["a b", "a  b", "a\tb", "c", "", None, " ", "  \n", "é x", "é\x0bx", "e x", "hot copy " * 50])) for i in range(300)]
    texts += [(7, "c"), (7, "c"), (None, "lonely"), (None, "lonely")]
    got = exact_duplicates(docs_frame(spark, texts).withColumn("h", F.lit(1)).withColumn("norm", F.lit("clash")).repartition(7)).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    assert len(got) == len(texts)
    by_digest = {hashlib.sha256(n.encode()).hexdigest(): ids for n, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert set(kept.values()) == {1}
    assert exact_duplicates(docs_frame(spark, []).limit(0)).count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    fps = list({rng.getrandbits(64) & 0xFF00FF for _ in range(400)})
    tree = BKTree()
    for fp in fps:
        tree.add(fp)
    for q in fps[:50]:
        assert sorted(tree.within(q, 3)) == sorted(f for f in fps if (f ^ q).bit_count() <= 3)
    for q in [rng.getrandbits(64) & 0xFF00FF for _ in range(50)]:
        distance = min((f ^ q).bit_count() for f in fps)
        assert distance == 0 or tree.nearest(q, distance - 1) is None
        assert (tree.nearest(q, distance + 1) ^ q).bit_count() == distance


def test_fingerprints_follow_their_definition():
    rng = random.Random(4)
    for text in ["", "  \n", "One", "one TWO", "a b c", words(rng, 200), "x " * 70_000]:
        w = [x.lower() for x in re.findall("[^\x20\x09-\x0d]+", text)]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if len(hashes) < 1000 else None
        got = fingerprint(shingle_hashes(words_of(text), 3))
        assert want is None or got == want


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowded", [2, 512])
def test_simhash_components_equal_brute_force(spark, crowded):
    rng = random.Random(5)
    base = words(rng, 300).split()
    texts = [(i, words(rng, rng.choice([0, 1, 2, 5, 60]))) for i in range(1, 120)] + [(500, None), (501, " ")]
    for i in range(200, 280):  # a chain of small edits
        base[rng.randrange(len(base))] = f"w{i}"
        texts.append((i, " ".join(base)))
    texts += [(200, texts[-1][1]), (900, texts[-1][1])]
    got = simhash_components(docs_frame(spark, texts).withColumn("fp", F.lit("clash")), crowded=crowded).collect()
    fps = [(i, fingerprint(shingle_hashes(words_of(t or ""), 3))) for i, t in texts]
    roots = components([(m, n) for m, (_, a) in enumerate(fps) for n, (_, b) in enumerate(fps) if m < n and (a ^ b).bit_count() <= 2], range(len(fps)))
    least = {}
    for n, (i, _) in enumerate(fps):
        least[roots[n]] = min(least.get(roots[n], i), i)
    want = sorted((i, f"{fp:016x}", least[roots[n]]) for n, (i, fp) in enumerate(fps))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash_components(docs_frame(spark, []).limit(0)).count() == 0


def shingle_set(text, k=5):
    w = words_of(text or "")
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingle_hashes_tell_shingles_apart():
    rng = random.Random(14)
    for text in ["", "One", "one two THREE", words(rng, 5), words(rng, 3000), "a b " * 400, "b a " * 300 + "aa b"]:
        assert len(near_duplicates.shingle_set(words_of(text), 5)) == len(shingle_set(text))
    one, other = (words_of(words(rng, 400)) for _ in range(2))
    both = np.intersect1d(near_duplicates.shingle_set(one + other, 5), near_duplicates.shingle_set([b"other", *one], 5))
    assert len(both) == len(shingle_set(b" ".join(one).decode()))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [(i, words(rng, rng.randint(0, 150))) for i in range(60)] + [(300, None), (301, ""), (302, "one two"), (303, "ONE  two"), (None, words(rng, 20))]
    base = words(rng, 200).split()
    for i in range(100, 180):  # copies of one base, each with its own edits: alike to the base, less so to each other
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(copy)))
    texts.append((90, " ".join(base)))
    frame = docs_frame(spark, texts).withColumn("node", F.lit("clash")).withColumn("_rows", F.lit(1))
    sets = [shingle_set(t) for _, t in texts]
    same = lambda a, b: a == b or (a and b and len(a & b) / len(a | b) >= 0.8)
    roots = components([(m, n) for m in range(len(sets)) for n in range(m) if same(sets[m], sets[n])], range(len(sets)))
    want = {}
    for n, (i, _) in enumerate(texts):
        want.setdefault(roots[n], []).append(i)
    got = {}
    for r in near_duplicate_groups(frame).collect():
        got.setdefault(r["group"], []).append(r["doc_id"])
    order = lambda groups: sorted(map(str, (sorted(g, key=str) for g in groups.values())))
    assert order(got) == order(want)
    kept = without_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((min(g, key=lambda i: (i is None, i)) for g in want.values()), key=str)


def test_near_duplicates_with_distant_fingerprints(spark):
    """Texts of 8 and 9 words at a similarity of 0.8 whose fingerprints differ in more than 22 bits."""
    rng, texts = random.Random(16), []
    while len(texts) < 12:
        long = words(rng, 9)
        a, b = (fingerprint(near_duplicates.shingle_set(words_of(t), 5)) for t in (long, long.rsplit(" ", 1)[0]))
        if (a ^ b).bit_count() > 22:
            texts += [(len(texts), long), (len(texts) + 1, long.rsplit(" ", 1)[0])]
    got = near_duplicate_groups(docs_frame(spark, texts)).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(i, i - i % 2) for i, _ in texts}


def test_repeated_rows_leave_one_near_duplicate(spark):
    frame = docs_frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "")])
    assert sorted(r["doc_id"] for r in without_near_duplicates(frame).collect()) == [1, 3]
    assert without_near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [3, 211])
def test_a_large_near_group_over_blocks_and_partitions(spark, monkeypatch, partitions):
    """Copies of one base with many edits each: some link, others are left apart and meet every block."""
    monkeypatch.setattr(near_duplicates, "BLOCK_HASHES", 2000)
    rng = random.Random(12)
    base, texts = words(rng, 120).split(), []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(copy[: rng.randint(90, 120)])))
    texts += [(1000 + i, texts[i][1]) for i in range(20)] + [(2000 + i, words(rng, 40)) for i in range(20)]
    sets = [shingle_set(t) for _, t in texts]
    roots = components([(m, n) for m in range(len(sets)) for n in range(m) if len(sets[m] & sets[n]) / len(sets[m] | sets[n]) >= 0.8], range(len(sets)))
    least = {}
    for n, (i, _) in enumerate(texts):
        least[roots[n]] = min(least.get(roots[n], i), i)
    assert 25 < len(least) < 170
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = near_duplicate_groups(docs_frame(spark, texts).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == sorted((i, least[roots[n]]) for n, (i, _) in enumerate(texts))


@pytest.mark.parametrize("at_once", [0, 100_000])
def test_components_of_hubs_paths_and_loops(spark, at_once):
    rng = random.Random(13)
    edges = [(7, 7)] + [(-5, i) for i in range(10, 3000)] + [(10_000 - i, 9_999 - i) for i in range(300)]
    edges += [(rng.randrange(20_000, 21_000), rng.randrange(20_000, 21_000)) for _ in range(500)] + [(-5, 10)] * 100
    rng.shuffle(edges)
    nodes = {n for e in edges for n in e}
    want = {(n, r) for n, r in components(edges, nodes).items() if n != r}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {tuple(r) for r in connected_components(frame, Stored(spark), at_once).collect()} == want
    assert connected_components(frame.limit(0), Stored(spark), at_once).count() == 0


LINES = ["Common line", "  common LINE\t", "License: MIT", "", "   ", "Ärger", "ÄRGER"]


def brute_lines(texts, least=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for n, (i, t) in enumerate(texts):
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add((i, t))
    return {i: [line for line in (t or "").split("\n") if not (key(line) and len(found[key(line)]) >= least)] for i, t in texts}


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_line_dedup_equals_brute_force(spark, partitions):
    rng = random.Random(7)
    texts = [(i, "\n".join(rng.choice([*LINES, f"own {i}", f"own {i}", f"shared {i % 30}"]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    texts += [(500, None), (501, ""), (502, "\n\n"), (503, "common line\n" * 3000)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = docs_frame(spark, texts).withColumn("doc", F.lit("clash")).withColumn("h1", F.lit(1))
        got = {r["doc_id"]: r for r in line_digests(frame).collect()}
        cut = {r["doc_id"]: r for r in without_frequent_lines(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, kept in brute_lines(texts).items():
        text = dict(texts)[i] or ""
        assert got[i]["n_lines"] == text.count("\n") + 1
        assert got[i]["n_dropped"] == text.count("\n") + 1 - len(kept)
        assert got[i]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert (cut[i]["text"] or "") == "\n".join(kept)
    assert cut[500]["text"] is None and cut[503]["n_chars"] == len(cut[503]["text"])


def test_line_dedup_of_empty_tables_and_bitmaps(spark):
    assert line_digests(docs_frame(spark, []).limit(0)).count() == 0
    assert keep_bitmaps(docs_frame(spark, [(1, "a"), (2, "b")])).count() == 0
    for drops in ([0], [1, 3], [0, 1, 2, 8], [40]):
        lines = [f"l{i}" for i in range(50)]
        assert kept_lines("\n".join(lines), pack(np.array(drops))) == [x for i, x in enumerate(lines) if i not in drops]
