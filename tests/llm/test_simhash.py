import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loupe.llm.components import components
from loupe.llm.simhash import anchor_rows, compare_per_anchor, fingerprint, flips_by_syndrome, forest, keep_one_per_group, simhash_groups


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = text.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_of(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_fingerprint_follows_its_definition():
    for t in ("", None, "One", "one TWO", "a b c", "É é A b c d " * 9, "x " * 200_000):
        assert fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_every_point_reaches_every_anchor_within_reach():
    flips = flips_by_syndrome(2)
    assert [len(f) for f in flips] == [1] + [32] * 63  # a perfect code: 1 + 31 pairs, or the codeword itself


def test_groups_equal_brute_force(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            x = centre
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = compare_per_anchor(anchor_rows(df, 2), 2).distinct()
    at = {x: i for i, x in enumerate(signed)}
    found = [(at[r.u], at[r.v]) for r in edges.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in found)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert groups_of(found, len(fps)) == groups_of(pairs, len(fps))


def test_forest_of_a_dense_group_is_small():
    fps = np.array([1 << b for b in range(60)], np.uint64)  # all pairs are two bits apart
    u, v = forest(fps, 2)
    assert len(u) == 59 and len(set(v.tolist())) == 59


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (-5, 200)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, -5: -5, 200: -5, 201: -5}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_groups(rows, max_bits=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    of = groups_of(pairs, len(rows))
    least = {}
    for (d, _), g in zip(rows, of):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, of)), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash_groups(docs).collect()), key=str)
    assert got == brute_groups(rows)


def test_awkward_rows(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash_groups(awkward).collect()), key=str) == brute_groups(rows)
    assert simhash_groups(no_docs).count() == 0 and keep_one_per_group(no_docs).count() == 0
    kept = keep_one_per_group(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # 2, 3 and 4 have no words and are one group; 5 and 6 are copies; 1 holds two different texts
    assert ids == [1, 1, 2, 5, 7, 8, 9, 10] and kept.filter("doc_id IS NULL").count() == 2


def test_columns_that_clash_are_kept(make_docs):
    docs = make_docs([(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "other words here now"), (3, "other words here now")])
    for c in ("_own_hash", "_text_hash", "_id", "_hash", "_row", "_whole", "count"):
        docs = docs.withColumn(c, F.lit(c))
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r._own_hash, r._text_hash) for r in kept.collect()) == [(1, "_own_hash", "_text_hash"), (3, "_own_hash", "_text_hash")]
