import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.llm.ann import AnnParams, beta_quantile, build_index, nearest_neighbours, scan, column_cuts, rotation, search, unit, unit_query

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        other = np.flatnonzero(ids != ids[i])
        best = other[np.lexsort((ids[other], -score[other]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in best]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x)], SCHEMA)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_given_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want, got = exact(ids, x, 20, 20), result(nearest_neighbours(df))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        assert [s for _, s in near] == pytest.approx([x[ids == v][0] @ x[ids == q][0] for v, _ in near], abs=1e-12)


def test_clusters_copies_and_norms(spark):
    """Clustered vectors of very different lengths, a third of them copies of one vector: few lists are probed, ties go to the smaller id."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 3
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.3) * rng.choice([0.1, 1.0, 5.0], (1500, 1))
    x[::3] = x[0]
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(1500)
    df = table(spark, ids, x)
    p = AnnParams(k=10, part_rows=100)
    index = build_index(df, p)
    assert index.parts.max() > 1 and index.sizes.sum() == 1500
    want, got = exact(ids, x, 20, 10), result(nearest_neighbours(df, 20, p))
    assert recall(got, want) >= 0.9
    hot = int(ids[0]) if ids[0] % 20 == 0 else next(int(i) for i, v in zip(ids, x) if i % 20 == 0 and (v == x[0]).all())
    assert [v for v, _ in got[hot]] == [v for v, _ in want[hot]]


def test_adaptive_scan_abandons_and_keeps_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 31))
    q = rng.normal(size=(30, 31))
    largest, turn, cuts = np.linalg.norm(x, axis=1).max(), rotation(32, 1), column_cuts(32, 4)
    turned = (unit(x, largest) @ turn).astype(np.float32)
    blocks = [np.ascontiguousarray(turned[:, a:z]) for a, z in zip(cuts, cuts[1:])]
    share = [beta_quantile(0.999, d / 2, (32 - d) / 2) for d in cuts[1:-1]] + [1.0]
    found = scan(q, np.arange(30) + 10_000, np.full(30, -np.inf), x, blocks, np.arange(4000), largest, 31, turn, share, 5)
    want = [set(np.argsort(-(x @ v))[:5].tolist()) for v in q]
    got = [set(found[1][found[0] == 10_000 + i].tolist()) for i in range(30)]
    assert sum(len(a & b) for a, b in zip(got, want)) >= 0.97 * 150
    bound = np.array([np.sort(x @ v)[-5] for v in q])
    first = ((unit_query(q) @ turn)[:, None, :8] - turned[None, :, :8]) ** 2
    limit = (2 - 2 * bound / (np.linalg.norm(q, axis=1) * largest)) * share[0]
    assert (first.sum(2) > limit[:, None]).mean() > 0.05  # a quarter of the dimensions settles some candidates already
    assert beta_quantile(0.5, 8, 8) == pytest.approx(0.5, abs=1e-3) and beta_quantile(0.95, 1, 1) == pytest.approx(0.95, abs=1e-3)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (20, [0.5, 0.5], 1), (40, None, 1), (60, [], 1), (80, [0.0, 0.0], 1), (100, [1.0, None], 1), (120, [float("nan"), 1.0], 1),
            (140, [float("inf"), 1.0], 1), (160, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (5, [-1.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("list", "part", "vector", "query_id", "rank", "score", "asks", "bound"):
        df = df.withColumn(c, F.lit("clash"))
    got = result(nearest_neighbours(df))
    assert got == {0: [(2, 1.0), (3, 1.0), (20, 0.5), (20, 0.5), (5, -1.0)], 20: [(0, 0.5), (2, 0.5), (3, 0.5), (5, -0.5)]}
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert nearest_neighbours(one).count() == 0 and nearest_neighbours(df.limit(0)).count() == 0
    assert nearest_neighbours(spark.createDataFrame([(0, None, 0), (20, [0.0], 1)], SCHEMA)).count() == 0
    double = spark.createDataFrame([(20, [0.1, 0.2]), (21, [0.3, 0.4])], "vec_id int, embedding array<double>")
    assert result(nearest_neighbours(double)) == {20: [(21, pytest.approx(0.1 * 0.3 + 0.2 * 0.4))]}


def test_lists_that_hold_too_few_are_made_up_for(spark):
    x = np.random.default_rng(1).normal(size=(300, 4))
    index = build_index(table(spark, np.arange(300), x), AnnParams(k=20))
    index.probes = 1
    got = result(search(index, index.rows.filter("vec_id % 20 = 0").select("vec_id", "vector")))
    assert all(len(v) == 20 for v in got.values()) and len(got) == 15
