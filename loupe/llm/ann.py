"""Approximate nearest neighbours by adaptive dimension scan inside probed lists.

Index: vectors are scaled by the largest norm and get one more component that makes them unit vectors, so that
the largest inner product is the smallest distance to a unit query. k-means on a bounded sample of
rows (``fit_bytes``; at most ``max_lists`` centroids, about the square root of the number of rows) gives the lists;
every row is assigned to its nearest centroid. A random rotation spreads a vector's length over all
dimensions; the rotated vectors are stored in column blocks.

Search: a query probes its nearest lists. Within a list the squared distances grow block by block,
for all queries of the list at once. After d of D dimensions a candidate at distance r has at most
``r^2 * Beta(d/2, (D-d)/2)`` of it (the share of a rotated vector's first d dimensions); a candidate whose
partial distance lies beyond that law's 1 - ``alpha`` quantile is abandoned as farther than r, the
query's k-th best so far. Those left after all blocks are scored by the inner product of the original vectors in double precision.
The nearest list is searched first; its k-th best is the bound for all others.

The number of probed lists is measured, not set: for ``tuned_queries`` queries the exact neighbours are
found over all rows, and the fewest lists that hold ``target`` of them are probed. On data without
structure that is a large part of all lists. A query whose probed lists hold fewer than k rows probes more.

Lists are cut into parts of about ``part_rows`` rows, the queries that probe a list likewise, and each pair of parts
is one group, so a list that holds a third of all rows is searched by many tasks.

Defined results: vectors that are null, empty, zero, of another length than most, that hold null or non-finite components or whose
squared norm overflows take no part, nor do rows without vec_id. Of query rows with one vec_id the one with the smallest
hash of its vector is the query; it finds all rows of other ids, repeated rows as often as they occur.
Ties go to the smaller vec_id. Fewer than k candidates are all returned; a query without candidates,
or an empty table, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.store import written

ROWS = "vec_id bigint, vector binary"


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    max_lists: int = 4096
    fit_bytes: int = 16 << 20
    rounds: int = 8
    blocks: int = 4
    alpha: float = 0.001
    tuned_queries: int = 128
    target: float = 0.98
    part_rows: int = 8192
    seed: int = 5


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector: packed doubles) of the rows that take part, and their dimension."""
    sizes = vectors.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    dim = top["d"] if top else 0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.einsum("ij,ij->i", flat, flat)
            good = np.isfinite(norm) & (norm > 0)
            packed = [x.tobytes() for x in np.ascontiguousarray(flat[good])]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(good)), pa.array(packed, pa.binary())], ["vec_id", "vector"])

    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & (F.size("embedding") > 0))
    # null components become NaN, which no norm survives
    filled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), filled.alias("embedding")).mapInArrow(run, ROWS), dim


def matrix(column, dim: int, dtype: str = "<f8") -> np.ndarray:
    """The packed vectors of an Arrow binary column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def unit(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows divided by the largest norm, with the component that makes them unit vectors."""
    x = x / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], 1)


def unit_query(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], 1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of the sampled rows ``x`` (float32)."""
    random = np.random.default_rng(seed)
    centre = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        order = np.argsort(own, kind="stable")
        seen, first = np.unique(own[order], return_index=True)
        centre[seen] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.r_[first, len(x)])[:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = np.einsum("ij,ij->i", centre, centre) / 2
    return np.concatenate([(x[a:a + 4096] @ centre.T - half).argmax(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def beta_quantile(p: float, a: float, b: float) -> float:
    """Quantile of the Beta(a, b) law, on a grid."""
    x = np.linspace(0, 1, 20_001)[1:-1]
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    cumulated = np.cumsum(np.exp(log - log.max()))
    return float(x[min(np.searchsorted(cumulated, p * cumulated[-1]), len(x) - 1)])


def column_cuts(dim: int, blocks: int) -> list[int]:
    return sorted({round(dim * i / blocks) for i in range(blocks + 1)})


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` best (largest score, then smallest id), by query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


def scan(queries, query_ids, bound, vectors, blocks, ids, largest: float, dim: int, turn: np.ndarray, share: list[float], k: int, step: int = 512):
    """The (query, vec_id, score) of one part that may be among each query's ``k`` nearest.

    ``bound``: each query's inner product to beat (-inf: none yet). ``blocks``: the rotated rows' columns, block by block.
    """
    length = np.linalg.norm(queries, axis=1)
    turned = (unit_query(queries) @ turn).astype(np.float32)
    cuts = np.r_[0, np.cumsum([b.shape[1] for b in blocks])]
    parts = [turned[:, a:z] for a, z in zip(cuts, cuts[1:])]
    norms = [np.einsum("ij,ij->i", p, p) for p in parts]
    row_norms = [np.einsum("ij,ij->i", b, b) for b in blocks]
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bound = bound.copy()
    for lo in range(0, len(ids), step):
        hi = min(lo + step, len(ids))
        limit = np.where(np.isfinite(bound), 2 - 2 * bound / (length * largest), np.inf)
        limit = (limit * (1 + 1e-4) + 1e-5).astype(np.float32)  # single precision must not lose a tie
        far = norms[0][:, None] + row_norms[0][None, lo:hi] - 2 * (parts[0] @ blocks[0][lo:hi].T)
        q, x = np.nonzero(far <= (limit * np.float32(share[0]))[:, None])
        far = far[q, x]
        for i in range(1, len(blocks)):
            if len(q) * 4 > len(queries) * (hi - lo):  # most go on: whole products are cheaper than gathered rows
                dense = norms[i][:, None] + row_norms[i][None, lo:hi] - 2 * (parts[i] @ blocks[i][lo:hi].T)
                far = far + dense[q, x]
            else:
                far = far + np.concatenate([norms[i][a] + row_norms[i][lo + b] - 2 * np.einsum("ij,ij->i", parts[i][a], blocks[i][lo + b])
                                            for a, b in ((q[s:s + (1 << 16)], x[s:s + (1 << 16)]) for s in range(0, len(q), 1 << 16))] or [far])
            on = far <= limit[q] * np.float32(share[i])
            q, x, far = q[on], x[on], far[on]
        other = query_ids[q] != ids[lo + x]
        q, x = q[other], x[other] + lo
        score = np.concatenate([(queries[q[s:s + (1 << 16)]] * vectors[x[s:s + (1 << 16)]]).sum(1) for s in range(0, len(q), 1 << 16)] or [np.zeros(0)])
        hit = score >= bound[q]
        best = tuple(np.concatenate(p) for p in zip(best, (q[hit], ids[x[hit]], score[hit])))
        top = best_of(*best, k)
        best = tuple(p[top] for p in best)
        last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True]) if len(top) else top
        full = np.bincount(best[0], minlength=len(queries))[best[0][last]] == k if len(top) else last
        bound[best[0][last][full]] = best[2][last][full]
    return query_ids[best[0]], best[1], best[2]


@dataclass
class Index:
    """``rows``: (list, part, vec_id, vector, block_0 ..); ``parts``: parts of each list; the rest is small and sent to the tasks."""
    rows: DataFrame
    dim: int
    largest: float
    centre: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray
    probes: int
    params: AnnParams


def build_index(vectors: DataFrame, params: AnnParams = AnnParams()) -> Index | None:
    """Index of every usable row of ``vectors`` (vec_id, embedding); None if there is none."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    if not dim:
        return None
    rows = written(rows, "vectors")

    def norms(batches):
        import pyarrow as pa

        most, n = 0.0, 0
        for b in batches:
            x = matrix(b.column("vector"), dim)
            most, n = max(most, float(np.sqrt(np.einsum("ij,ij->i", x, x)).max(initial=0))), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([n], pa.int64())], ["most", "n"])

    r = rows.select("vector").mapInArrow(norms, "most double, n bigint").agg(F.max("most").alias("most"), F.sum("n").alias("n")).first()
    n, largest = r["n"] or 0, r["most"]
    if not n:
        return None
    most = max(1, params.fit_bytes // (8 * dim))
    h = F.xxhash64("vec_id", "vector")
    cut = min(1 << 20, int(1.2 * most / n * (1 << 20)) + 1)
    sample = matrix(rows.filter(F.pmod(h, F.lit(1 << 20)) < cut).limit(most).select("vector").toArrow().column("vector"), dim)
    if not len(sample):
        sample = matrix(rows.limit(1).select("vector").toArrow().column("vector"), dim)
    lists = int(max(1, min(params.max_lists, np.sqrt(n), len(sample) // 8)))
    centre = kmeans(unit(sample, largest).astype(np.float32), lists, params.rounds, params.seed)
    shared = spark.sparkContext.broadcast(centre)
    cuts, seed = column_cuts(dim + 1, params.blocks), params.seed
    names = [f"block_{i}" for i in range(len(cuts) - 1)]

    def assign(batches):
        import pyarrow as pa

        turn = rotation(dim + 1, seed)
        for b in batches:
            x = unit(matrix(b.column("vector"), dim), largest)
            own = nearest(x.astype(np.float32), shared.value)
            turned = (x @ turn).astype(np.float32)
            blocks = [pa.array([y.tobytes() for y in np.ascontiguousarray(turned[:, a:z])], pa.binary()) for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("vec_id"), b.column("vector"), *blocks], ["list", "vec_id", "vector", *names])

    listed = written(rows.mapInArrow(assign, f"list int, {ROWS}, " + ", ".join(f"{c} binary" for c in names)), "listed-vectors")
    sizes = np.zeros(lists, np.int64)
    for s in listed.groupBy("list").count().collect():  # at most max_lists rows
        sizes[s["list"]] = s["count"]
    parts = np.maximum(1, -(-sizes // params.part_rows))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("list"))) if parts.max() > 1 else F.lit(0).cast("bigint")
    index = Index(listed.withColumn("part", part), dim, largest, centre, sizes, parts, lists, params)
    index.probes = probes_needed(index, rows)
    return index


def probes_needed(index: Index, rows: DataFrame) -> int:
    """Lists to probe so that the sampled queries find ``target`` of their exact neighbours (measured over all rows)."""
    p, dim = index.params, index.dim
    if len(index.centre) == 1:
        return 1
    probe = rows.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(p.tuned_queries).toArrow()
    queries, own = matrix(probe.column("vector"), dim), probe.column("vec_id").to_numpy()

    def exact(batches):
        import pyarrow as pa

        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))
        for b in batches:
            x, ids, lists = matrix(b.column("vector"), dim), b.column("vec_id").to_numpy(), b.column("list").to_numpy()
            for a in range(0, len(x), 4096):
                score = queries @ x[a:a + 4096].T
                score[own[:, None] == ids[None, a:a + 4096]] = -np.inf
                few = min(p.k, score.shape[1])
                at = np.argpartition(-score, few - 1, axis=1)[:, :few]
                q = np.repeat(np.arange(len(queries)), few)
                got = (q, ids[a:a + 4096][at.ravel()], score[q, at.ravel()], lists[a:a + 4096][at.ravel()])
                best = tuple(np.concatenate(z) for z in zip(best, got))
                top = best_of(*best[:3], p.k)
                best = tuple(z[top] for z in best)
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in best], ["query", "vec_id", "score", "list"])

    near = index.rows.select("vec_id", "vector", "list").mapInArrow(exact, "query bigint, vec_id bigint, score double, list int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("place", F.row_number().over(w)).filter((F.col("place") <= p.k) & (F.col("score") > float("-inf"))).select("query", "list").toArrow()
    order = probe_order(unit_query(queries), index.centre)
    rank = np.argsort(order, axis=1)
    needed = np.sort(rank[true.column("query").to_numpy(), true.column("list").to_numpy()])
    return int(needed[min(len(needed) - 1, int(np.ceil(p.target * len(needed))) - 1)]) + 1 if len(needed) else 1


def probe_order(queries: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Lists by distance of their centroids, per query."""
    half = np.einsum("ij,ij->i", centre, centre) / 2
    return np.argsort(half - queries.astype(np.float32) @ centre.T, axis=1, kind="stable")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of the index for every row of ``queries`` (vec_id, vector)."""
    p, dim, largest = index.params, index.dim, index.largest
    spark = queries.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    small = spark.sparkContext.broadcast((index.centre, index.sizes))
    probes, k = index.probes, p.k

    def probed(batches):
        import pyarrow as pa

        centre, sizes = small.value
        for b in batches:
            x = matrix(b.column("vector"), dim)
            for a in range(0, len(x), 1024):
                order = probe_order(unit_query(x[a:a + 1024]), centre)
                held = np.cumsum(sizes[order], axis=1) - sizes[order]  # rows of the lists before
                take = (np.arange(order.shape[1]) < probes) | (held <= k)
                q, place = np.nonzero(take & (sizes[order] > 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").slice(a, 1024).take(pa.array(q)), pa.array(order[q, place], pa.int32()), pa.array(place == 0)], ["query_id", "list", "first"])

    plan = written(queries.mapInArrow(probed, "query_id bigint, list int, first boolean"), "probes")
    first = written(_search_lists(index, queries, plan.filter("first"), None), "nearest-lists")
    bounds = written(_top(first, k).groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n"), "bounds")
    rest = _search_lists(index, queries, plan.filter("NOT first"), bounds)
    return _top(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search_lists(index: Index, queries: DataFrame, plan: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Candidates (query_id, vec_id, score) of the planned (query, list) pairs, one group for each pair of parts."""
    p, dim, largest, seed = index.params, index.dim, index.largest, index.params.seed
    cuts = column_cuts(dim + 1, p.blocks)
    names = [f"block_{i}" for i in range(len(cuts) - 1)]
    widths = [z - a for a, z in zip(cuts, cuts[1:])]
    share = [beta_quantile(1 - p.alpha, d / 2, (dim + 1 - d) / 2) for d in cuts[1:-1]] + [1.0]
    asked = {r["list"]: -(-r["count"] // p.part_rows) for r in plan.groupBy("list").count().collect()}  # at most max_lists rows
    lists = len(index.centre)
    query_parts = np.array([asked.get(i, 0) for i in range(lists)], np.int64)

    def of_list(values) -> Column:
        if len(set(values.tolist())) == 1:
            return F.lit(int(values[0]))
        return F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("list"))

    asking = plan.drop("first").withColumn("asks", F.pmod(F.xxhash64("query_id"), of_list(query_parts)))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (of_list(index.parts) - 1).cast("bigint"))))
    asking = asking.join(queries.select(F.col("vec_id").alias("query_id"), "vector"), "query_id")
    asking = asking.join(bounds, "query_id", "left") if bounds is not None else asking.withColumn("bound", F.lit(None).cast("double"))
    rows = index.rows.withColumn("many", of_list(query_parts)).filter("many > 0")
    rows = rows.withColumn("asks", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("many") - 1).cast("bigint")))).drop("many")

    def group(_, left, right):
        import pyarrow as pa

        types = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        blocks = [matrix(right.column(c), w, "<f4") for c, w in zip(names, widths)]
        bound = left.column("bound").fill_null(float("-inf")).to_numpy()
        got = scan(matrix(left.column("vector"), dim), left.column("query_id").to_numpy(), bound, matrix(right.column("vector"), dim), blocks,
                   right.column("vec_id").to_numpy(), largest, dim, rotation(dim + 1, seed), share, p.k)
        return pa.table([pa.array(x) for x in got], schema=types)

    keys = ["list", "part", "asks"]
    return asking.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(group, "query_id bigint, vec_id bigint, score double")


def nearest_neighbours(vectors: DataFrame, every: int = 20, params: AnnParams = AnnParams()) -> DataFrame:
    """The nearest rows of ``vectors`` (vec_id, embedding) for every row whose vec_id is divisible by ``every``."""
    index = build_index(vectors, params)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(index, index.rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vector"))
