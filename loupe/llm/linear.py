"""Cumulative-link (ordinal logistic) regression over hashed sparse features, fitted by distributed L-BFGS.

A row holds a grade ``0 .. K-1``, a weight and its feature ids with values. All thresholds
share one weight vector: ``P(grade > k) = sigmoid(score - threshold[k])`` with ascending
thresholds; two grades give plain logistic regression. Every evaluation is one Spark job in
which each partition returns its partial loss and gradient; the driver only holds vectors
of the fixed feature dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of a feature table: ids are little-endian int32, vals float32 (null: all ones).
FEATURES = "y int, weight double, ids binary, vals binary"


@dataclass(frozen=True)
class Ordinal:
    """``weights`` by feature id and the K-1 ascending ``thresholds``."""
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(x):
    x = np.asarray(x, float)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1, e) / (1 + e)


def ordered(raw: np.ndarray) -> np.ndarray:
    """Thresholds from the free parameters: the first one, then logs of the gaps."""
    return raw[0] + np.r_[0.0, np.cumsum(np.exp(raw[1:]))]


def bounded_sample(labelled: DataFrame, grades: list[int], per_grade: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_grade`` rows of (key, y, weight) for each grade, by the hash of the key.

    ``labelled`` has one row per key. The weight is the grade's count over its sampled
    count, so the weighted sample keeps the class shares. The result is bounded by
    ``len(grades) * per_grade`` rows whatever the input, hence safe to broadcast.
    """
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect() if r["y"] in grades}
    parts = []
    for g in grades:
        n = counts.get(g, 0)
        if not n:
            continue
        keep = min(1.0, 1.5 * per_grade / n)  # a looser hash cut first, so the final top-k sees few rows
        h = F.xxhash64(F.col(key).cast("string"), F.lit("fit"))
        cut = labelled.filter((F.col("y") == g) & (F.pmod(h, F.lit(1 << 20)) < int(np.ceil(keep * (1 << 20)))))
        part = cut.orderBy(h, key).limit(per_grade).select(key, "y", F.lit(n / min(n, per_grade)).alias("weight"))
        parts.append(part)
    if not parts:
        return labelled.select(key, "y", F.lit(1.0).alias("weight")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _partial(weights, raw, n_grades):
    """The function of one evaluation: partial loss, weight gradient and threshold gradient of a partition."""
    def run(batches):
        import pyarrow as pa

        w, th = weights.value, ordered(raw)
        loss, gw, gt = 0.0, np.zeros(len(w)), np.zeros(n_grades - 1)
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column("y").to_numpy()
            wt = b.column("weight").to_numpy()
            each = [np.frombuffer(x, np.int32) for x in b.column("ids").to_pylist()]
            vals = [None if x is None else np.frombuffer(x, np.float32) for x in b.column("vals").to_pylist()]
            n = np.array([len(x) for x in each])
            ids = np.concatenate(each)
            row = np.repeat(np.arange(len(n)), n)
            v = np.concatenate([np.ones(len(i), np.float32) if x is None else x for i, x in zip(each, vals)])
            s = np.bincount(row, w[ids] * v, len(n))
            lo, hi = np.r_[-np.inf, th][y], np.r_[th, np.inf][y]
            a, c = sigmoid(s - lo), sigmoid(s - hi)
            p = np.maximum(a - c, 1e-12)
            loss -= float(wt @ np.log(p))
            gw -= np.bincount(ids, (wt * (1 - a - c))[row] * v, len(w))
            up, down = wt * a * (1 - a) / p, wt * c * (1 - c) / p
            full = np.bincount(y, up, n_grades)[1:] - np.bincount(y, down, n_grades)[:-1]
            gt += full
        yield pa.RecordBatch.from_pydict({"loss": [loss], "gw": [gw.astype(np.float32).tobytes()], "gt": [gt.tobytes()]})
    return run


def fit_ordinal(features: DataFrame, dim: int, n_grades: int, total: dict[int, float], l2: float = 1e-3,
                scale: np.ndarray | None = None, max_iter: int = 30, tol: float = 1e-3) -> Ordinal:
    """Maximum likelihood with an L2 penalty on the weights before ``scale``.

    ``total`` maps every grade to its summed weight; ``scale`` multiplies each feature
    (its own weight is learnt on the scaled feature). A grade without rows makes its
    neighbouring threshold meaningless, so the caller passes grades that occur.
    """
    sc = features.sparkSession.sparkContext
    scale = np.ones(dim) if scale is None else scale
    mass = float(sum(total.values()))
    above = np.cumsum([total[g] for g in range(n_grades)][::-1])[::-1][1:] / mass
    first = -np.log(above / (1 - above))
    x = np.r_[np.zeros(dim), first[:1], np.log(np.maximum(np.diff(first), 1e-3))]

    def evaluate(x):
        shared = sc.broadcast(x[:dim] * scale)
        raw = x[dim:]
        rows = features.mapInArrow(_partial(shared, raw, n_grades), "loss double, gw binary, gt binary").collect()
        shared.unpersist()
        gw = np.sum([np.frombuffer(r["gw"], np.float32) for r in rows], axis=0, dtype=float) * scale
        gt = np.sum([np.frombuffer(r["gt"]) for r in rows], axis=0)
        # d thresholds / d raw: the first moves all, a gap moves those from its own on
        graw = np.array([gt[i:].sum() for i in range(n_grades - 1)]) * np.r_[1.0, np.exp(raw[1:])]
        loss = sum(r["loss"] for r in rows) / mass + l2 / 2 * float(x[:dim] @ x[:dim])
        return loss, np.r_[gw / mass + l2 * x[:dim], graw / mass]

    loss, g = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        q, alphas = g.copy(), []
        for s, d in reversed(past):
            a = s @ q / (s @ d)
            alphas.append(a)
            q -= a * d
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.abs(g).sum(), 1e-12)
        for (s, d), a in zip(past, reversed(alphas)):
            q += s * (a - d @ q / (s @ d))
        step, slope = 1.0, float(q @ g)
        while True:
            new_loss, new_g = evaluate(x - step * q)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        if new_loss >= loss:
            break
        s, d = -step * q, new_g - g
        if s @ d > 1e-12:
            past = [*past, (s, d)][-8:]
        done = loss - new_loss < tol * max(loss, 1e-9)
        x, loss, g = x + s, new_loss, new_g
        if done:
            break
    return Ordinal((x[:dim] * scale).astype(np.float32), ordered(x[dim:]))
