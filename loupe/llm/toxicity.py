"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space runs become one space (one also goes before and
after), and every character n-gram of the chosen lengths is hashed into ``2**bits``
buckets; a feature is the presence of a bucket in the whole text. Each bucket is scaled by
``log(p / q)``, the smoothed shares of toxic and other training texts that hold it, and a
logistic regression is fitted on the scaled features.

Labels: a document counts as toxic if any of its label rows marks it; null marks are no
label. Null texts count as empty; an empty text gets the score of the intercept alone.
Without both classes among the training rows the score is the smoothed share of toxic
rows. Repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.linear import FEATURES, Ordinal, bounded_sample, fit_ordinal, sigmoid
from loupe.llm.store import written

#: Characters hashed at once; bounds memory for very long texts.
PIECE = 1 << 20


@dataclass(frozen=True)
class ToxicityParams:
    """``max_fit_rows`` bounds the labelled rows that are fitted (half for each class, by key hash)."""
    lengths: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    max_fit_rows: int = 3000
    l2: float = 3e-3
    smooth: float = 1.0
    max_iter: int = 20
    fit_partitions: int = 8


def buckets(text: str | None, lengths: tuple[int, ...], bits: int, slot: np.ndarray) -> np.ndarray:
    """Distinct buckets of the text's n-grams; ``slot`` is scratch space of ``2**bits`` int32."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    most, found = max(lengths), []
    for at in range(0, len(codes), PIECE):
        part = codes[at:at + PIECE + most - 1]
        hashes, h = [], part
        for n in range(1, most + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + part[n - 1:]
            if n in lengths:
                own = h[:PIECE] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                hashes.append((own * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
        b = np.concatenate(hashes)
        order = np.arange(len(b), dtype=np.int32)
        slot[b] = order
        found.append(b[slot[b] == order])
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _features(params: ToxicityParams):
    def run(batches):
        import pyarrow as pa

        slot = np.zeros(1 << params.bits, np.int32)
        for b in batches:
            ids = [buckets(t, params.lengths, params.bits, slot).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("weight"), pa.array(ids, pa.binary())], ["doc_id", "y", "weight", "ids"])
    return run


def _log_ratio_counts(bits: int):
    """Per partition: for both classes the weighted count of rows that hold each bucket."""
    def run(batches):
        import pyarrow as pa

        count = np.zeros((2, 1 << bits))
        for b in batches:
            for y, w, ids in zip(b.column("y").to_pylist(), b.column("weight").to_pylist(), b.column("ids").to_pylist()):
                count[y, np.frombuffer(ids, np.int32)] += w
        yield pa.RecordBatch.from_pydict({"count": [count.astype(np.float32).tobytes()]})
    return run


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    fit: Ordinal


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); the caller leaves out held-out rows."""
    y = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
         .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y")))
    y = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = bounded_sample(y, [0, 1], params.max_fit_rows // 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_fit_rows at most
    feats = rows.mapInArrow(_features(params), "doc_id bigint, y int, weight double, ids binary")
    feats = (feats.groupBy("doc_id").agg(F.min(F.struct("y", "weight", "ids")).alias("s"))
             .select("s.y", "s.weight", "s.ids", F.lit(None).cast("binary").alias("vals")))
    feats = written(feats.repartition(params.fit_partitions), "toxicity-features").coalesce(params.fit_partitions)
    total = {r["y"]: r["w"] for r in feats.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    dim = 1 << params.bits
    if len(total) < 2:
        share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
        return ToxicityModel(params, Ordinal(np.zeros(dim, np.float32), np.array([-np.log(share / (1 - share))])))
    got = feats.mapInArrow(_log_ratio_counts(params.bits), "count binary").collect()
    count = np.sum([np.frombuffer(r["count"], np.float32).reshape(2, dim) for r in got], axis=0, dtype=float)
    share = (count + params.smooth) / (np.array([[total[0]], [total[1]]]) + 2 * params.smooth)
    ratio = np.log(share[1] / share[0])
    return ToxicityModel(params, fit_ordinal(feats, dim, 2, total, params.l2, ratio, params.max_iter))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; the weight vector's size is fixed by ``bits``."""
    params, fit = model.params, model.fit
    shared = docs.sparkSession.sparkContext.broadcast(fit.weights)
    bias = -float(fit.thresholds[0])

    def run(batches):
        import pyarrow as pa

        weights, slot = shared.value, np.zeros(1 << params.bits, np.int32)
        for b in batches:
            s = [float(weights[buckets(t, params.lengths, params.bits, slot)].sum(dtype=float)) + bias for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(s))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
