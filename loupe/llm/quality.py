"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Every word of a text gives three events: the word, its shape (runs of lower case, capitals, digits,
other letters and each punctuation mark, collapsed) and the pair of the previous shape
and its own with a mark for an equal previous word. Events are hashed into ``2**bits``
features whose value is their share of the text's words. One weight vector serves all
grades: ``P(grade > k) = sigmoid(score - threshold[k])``; from the ordered thresholds follow
the expected grade and the tail probability that selects documents.

Ratings are integers from 0; the grades that occur are used in their order (at most
``max_grades``). Several ratings of one document: the lowest counts. Null ratings are
none. Null and empty texts have the score 0. With fewer than two grades among
the ratings every document gets the smoothed share of each grade. Repeated rows are scored
each; further columns are ignored by ``score_quality`` and kept by ``keep_quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.linear import Ordinal, bounded_sample, fit_ordinal, sigmoid
from loupe.llm.store import written
from loupe.llm.textops import mix, row_groups, span_hashes, utf8, word_bounds

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = ord("a"), ord("A"), ord("0"), 255


#: Bytes of rows whose events are made at once.
GROUP = 2 << 20


@dataclass(frozen=True)
class QualityParams:
    """``max_fit_rows`` bounds the rated documents that are fitted (equal parts for each grade, by key hash)."""
    bits: int = 16
    max_fit_rows: int = 4500
    max_grades: int = 16
    l2: float = 1e-4
    gain: float = 10.0
    max_iter: int = 25
    fit_partitions: int = 8


@dataclass(frozen=True)
class QualityModel:
    """``grades`` are the ratings behind the ordered thresholds."""
    params: QualityParams
    fit: Ordinal
    grades: list[int]


def events(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (words x 3) of the rows of some bytes, and each row's first word (n+1 entries)."""
    starts, ends, first = word_bounds(data, off)
    if not len(starts):
        return np.zeros((0, 3), np.int32), first
    words = span_hashes(data, starts, ends)
    kind = _CLASS[data]
    keep = np.zeros(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.cumsum(keep, dtype=np.int64 if len(data) > 1 << 30 else np.int32) - 1  # of each kept byte in the collapsed text; white space runs stay as separators
    low = place[starts]
    high = np.r_[place[ends - 1] + 1]
    shapes = span_hashes(kind[keep], low, high)
    before, again = np.r_[np.uint64(0), shapes[:-1]], np.r_[False, words[1:] == words[:-1]]
    begin = first[:-1][first[:-1] < first[1:]]
    before[begin], again[begin] = 0, False
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ shapes + again.astype(np.uint64))
    shift = np.uint64(64 - bits)
    salted = [words, mix(shapes ^ np.uint64(0xA5A5A5A5)), mix(pair ^ np.uint64(0x5A5A5A5A5A))]
    return np.stack([(x >> shift).astype(np.int32) for x in salted], 1), first


def _features(params: QualityParams):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = utf8(b.column("text"))
            ids, vals = [], []
            for lo, hi in row_groups(off, GROUP):
                each, first = events(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], params.bits)
                for i in range(hi - lo):
                    got, n = np.unique(each[first[i]:first[i + 1]], return_counts=True)
                    ids.append(got.astype(np.int32).tobytes())
                    vals.append((params.gain * n / max(first[i + 1] - first[i], 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("weight"), pa.array(ids, pa.binary()), pa.array(vals, pa.binary())],
                                             ["doc_id", "y", "weight", "ids", "vals"])
    return run


def fit_quality(docs: DataFrame, ratings: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade)."""
    lowest = (ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("y"))
              .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    found = [r["y"] for r in lowest.select("y").distinct().limit(params.max_grades + 1).collect()]
    if len(found) > params.max_grades:
        raise ValueError(f"more than {params.max_grades} grades")
    sample = bounded_sample(lowest, sorted(found), params.max_fit_rows // max(len(found), 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_fit_rows at most
    feats = rows.mapInArrow(_features(params), "doc_id bigint, y int, weight double, ids binary, vals binary")
    feats = feats.groupBy("doc_id").agg(F.min(F.struct("y", "weight", "ids", "vals")).alias("s")).select("s.*")
    feats = written(feats.repartition(params.fit_partitions), "quality-features").coalesce(params.fit_partitions)
    total = {r["y"]: r["w"] for r in feats.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    grades = sorted(total)
    dim = 1 << params.bits
    if len(grades) < 2:
        n = total.get(grades[0], 0) if grades else 0
        above = (n + 1) / (n + 2) if grades and grades[0] > 0 else 1 / (n + 2)
        return QualityModel(params, Ordinal(np.zeros(dim, np.float32), np.array([-np.log(above / (1 - above))])), [0, max(grades[0], 1) if grades else 1])
    number = F.create_map(*[F.lit(x) for g in grades for x in (g, grades.index(g))])
    feats = feats.withColumn("y", number[F.col("y")])
    fit = fit_ordinal(feats, dim, len(grades), {i: total[g] for i, g in enumerate(grades)}, params.l2, None, params.max_iter)
    return QualityModel(params, fit, grades)


def score_quality(docs: DataFrame, model: QualityModel, least: int = 1) -> DataFrame:
    """(doc_id, text_hash, expected_grade, p_tail) for every row; p_tail: probability of a grade of ``least`` or more."""
    params, grades, th = model.params, model.grades, model.fit.thresholds
    shared = docs.sparkSession.sparkContext.broadcast(model.fit.weights)
    tail = next((k for k, g in enumerate(grades) if g >= least), None)
    gaps = np.diff(grades)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = utf8(b.column("text"))
            score = np.zeros(b.num_rows)
            for lo, hi in row_groups(off, GROUP):
                each, first = events(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], params.bits)
                n = np.diff(first)
                total = np.r_[0, np.cumsum(shared.value[each].sum(1, dtype=float))]
                score[lo:hi] = params.gain * (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
            above = sigmoid(score[:, None] - th[None, :])
            p = np.ones(len(score)) if tail == 0 else np.zeros(len(score)) if tail is None else above[:, tail - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(grades[0] + above @ gaps), pa.array(p)],
                                             ["doc_id", "text_hash", "expected_grade", "p_tail"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, expected_grade double, p_tail double")


def keep_quality(docs: DataFrame, model: QualityModel, least: int = 1, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose tail probability is ``at_least``, with all their columns and in one pass."""
    params, th = model.params, model.fit.thresholds
    shared = docs.sparkSession.sparkContext.broadcast(model.fit.weights)
    tail = next((k for k, g in enumerate(model.grades) if g >= least), None)
    if tail is None:
        return docs.limit(0)
    cut = -np.inf if tail == 0 else th[tail - 1] + np.log(at_least / (1 - at_least))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = utf8(b.column("text"))
            for lo, hi in row_groups(off, GROUP):
                each, first = events(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], params.bits)
                total = np.r_[0, np.cumsum(shared.value[each].sum(1, dtype=float))]
                score = params.gain * (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
                yield b.slice(lo, hi - lo).filter(pa.array(score >= cut))

    return docs.mapInArrow(run, docs.schema)
