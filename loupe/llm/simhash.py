"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z are lower-cased, words are runs outside ``[\\x20\\x09-\\x0D]``, shingles are
``shingle`` consecutive words joined by a space, repeats included (a shorter text is one
shingle; a text without words has fingerprint zero, linked like any other). Bit i is set
if it is set in over half of the shingles' XXH64 values (UTF-8, seed 42).

Linking: the anchors are the codewords of the perfect [63, 57] Hamming code on the lower 63
bits; every fingerprint lies within the covering radius R = 1 of one anchor. Two
fingerprints at most ``max_bits`` apart have a point between them that is within
``ceil(max_bits / 2)`` of both, and that point's anchor is within ``R + ceil(max_bits / 2)``
of both. So it suffices to replicate each distinct fingerprint to all anchors within that
reach (32 for two bits; R + max_bits would reach the same pairs again at 20 times the
rows) and to compare per anchor. An anchor's group is bounded by the ball around a codeword
(4,034 fingerprints for two bits), whatever the corpus; each anchor sends the edges of a
spanning forest, never all its pairs. The code is binary, so a group of exact copies is one
fingerprint, and the components are found on distinct fingerprints.

Null texts count as empty. Rows without doc_id get a fingerprint and link others, but
are no component's smallest id (null if no row with an id is reachable). Repeated rows
come out as often as they go in; further columns are ignored by ``simhash_groups`` and
kept by ``keep_one_per_group``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.components import components
from loupe.llm.store import free_name, one_of_each, repeated_keys, written

N_BITS = 63
LOW = np.uint64((1 << N_BITS) - 1)
#: Parity masks: bit p-1 belongs to check j if bit j of p is set (positions 1..63).
CHECKS = [np.uint64(sum(1 << (p - 1) for p in range(1, N_BITS + 1) if p >> j & 1)) for j in range(6)]
#: Shingles hashed at once; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one whole text."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), 42), "big")
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        part = words[a:a + CHUNK + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle)))
        digests = b"".join([xxh64_digest(b" ".join(r), 42) for r in runs])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) for every row, fp as a signed 64-bit number."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def flips_by_syndrome(reach: int) -> list[np.ndarray]:
    """For each syndrome: the masks of at most ``reach`` bits that lead from such a point to an anchor."""
    out: list[list[int]] = [[] for _ in range(N_BITS + 1)]
    for k in range(reach + 1):
        for ps in combinations(range(1, N_BITS + 1), k):
            syndrome, mask = 0, 0
            for p in ps:
                syndrome ^= p
                mask |= 1 << (p - 1)
            out[syndrome].append(mask)
    return [np.array(m, np.uint64) for m in out]


def anchor_rows(fps: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, fp) for every anchor within reach of each fingerprint."""
    reach = 1 + (max_bits + 1) // 2

    def run(batches):
        import pyarrow as pa

        flips = flips_by_syndrome(reach)
        for b in batches:
            x = b.column("fp").to_numpy().view(np.uint64)
            syndrome = np.zeros(len(x), np.uint8)
            for j, check in enumerate(CHECKS):
                syndrome |= (np.bitwise_count(x & check) & 1) << j
            for at in range(0, len(x), 4096):
                s, y = syndrome[at:at + 4096], x[at:at + 4096]
                n = np.array([len(flips[i]) for i in s])
                fp = np.repeat(y, n)
                anchor = (fp ^ np.concatenate([flips[i] for i in s])) & LOW
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of fingerprints linked by at most ``max_bits`` differing bits."""
    left, right, todo = [], [], fps
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            node = queue.pop()
            near = np.bitwise_count(todo ^ node) <= max_bits
            if near.any():
                found, todo = todo[near], todo[~near]
                left.append(np.full(len(found), node))
                right.append(found)
                queue.extend(found)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def compare_per_anchor(rows: DataFrame, max_bits: int) -> DataFrame:
    """Forest edges (u, v) of each anchor's group; groups stream through sorted partitions."""
    def edges(a, f):
        """Of whole groups: anchors a (sorted) and fingerprints f."""
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[cut, len(a)])
        two = cut[size == 2]
        hit = np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits
        left, right = [f[two[hit]]], [f[two[hit] + 1]]
        for s, n in zip(cut[size > 2], size[size > 2]):
            u, v = forest(f[s:s + n], max_bits)
            left.append(u)
            right.append(v)
        u, v = np.concatenate(left), np.concatenate(right)
        if len(u):
            u, v = np.unique(np.stack([u, v], 1), axis=0).T
        return u, v

    def run(batches):
        import pyarrow as pa

        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            a = np.concatenate([held_a, b.column("anchor").to_numpy()])
            f = np.concatenate([held_f, b.column("fp").to_numpy().view(np.uint64)])
            last = int(np.searchsorted(a, a[-1], "left"))  # the last group may go on in the next batch
            held_a, held_f = a[last:], f[last:]
            if last:
                yield _edge_batch(pa, *edges(a[:last], f[:last]))
        if len(held_a):
            yield _edge_batch(pa, *edges(held_a, held_f))

    parts = rows.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return parts.mapInArrow(run, "u bigint, v bigint")


def _edge_batch(pa, u, v):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, text_hash, fp, least) for every row; least: smallest (doc_id, text_hash) of its component."""
    each = written(fingerprints(docs, shingle), "fingerprints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    nodes = written(each.groupBy("fp").agg(least.alias("least")), "distinct-fingerprints")
    edges = compare_per_anchor(anchor_rows(nodes, max_bits), max_bits).distinct()
    roots = components(edges)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    best = written(rooted.groupBy("root").agg(F.min("least").alias("least")), "component-ids")
    of_fp = written(rooted.drop("least").join(best, "root").select("fp", "least"), "fingerprint-components")
    return each.join(of_fp, "fp")


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    return _grouped(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest (doc_id, hash of the text), and all its columns.

    Of rows that repeat both, one stays. Rows without doc_id belong to no group here and stay.
    """
    grouped = written(_grouped(docs, shingle, max_bits), "grouped")
    keep = grouped.filter("doc_id = least.doc_id AND text_hash = least.text_hash").select("doc_id", "text_hash")
    again = repeated_keys(keep, ["doc_id", "text_hash"])
    mine = free_name(docs, "_text_hash")
    hashed = docs.filter("doc_id IS NOT NULL").withColumn(mine, F.xxhash64("text"))
    keep = written(keep.distinct().withColumnRenamed("text_hash", mine), "group-keepers")
    kept = hashed.join(keep, ["doc_id", mine], "left_semi")
    one = one_of_each(kept, ["doc_id", mine], None if again is None else again.withColumnRenamed("text_hash", mine))
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))
