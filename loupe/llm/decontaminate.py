"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and characters beyond ASCII, after lower-casing; in scripts
written without spaces each character is a token. A
mask marks the positions of a short run of tokens that are hashed; the others may differ, so
a seed survives substitutions between its marked positions. Hashes of all masks at all
positions of the benchmark items are joined with those of the documents, and around
every hit the two texts are compared token by token on the hit's diagonal: a document leaks an
item if some ``overlap`` aligned tokens (the whole item if it has fewer) agree in at
least ``share`` of their positions. Items shorter than the masks get masks of their own length
(all tokens up to four; beyond, one mask for each choice of blocks that substitutions may spoil), so every item
of a token or more is looked for. Documents are hashed only by masks that some item uses.

Scale: a Bloom filter of the benchmark's hashes (fixed size, whatever the benchmark) is
applied where the documents are read, so only hits and the tokens around them are
shuffled. Hits are joined on the hash and verified pairs on the item, both sides shuffled,
so that an item copied into a third of all documents can be split; a filter that
fills up lets more hits through and changes no result.

Null texts and items without a token match nothing. Documents are told apart by doc_id
and text, items by item_id and text; ids may be null or repeated. Further columns are ignored by
``leaks`` and kept by ``drop_leaking``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.store import free_name, written
from loupe.llm.textops import IS_TOKEN, cut_unspaced, mix, row_groups, span_hashes, utf8, word_bounds


#: Tokens after which a stretch of hits is cut.
_STRETCH = 256


@dataclass(frozen=True)
class SeedParams:
    """``masks``: 1 marks a hashed position, 0 an ignored one; all of one length.

    Found by enumeration: in windows of 11 to 20 tokens, every choice of substituted positions that
    ``overlap`` and ``share`` allow leaves some mask untouched somewhere.
    """
    masks: tuple[str, ...] = ("00001110111", "11010011100", "11101000011", "00110101101", "00111011010", "11101110000", "11000101011", "11110100100")
    overlap: int = 20
    share: float = 0.8
    filter_bits: int = 26

    @property
    def span(self) -> int:
        return len(self.masks[0])

    def allowed(self, n: int) -> int:
        """Substitutions that a window of ``n`` tokens may hold."""
        return n - ceil(self.share * n - 1e-9)

    def short_masks(self, n: int) -> list[str]:
        """Masks of ``n`` tokens, of which any allowed substitutions leave one untouched."""
        e = min(self.allowed(n), n - 1)
        blocks = np.arange(n) * min(n, 2 * e + 1) // n
        return ["".join("0" if b in spoilt else "1" for b in blocks) for spoilt in combinations(range(blocks[-1] + 1), e)]

    def numbered_masks(self) -> list[tuple[int, str]]:
        """(window, mask) of all masks: those of ``span`` stand for all windows as long or longer."""
        short = [(n, m) for n in range(1, min(self.span, self.overlap + 1)) for m in self.short_masks(n)]
        return [(self.span, m) for m in self.masks] + short

    def windows(self, lengths: np.ndarray) -> np.ndarray:
        """The window whose masks items of these lengths use."""
        return np.minimum(lengths, min(self.span, self.overlap))


def token_hashes(column, lo: int, hi: int, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of rows lo..hi and each row's first token (n+1 entries)."""
    data, off = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
    starts, ends, _ = word_bounds(data, off, IS_TOKEN)
    starts, ends = cut_unspaced(data, starts, ends)
    return span_hashes(data, starts, ends), np.searchsorted(starts, off)


def lowered(column) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    return utf8(pc.utf8_lower(column))


def masked_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the marked tokens at every start (``len - span + 1`` entries)."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, total = 0x9E3779B97F4A7C15, np.full(n, number + 1, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += tokens[j:j + n] * np.uint64(factor)
            factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix(total)


def _seeds(params: SeedParams):
    """Of items: one row per mask and position."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = lowered(b.column("text"))
            for lo, hi in row_groups(off):
                tokens, first = token_hashes(None, lo, hi, data, off)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                window = params.windows(np.diff(first))[row]
                for m, (size, mask) in enumerate(params.numbered_masks()):
                    if not (window == size).any():
                        continue
                    h = masked_hashes(tokens, mask, m)
                    at = np.flatnonzero((window[:len(h)] == size) & (np.arange(len(h)) + size <= first[row[:len(h)] + 1]))
                    item = b.column("item").to_numpy()[lo:hi][row[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(item), pa.array(at - first[row[at]], pa.int32()),
                                                      pa.array(np.full(len(at), m), pa.int32())], ["seed", "item", "item_at", "mask"])
    return run


def _item_tokens(batches):
    import pyarrow as pa

    for b in batches:
        data, off = lowered(b.column("text"))
        tokens, first = token_hashes(None, 0, b.num_rows, data, off)
        each = [tokens[first[i]:first[i + 1]].tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(each, pa.binary())], ["item", "item_tokens"])


def bloom(seeds: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter (two positions for each seed) as 64-bit words; the words are combined by Spark, at most ``2**(bits-6)`` of them."""
    mask = (1 << bits) - 1
    place = F.explode(F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 64 - bits)))
    words = (seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _first_of_each(row: np.ndarray, at: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Which hits are the first of their seed in their row."""
    order = np.lexsort((at, seed, row))
    r, s = row[order], seed[order]
    return order[np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])]]


def _probe(shared, params: SeedParams, used: set[int]):
    """Of documents: one row per stretch of tokens around hits, with the hits (seed, offset in the stretch).

    Of seeds that hold a whole item only the first hit in a document counts. Stretches are cut
    after ``_STRETCH`` tokens, with as much around every hit as before, so that frequent
    hits do not carry a long document each.
    """
    bits, reach = params.filter_bits, params.overlap

    def run(batches):
        import pyarrow as pa

        words = shared.value
        one, low = np.uint64(1), np.uint64(63)
        inside = lambda p: (words[p >> np.uint64(6)] >> (p & low)) & one
        for b in batches:
            data, off = lowered(b.column("text"))
            for lo, hi in row_groups(off):
                tokens, first = token_hashes(None, lo, hi, data, off)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                hit_at, hit_seed = [], []
                for m, (size, mask) in enumerate(params.numbered_masks()):
                    if m not in used:
                        continue
                    h = masked_hashes(tokens, mask, m)
                    at = np.flatnonzero(inside(h & np.uint64((1 << bits) - 1)))
                    at = at[inside(h[at] >> np.uint64(64 - bits)) == 1]
                    at = at[at + size <= first[row[at] + 1]]
                    if size < params.span and "0" not in mask and len(at):
                        at = at[_first_of_each(row[at], at, h[at])]
                    hit_at.append(at)
                    hit_seed.append(h[at])
                if not any(map(len, hit_at)):
                    continue
                at, seed = np.concatenate(hit_at), np.concatenate(hit_seed)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                begin = np.maximum(at - reach, first[row[at]])
                end = np.minimum(at + reach + params.span, first[row[at] + 1])
                apart = np.r_[True, begin[1:] >= np.maximum.accumulate(end)[:-1]]  # never across rows
                block = (at - at[np.flatnonzero(apart)][np.cumsum(apart) - 1]) // _STRETCH
                new = np.flatnonzero(apart | np.r_[True, block[1:] != block[:-1]])
                size = np.diff(np.r_[new, len(at)])
                start, stop = begin[new], np.maximum.reduceat(end, new)
                hits = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array(at - np.repeat(start, size), pa.int32())], ["seed", "at"])
                of = pa.array(row[at[new]] + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(of), b.column("text_hash").take(of), pa.array(start - first[row[at[new]]], pa.int32()),
                     pa.array([tokens[s:e].tobytes() for s, e in zip(start, stop)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)], pa.int32()), hits)],
                    ["doc_id", "text_hash", "start", "tokens", "hits"])
    return run


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, overlap: int) -> tuple[int, int]:
    """Most equal tokens in a window on one diagonal (item position + shift = document position), and the window's length."""
    n = min(overlap, len(item))
    a, b = max(shift, 0), min(len(doc), len(item) + shift)
    if b - a < n or n == 0:
        return 0, n
    same = np.r_[0, np.cumsum(doc[a:b] == item[a - shift:b - shift])]
    return int((same[n:] - same[:-n]).max()), n


def _verify(params: SeedParams):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [best_overlap(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), s, params.overlap)
                   for d, i, s in zip(b.column("tokens").to_pylist(), b.column("item_tokens").to_pylist(), b.column("shift").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("item"), pa.array([g[0] for g in got], pa.int32()),
                                              pa.array([g[1] for g in got], pa.int32())], ["doc_id", "text_hash", "item", "n_equal", "n_compared"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """(doc_id, text_hash, item_id, n_equal, n_compared) for every document and item that overlap: the best window."""
    spark = docs.sparkSession
    items = benchmark.filter("text IS NOT NULL").select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    items = items.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("text").alias("text"))
    seeds = written(items.select("item", "text").mapInArrow(_seeds(params), "seed bigint, item bigint, item_at int, mask int").distinct(), "benchmark-seeds")
    used = {r.mask for r in seeds.select("mask").distinct().collect()}  # at most the number of masks
    shared = spark.sparkContext.broadcast(bloom(seeds, params.filter_bits))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = written(hashed.mapInArrow(_probe(shared, params, used), "doc_id bigint, text_hash bigint, start int, tokens binary, hits array<struct<seed:bigint,at:int>>"), "hits")
    stretch = ["doc_id", "text_hash", "start"]
    each = found.select(*stretch, F.inline("hits"))
    pairs = written(each.join(seeds, "seed").select(*stretch, "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "diagonals")
    texts = written(items.select("item", "text").mapInArrow(_item_tokens, "item bigint, item_tokens binary"), "benchmark-tokens")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in stretch]
    both = (pairs.alias("p").join(found.dropDuplicates(stretch).alias("f"), same[0] & same[1] & same[2])
            .select("p.doc_id", "p.text_hash", "p.item", "p.shift", "f.tokens"))
    both = written(both, "stretches").join(texts, "item")
    checked = both.select("doc_id", "text_hash", "item", "shift", "tokens", "item_tokens").mapInArrow(
        _verify(params), "doc_id bigint, text_hash bigint, item bigint, n_equal int, n_compared int")
    best = (checked.filter(F.col("n_equal") >= F.lit(params.share) * F.col("n_compared")).filter("n_compared > 0")
            .groupBy("doc_id", "text_hash", "item").agg(F.max("n_equal").alias("n_equal"), F.first("n_compared").alias("n_compared")))
    return written(best, "leaks").join(written(items.select("item", "item_id"), "benchmark-ids"), "item").select("doc_id", "text_hash", "item_id", "n_equal", "n_compared")


def plain_lines(text: str = "text") -> Column:
    """The lines of a text as their tokens see them: lower-cased, all that is no token one blank."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.transform(F.split(lower, "[\\n\\r]"), lambda x: F.trim(F.regexp_replace(x, "[^0-9a-z\\x{80}-\\x{10FFFF}]+", " ")))


def item_sizes(benchmark: DataFrame) -> DataFrame:
    """``benchmark`` (text) with the number of tokens of each item, ``n``."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = lowered(b.column("text"))
            _, first = token_hashes(None, 0, b.num_rows, data, off)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("text"), pa.array(np.diff(first), pa.int32())], ["item_id", "text", "n"])

    items = benchmark.select("item_id", "text")
    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, text string, n int")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams(), alone: int = 5) -> DataFrame:
    """``docs`` without the rows that leak an item, with all their columns.

    An item of fewer than ``alone`` tokens (a word, a name, a short answer) stands in clean texts too; it is leaked only
    by a text that holds it as a whole line.
    """
    items = written(item_sizes(benchmark), "benchmark-sizes")
    long = leaks(docs, items.filter(F.col("n") >= alone), params).select("doc_id", "text_hash")
    short = items.filter((F.col("n") > 0) & (F.col("n") < alone)).select(F.explode(plain_lines()).alias("line")).filter("line <> ''").distinct()
    if not short.isEmpty():
        lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(plain_lines())).alias("line"))
        lines = lines.filter((F.col("line") != "") & (F.size(F.split("line", " ")) < alone))
        long = long.unionByName(lines.join(written(short, "short-items"), "line", "left_semi").select("doc_id", "text_hash"))
    key, mine = free_name(docs, "_key"), free_name(docs, "_text_hash")
    bad = written(long.distinct().select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias(mine)), "leaking")
    bad = bad.select(F.struct(key, "none").alias(key), mine)
    hashed = docs.withColumn(key, F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("doc_id").isNull().alias("none"))).withColumn(mine, F.xxhash64("text"))
    return hashed.join(bad, [key, mine], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
