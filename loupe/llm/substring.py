"""Substring deduplication by relative Lempel-Ziv parsing against an anchored index of all documents.

Reference for a document: every document with a smaller doc_id, of which the index holds the first
occurrence (smallest doc_id, then smallest place) of everything that repeats. Blocks: each window of
``window`` words belongs to the block of its anchor, the smallest hash among its
``seed``-word runs. Equal windows have equal anchors, so whatever a window can match lies
in its own block; looking it up there looks it up in every block. A document is cut into
*phrases*, the maximal runs of windows with one anchor, and parsed in two steps:

1. Phrases that occur whole in an earlier document are copied whole (the inside of a
   factor). The index of a block keeps the first occurrence of each phrase.
2. Where the phrases of a block differ, a factor starts or ends inside: at these factor
   boundaries the first occurrence of each phrase is checked window by window against the
   windows of the block.

Every match carries its place in its source. Matches join greedily into a factor (start, length, source,
source start) as long as they follow one another in the same source too, so a factor is a run that its
source holds at that place; all factors are at least ``window`` words long, shorter ones stay literal. A longer run that
only a later document than the first ones holds is not looked for: it covers the same words. The words that factors
cover are the duplicates, judged on the input. Only hashes, positions and ids of phrases are
shuffled; hot phrases shrink to one row per task before they are, joins on anchors shuffle
both sides so that hot ones can be split. Text is fetched only for documents with factors.

Null texts have no words. Rows without doc_id neither lose words nor serve as reference;
rows that share a doc_id do not serve each other. Repeated rows are parsed once and come out as often as they
go in; further columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.store import one_of_each, repeated_keys, written
from loupe.llm.textops import mix, powers, rolling, row_groups, sliding_min, span_hashes, utf8, word_bounds

PHRASE = "array<struct<anchor:bigint, phrase:bigint, at:int, n:int>>"
_ODD = 0x9FB21C651E98DF25


def phrases(data: np.ndarray, off: np.ndarray, window: int, seed: int):
    """Of some rows' bytes: per phrase its row, anchor, hash, first window (word index within the row) and number of windows; and the words of each row."""
    starts, ends, first = word_bounds(data, off)
    words = span_hashes(data, starts, ends)
    n_words = np.diff(first)
    whole = rolling(words, window)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, n_words
    anchors = sliding_min(rolling(words, seed, 1), window - seed + 1)
    row = np.repeat(np.arange(len(n_words)), n_words)[:len(whole)]
    valid = np.arange(len(whole)) + window <= first[row + 1]
    at = np.flatnonzero(valid)
    row, whole, anchors = row[at], whole[at], anchors[at]
    if not len(at):
        return row, anchors, whole, at, at, n_words
    new = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[new, len(at)])
    inner = np.arange(len(at)) - np.repeat(new, n)
    hashed = mix(np.add.reduceat(whole * powers(_ODD, int(n.max()))[inner], new) ^ n.astype(np.uint64))
    return row[new], anchors[new], hashed, at[new] - first[row[new]], n, n_words


def _parse(window: int, seed: int):
    """Per row: number of words, hash of all words, and its phrases."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column("text")
            data, off = utf8(text)
            for lo, hi in row_groups(off):
                part = data[off[lo]:off[hi]]
                row, anchor, phrase, at, n, n_words = phrases(part, off[lo:hi + 1] - off[lo], window, seed)
                whole = [sha256(b" ".join((t or b"").split())).hexdigest() for t in text.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                found = pa.StructArray.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(at, pa.int32()), pa.array(n, pa.int32())],
                    ["anchor", "phrase", "at", "n"])
                cuts = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("text_hash").slice(lo, hi - lo), pa.array(n_words, pa.int64()),
                     pa.array(whole), pa.ListArray.from_arrays(cuts, found)],
                    ["doc_id", "text_hash", "n_words", "sha", "phrases"])
    return run


def _windows(window: int):
    """The windows of the phrases that are to be checked: (doc_id, text_hash, anchor, win, at)."""
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "text_hash", "anchor", "win", "at"]
        for b in batches:
            data, off = utf8(b.column("text"))
            check = b.column("check").to_pylist()
            for i, (doc, th) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist())):
                if not check[i]:
                    continue
                text = data[off[i]:off[i + 1]]
                starts, ends, _ = word_bounds(text, np.array([0, len(text)]))
                whole = rolling(span_hashes(text, starts, ends), window).view(np.int64)
                at = np.concatenate([np.arange(c["at"], c["at"] + c["n"]) for c in check[i]])
                anchor = np.repeat([c["anchor"] for c in check[i]], [c["n"] for c in check[i]])
                for s in range(0, len(at), 1 << 16):
                    a = at[s:s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), doc)), pa.array(np.full(len(a), th)), pa.array(anchor[s:s + (1 << 16)]),
                         pa.array(whole[a]), pa.array(a, pa.int32())], names)
    return run


def duplicate_factors(docs: DataFrame, window: int = 50, seed: int = 12) -> tuple[DataFrame, DataFrame]:
    """The parse of every row of ``docs`` and the texts with factors.

    First: (doc_id, text_hash, n_words, sha) for every row, sha of all its words. Second:
    (doc_id, text_hash, text, spans) for the distinct (doc_id, text) with factors; spans are
    (at, n, source, source_at): ``n`` windows from word ``at`` that occur in document ``source`` from word ``source_at``.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parsed = written(hashed.mapInArrow(_parse(window, seed), f"doc_id bigint, text_hash bigint, n_words bigint, sha string, phrases {PHRASE}"), "phrases")
    keys = ["doc_id", "text_hash"]
    again = repeated_keys(parsed.filter("doc_id IS NOT NULL").select(*keys), keys)
    once = one_of_each(parsed.filter("doc_id IS NOT NULL").select(*keys, "phrases"), keys, again)
    each = once.select(*keys, F.inline("phrases"))
    blocks = (each.groupBy("anchor").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("hi"),
                                         (F.min("phrase") == F.max("phrase")).alias("alike"))
              .filter("first.doc_id < hi").select("anchor", "first", "alike"))
    blocks = written(blocks, "shared-blocks")
    shared = written(each.join(blocks, "anchor"), "shared-phrases")
    index = written(shared.filter("NOT alike").groupBy("anchor", "phrase").agg(F.min(F.struct("doc_id", "at")).alias("first")), "phrase-index")
    mixed = shared.filter("NOT alike").drop("first").join(index, ["anchor", "phrase"])
    nowhere = F.lit(None).cast("struct<doc_id:bigint,at:int>")
    whole = (shared.filter("alike AND doc_id > first.doc_id").select(*keys, "at", "n", "first", F.lit(None).cast("bigint").alias("anchor"))
             .unionByName(mixed.filter("doc_id > first.doc_id").select(*keys, "at", "n", "first", F.lit(None).cast("bigint").alias("anchor")))
             .unionByName(mixed.filter("doc_id = first.doc_id").select(*keys, "at", "n", nowhere.alias("first"), "anchor")))
    found = whole.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("anchor").isNull(), F.struct("at", "n", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at")))).alias("spans"),
        F.collect_list(F.when(F.col("anchor").isNotNull(), F.struct("at", "n", "anchor"))).alias("check"))
    hashed = one_of_each(hashed.filter("doc_id IS NOT NULL"), keys, again)
    texts = written(hashed.join(found, keys), "texts-with-matches")
    wins = texts.filter(F.size("check") > 0).mapInArrow(_windows(window), "doc_id bigint, text_hash bigint, anchor bigint, win bigint, at int")
    wins = written(wins, "boundary-windows")
    lookup = written(wins.groupBy("anchor", "win").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("hi"))
                     .filter("first.doc_id < hi").drop("hi"), "window-index")
    hits = (wins.join(lookup, ["anchor", "win"]).filter("doc_id > first.doc_id").groupBy(*keys)
            .agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at"))).alias("hits")))
    none = F.array().cast("array<struct<at:int,n:int,source:bigint,source_at:int>>")
    factors = (texts.drop("check").join(hits, keys, "left")
               .withColumn("spans", F.concat("spans", F.coalesce("hits", none))).drop("hits"))
    return parsed.drop("phrases"), factors.filter(F.size("spans") > 0)


def join_factors(spans: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, source, source start) from left to right: spans join that follow one another here and in their source."""
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["at"], s["n"])):
        end = s["at"] + s["n"] - 1 + window
        if out and out[-1][2] == s["source"] and s["source_at"] - s["at"] == out[-1][3] - out[-1][0] and s["at"] <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], end - out[-1][0])
        else:
            out.append([s["at"], end - s["at"], s["source"], s["source_at"]])
    return [tuple(f) for f in out]


def _cut(window: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            kept_sha, removed, factors, kept_text = [], [], [], []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                each = join_factors(spans, window)
                for at, n, *_ in each:
                    gone[at:at + n] = True
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                kept_sha.append(sha256(kept).hexdigest())
                removed.append(int(gone.sum()))
                kept_text.append(kept)
                factors.append([{"start": a, "length": n, "source": s, "source_start": p} for a, n, s, p in each])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(removed, pa.int64()), pa.array(kept_sha, pa.string()),
                 pa.array(kept_text, pa.binary()).cast(pa.string()),
                 pa.array(factors, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])))],
                ["doc_id", "text_hash", "n_removed", "kept_sha", "kept_text", "factors"])
    return run


def deduplicated_texts(factors: DataFrame, window: int = 50) -> DataFrame:
    """Of the texts with factors: number of removed words, kept words (joined by a space), their sha256, and the factors."""
    return factors.mapInArrow(_cut(window), "doc_id bigint, text_hash bigint, n_removed bigint, kept_sha string, kept_text string, "
                              "factors array<struct<start:int, length:int, source:bigint, source_start:int>>")


def substring_dedup(docs: DataFrame, window: int = 50, seed: int = 12) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    parsed, factors = duplicate_factors(docs, window, seed)
    cut = deduplicated_texts(factors, window).select("doc_id", "text_hash", "n_removed", "kept_sha")
    cut = written(cut, "cut-texts")
    return parsed.join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"))
