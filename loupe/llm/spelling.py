"""Grouping of spelling variants by asymmetric q-chunks.

Two words are near if exactly one inserted, deleted or replaced code point leads from one to
the other. The shorter word of such a pair (of equally long ones the smaller) gives two
disjoint chunks, its halves; the longer one gives its positional grams of those halves'
lengths within shift one of their places. One edit leaves one half whole, at the place that the
difference of the lengths fixes, so the two words meet there. What is left beside the
common half differs by one edit again: it is cut into two chunks in the same way, so that the join
key holds about three quarters of a word and a frequent stem or ending makes no large
bucket. Pairs that meet are verified inside the join; only verified ones leave it.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is
at least ``factor`` times its own. Counts grow along forms, so following them ends; chains
are shortened by doubling, in as many rounds as the logarithm of their length.

Counting: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts with A-Z lower-cased; of a run
whose crc32 of ``<doc_id>:<run>`` is divisible by ``noise`` one code point is deleted (the
remainder of the crc32 by its length). Words are summed per task before they are shuffled.

Null texts have no runs; a null doc_id counts as empty before the colon. Repeated rows count
as often as they occur. An empty table, or one without words, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.store import written

#: Characters of a text that are searched at once, and distinct words that a task holds before it sends them on.
PIECE, HELD = 1 << 20, 1 << 18


def runs_of(text: str, least: int):
    """Lists of the runs of at least ``least`` letters, for pieces of the text that no run crosses."""
    letters, other = re.compile("[a-zÀ-ÿ]{%d,}" % least), re.compile("[^a-zÀ-ÿ]")
    a = 0
    while a < len(text):
        cut = other.search(text, a + PIECE)
        b = cut.start() if cut else len(text)
        yield letters.findall(text, a, b)
        a = b


def _count(least: int, noise: int):
    def run(batches):
        import pyarrow as pa

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: dict[str, int] = {}
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for found in runs_of(raw.lower().decode(), least):
                    for w, n in Counter(found).items():
                        h = zlib.crc32(w.encode(), start)
                        if h % noise == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1:]
                        held[w] = held.get(w, 0) + n
                    if len(held) >= HELD:
                        yield packed()
                        held.clear()
        if held:
            yield packed()
    return run


def word_counts(docs: DataFrame, least: int = 7, at_least: int = 2, noise: int = 31) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur ``at_least`` times in all of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text").mapInArrow(_count(least, noise), "word string, n bigint")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= at_least) & (F.char_length("word") >= least))


def chunk_keys(word: Column, size: Column) -> Column:
    """Hashes of the chunks of a word of ``size`` code points, looked up in ``word`` (as long or one longer).

    A half of the word and a half of the rest; those at the end are read from the word's end.
    """
    length = F.char_length(word)
    half = F.floor(size / 2).cast("int")

    def cut(s: Column, n: Column) -> list[Column]:
        """First part, last part and their rests for a string that was ``n`` code points long."""
        size, h = F.char_length(s), F.floor(n / 2).cast("int")
        return [F.substring(s, F.lit(1), h), F.substring(s, size - (n - h) + 1, n - h)]

    first, last = cut(word, size)
    rests = [(F.lit(0), first, F.substring(word, half + 1, length - half), size - half),
             (F.lit(2), last, F.substring(word, F.lit(1), length - (size - half)), half)]
    return F.array(*[F.xxhash64(size, side + i, chunk, part) for side, chunk, rest, n in rests for i, part in enumerate(cut(rest, n))])


def near_pairs(words: DataFrame, least: int = 7) -> DataFrame:
    """(u, n_u, v, n_v): every pair of ``words`` (word, n) that one edit separates, once; u is the shorter or smaller word."""
    words = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = words.select(F.explode(chunk_keys(F.col("word"), F.col("size"))).alias("key"), F.col("word").alias("u"), F.col("n").alias("n_u"), F.col("size").alias("s"))
    sizes = F.explode(F.filter(F.array("size", F.col("size") - 1), lambda x: x >= least))
    grams = (words.withColumn("of", sizes)
             .select(F.explode(chunk_keys(F.col("word"), F.col("of"))).alias("key"), F.col("word").alias("v"), F.col("n").alias("n_v"), F.col("of").alias("s"), "size"))
    verified = (F.col("u") < F.col("v")) | (F.col("size") > F.col("s"))
    pairs = chunks.join(grams, ["key", "s"]).filter(verified & (F.levenshtein("u", "v", 1) == 1))
    return pairs.select("u", "n_u", "v", "n_v").distinct()


def spelling_groups(words: DataFrame, least: int = 7, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words of at least ``least`` code points)."""
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words, least), "near-words")
    sides = pairs.select(F.col("u").alias("word"), F.struct((-F.col("n_v")).alias("less"), F.col("v").alias("other")).alias("near")).unionByName(
        pairs.select(F.col("v").alias("word"), F.struct((-F.col("n_u")).alias("less"), F.col("u").alias("other")).alias("near")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    formed = -F.col("near.less") >= factor * F.col("n")
    each = written(words.join(best, "word", "left").select(
        "word", F.when(formed, F.col("near.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, -F.col("near.less")).alias("form_n")), "forms")
    links = each.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a link spans
        links = written(links, "links")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ahead.join(links.select("root").distinct(), "root", "left_semi").isEmpty():
            break
        links = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return each.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, at_least: int = 2, noise: int = 31, factor: int = 10) -> DataFrame:
    """The spelling groups of the words of ``docs`` (doc_id, text)."""
    return spelling_groups(word_counts(docs, least, at_least, noise), least, factor)
