"""Phrase collocation mining with broadcast double-array tries of Apriori-safe candidates.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``; everything is counted per language. One pass turns the texts into
streams of 64-bit word keys (language and word hashed together) with a zero after every piece, and
word counts that are summed per group of rows. Then, for k = 2 .. ``longest``:

* the phrases of k-1 words found so far are broadcast as a trie; numpy advances the states of all
  text positions at once, one word per level;
* a position whose phrase of k-1 words and whose next one (a word later) are both frequent is a
  safe place for a phrase of k words; each task counts those, the sums over all tasks give
  the candidates. Sums leave nothing out, so no frequent phrase is missed.

A last sweep walks the tries of all candidates, bincounts the accepting states of each
shard of texts and sums the shards: these are the frequencies. A broadcast trie holds at most
``trie_phrases`` phrases; more are dealt by hash to several tries, one sweep each (a sweep
then leaves out the safety test it cannot make, and the sums decide).

Scores are exact (decimals of 38 digits). A candidate is dropped if a longer one that contains
it occurs at least ``absorb`` percent as often. The best ``top`` of a language are found in hash slices first, so that
no language is sorted by one task.

Two words of a language with equal 64-bit keys would count as one; among ten million words
the chance is three in a million. Null texts are empty, null languages are ``und``. Repeated
rows count as often as they occur. An empty table, or one without candidates, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.store import written
from loupe.llm.textops import mix, row_groups, span_hashes, utf8, word_bounds
from loupe.llm.trie import Trie, build

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
IN_WORD = ~IS_BREAK
IN_WORD[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class PhraseParams:
    longest: int = 5
    min_count: int = 100
    absorb: int = 100
    top: int = 2000
    trie_phrases: int = 1 << 20
    slices: int = 64


def word_stream(data: np.ndarray, off: np.ndarray, lang_keys: np.ndarray):
    """Of some rows' bytes: the word keys with a zero after every piece, and the words' keys, bounds and rows."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, off, IN_WORD)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    keys = mix(span_hashes(data, starts, ends) ^ lang_keys[row])
    keys[keys == 0] = 1
    breaks = np.r_[0, np.cumsum(IS_BREAK[data], dtype=np.int32)]
    apart = np.ones(len(keys), bool)
    if len(keys):
        apart[:-1] = (breaks[ends[:-1]] != breaks[starts[1:]]) | (row[1:] != row[:-1])
    stream = np.zeros(len(keys) + int(apart.sum()), np.uint64)
    stream[np.arange(len(keys)) + np.cumsum(apart) - apart] = keys
    return stream, keys, starts, ends, row, data


COLUMNS = ["key", "lang", "word", "n", "stream"]
#: Bytes of text read at once, and words of a stored stream (a longer piece stands alone).
READ_BYTES, STREAM_WORDS = 2 << 20, 1 << 16


def cut_stream(stream: np.ndarray):
    """Parts of a stream that end where a piece ends."""
    ends = np.flatnonzero(stream == 0) + 1
    a = 0
    while a < len(stream):
        b = int(ends[min(np.searchsorted(ends, a + STREAM_WORDS), len(ends) - 1)])
        yield stream[a:b]
        a = b


def _read(batches):
    import pyarrow as pa

    for b in batches:
        data, off = utf8(b.column("text"))
        langs = b.column("lang").cast(pa.large_string())
        lang_data, lang_off = utf8(langs)
        lang_keys = span_hashes(lang_data, lang_off[:-1], lang_off[1:], 1)
        names = np.array(langs.to_pylist(), object)
        for lo, hi in row_groups(off, READ_BYTES):
            stream, keys, starts, ends, row, low = word_stream(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], lang_keys[lo:hi])
            distinct, at, n = np.unique(keys, return_index=True, return_counts=True)
            raw = low.tobytes()
            words = [raw[a:z].decode() for a, z in zip(starts[at].tolist(), ends[at].tolist())]
            m = len(distinct)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(names[lo:hi][row[at]], pa.string()), pa.array(words, pa.string()), pa.array(n), pa.nulls(m, pa.binary())], COLUMNS)
            for part in cut_stream(stream):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64())], pa.array([part.tobytes()], pa.binary())], COLUMNS)


def advance(trie: Trie, code: np.ndarray, depth: int):
    """For 1 .. ``depth`` words: the positions whose words so far are a path of the trie, and their states."""
    pos = np.flatnonzero(code)
    state = code[pos].astype(np.int64)
    yield pos, state
    for k in range(1, depth):
        inside = pos + k < len(code)
        pos, state = pos[inside], state[inside]
        state = trie.step(state, code[pos + k])
        live = state > 0
        pos, state = pos[live], state[live]
        yield pos, state


def _summed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    return distinct, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


#: Distinct continuations that a task holds before it sends them on; phrases of one vector of counts.
HELD, CHUNK = 1 << 18, 1 << 13


def _extend(shared, k: int):
    """(node, key, n): how often a phrase of k-1 words goes on with a word, where that is safe.

    Where the trie holds all words, ``node`` numbers the phrase's node and the word's code together and ``key`` is 0.
    """
    def run(batches):
        import pyarrow as pa

        trie, _ = shared.value
        width = len(trie.words) + 1

        def packed(node, key, n):
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(key), pa.array(n, pa.int64())], ["node", "key", "n"])

        ids, counts, held = [], [], 0
        for b in batches:
            for raw in b.column("stream"):
                keys = np.frombuffer(raw.as_buffer(), np.uint64)
                code = trie.codes(keys)
                for pos, state in advance(trie, code, k - 1):
                    pass
                ends_here = (trie.row[state] >= 0) & (pos + k - 1 < len(code))
                pos, state = pos[ends_here], state[ends_here]
                if not trie.whole:  # the next word and phrase may be another trie's
                    follows = keys[pos + k - 1] > 0
                    pos, state = pos[follows], state[follows]
                    words, c = np.unique(keys[pos + k - 1], return_inverse=True)
                    pair, n = np.unique(state * (len(words) + 1) + c, return_counts=True)
                    if len(pair):
                        yield packed(pair // (len(words) + 1), words[pair % (len(words) + 1)].view(np.int64), n)
                    continue
                live = np.zeros(len(code) + 1, bool)
                live[pos] = True
                safe = live[pos + 1]
                pair, n = np.unique(state[safe] * width + code[pos[safe] + k - 1], return_counts=True)
                ids.append(pair)
                counts.append(n)
                held += len(pair)
                if held > 2 * HELD:
                    pair, n = _summed(ids, counts)
                    ids, counts, held = [pair], [n], len(pair)
                    if held > HELD:
                        yield packed(pair, np.zeros(held, np.int64), n)
                        ids, counts, held = [], [], 0
        if held:
            pair, n = _summed(ids, counts)
            yield packed(pair, np.zeros(len(pair), np.int64), n)
    return run


def _named(shared):
    """(pid, key) of the (node, key) that :func:`_extend` numbers."""
    def run(batches):
        import pyarrow as pa

        trie, pids = shared.value
        width = len(trie.words) + 1
        for b in batches:
            node, key = b.column("node").to_numpy(), b.column("key").to_numpy()
            if trie.whole:
                node, key = node // width, trie.words[node % width - 1].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pids[trie.row[node]]), pa.array(key)], ["pid", "key"])
    return run


def _count(shared, longest: int):
    """Vectors of the trie's phrases' occurrences (chunk, salt, counts) of a task, by a bincount of accepting states."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        trie, pids = shared.value
        total = np.zeros(len(pids), np.int64)
        for b in batches:
            for raw in b.column("stream"):
                code = trie.codes(np.frombuffer(raw.as_buffer(), np.uint64))
                for _, state in advance(trie, code, longest):
                    row = trie.row[state]
                    total += np.bincount(row[row >= 0], minlength=len(pids))
        salt = TaskContext.get().partitionId() % 64
        for a in range(0, len(pids), CHUNK):
            part = total[a:a + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([a // CHUNK], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "salt", "counts"])
    return run


def _sum_vectors(batches):
    """One vector for each chunk of a task, the sum of those that stream in."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts")):
            part = np.frombuffer(counts.as_buffer(), np.int64)
            total[chunk] = total[chunk] + part if chunk in total else part.copy()
    for chunk, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "counts"])


def _phrase_sums(shared):
    """(pid, f) of the summed vectors."""
    def run(batches):
        import pyarrow as pa

        _, pids = shared.value
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts")):
                part = np.frombuffer(counts.as_buffer(), np.int64)
                found = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array(pids[chunk * CHUNK + found]), pa.array(part[found])], ["pid", "f"])
    return run


def _tries(phrases: DataFrame, params: PhraseParams):
    """The phrases (pid, w: array of keys) as tries of bounded size, each with its phrases' pids."""
    shards = -(-phrases.count() // params.trie_phrases)
    for shard in range(shards):
        mine = phrases if shards == 1 else phrases.filter(F.pmod(F.xxhash64("pid"), F.lit(shards)) == shard)
        got = mine.select("pid", "w").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        pids, w = got["pid"].to_numpy(), got["w"].combine_chunks()
        size, flat = np.diff(w.offsets.to_numpy()), w.flatten().to_numpy().view(np.uint64)
        first = np.r_[0, np.cumsum(size)]
        by_size = []
        for k in np.unique(size):
            rows = np.flatnonzero(size == k)
            by_size.append((flat[first[rows][:, None] + np.arange(k)], rows))
        yield build(np.unique(flat), by_size, shards == 1), pids


def _candidates(streams: DataFrame, shared, k: int, least: int) -> DataFrame:
    """(pid, key): the phrases of one trie that go on with a word at least ``least`` times."""
    pairs = streams.mapInArrow(_extend(shared, k), "node bigint, key bigint, n bigint")
    often = pairs.groupBy("node", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return often.select("node", "key").mapInArrow(_named(shared), "pid bigint, key bigint")


def _frequencies(streams: DataFrame, shared, longest: int) -> DataFrame:
    """(pid, f) of the phrases of one trie: the shards' vectors summed in two levels."""
    vectors = streams.mapInArrow(_count(shared, longest), "chunk int, salt int, counts binary")
    for keys in (["chunk", "salt"], ["chunk"]):
        vectors = vectors.repartition(*keys).select("chunk", "counts").mapInArrow(_sum_vectors, "chunk int, counts binary")
    return vectors.mapInArrow(_phrase_sums(shared), "pid bigint, f bigint")


def _swept(streams: DataFrame, phrases: DataFrame, params: PhraseParams, sweep, *args) -> DataFrame:
    """The rows of ``sweep`` over all streams for every trie of ``phrases``."""
    out = None
    for trie in _tries(phrases, params):
        rows = sweep(streams, streams.sparkSession.sparkContext.broadcast(trie), *args)
        out = rows if out is None else out.unionByName(rows)
    return out


@contextmanager
def small_batches(spark, limit: str = "8m"):
    """Arrow batches of at most ``limit`` while the passes over texts and streams run: a batch is held by the executor and by its Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def phrase_counts(docs: DataFrame, params: PhraseParams = PhraseParams()) -> tuple[DataFrame, DataFrame]:
    """All frequent words and phrases (lang, phrase, size, f) of ``docs`` (lang, text), and the words of each language (lang, n)."""
    with small_batches(docs.sparkSession):
        return _phrase_counts(docs, params)


def _phrase_counts(docs: DataFrame, params: PhraseParams) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    read = written(docs.mapInArrow(_read, "key bigint, lang string, word string, n bigint, stream binary"), "word-streams")
    streams = read.filter("stream IS NOT NULL").select("stream")
    seen = read.filter("stream IS NULL")
    counts = seen.groupBy("lang", "word", "key").agg(F.sum("n").alias("f"))
    totals = written(seen.groupBy("lang").agg(F.sum("n").alias("n")), "language-totals")
    numbered = F.monotonically_increasing_id() * 8
    words = written(counts.filter(F.col("f") >= params.min_count).select(
        (numbered + 1).alias("pid"), "lang", F.col("word").alias("phrase"), F.array("key").alias("w"), "key", "f"), "frequent-words")
    found, last = [], words
    for k in range(2, params.longest + 1):
        pairs = _swept(streams, last, params, _candidates, k, params.min_count)
        if pairs is None:
            break
        longer = pairs.join(last.select("pid", "lang", "phrase", "w"), "pid").join(words.select("key", F.col("phrase").alias("word")), "key")
        last = written(longer.select((numbered + k).alias("pid"), "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"),
                                     F.concat("w", F.array("key")).alias("w")), f"candidates-{k}")
        if last.isEmpty():
            break
        found.append((k, last))
    each = words.select("lang", "phrase", F.lit(1).alias("size"), "f")
    if found:
        phrases = found[0][1].withColumn("size", F.lit(found[0][0]))
        for k, more in found[1:]:
            phrases = phrases.unionByName(more.withColumn("size", F.lit(k)))
        seen = _swept(streams, phrases, params, _frequencies, params.longest)
        each = each.unionByName(phrases.join(seen, "pid").filter(F.col("f") >= params.min_count).select("lang", "phrase", "size", "f"))
    return written(each, "phrase-counts"), totals


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by their lowest-scoring cut."""
    counts, totals = phrase_counts(docs, params)
    phrases = counts.filter("size > 1")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    part = counts.filter(F.col("size") < params.longest)
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang"))
    score = F.expr("(1000 * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    above = (phrases.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "f")
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = lowest.join(above, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < params.absorb * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(params.slices)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= params.top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= params.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
