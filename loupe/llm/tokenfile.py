"""Token-ID output: zstandard-compressed id arrays with one shared dictionary and an offset index.

Documents are encoded whole, an end id is appended, and the id array (little-endian, two
bytes an id if the vocabulary allows, else four) is compressed by itself with a dictionary
trained on id arrays of a bounded sample. Frames are packed in ascending doc_id order into
blocks. Written below one folder of the shared store:

* ``dictionary``: one row (dict_hash, dictionary), the hash being SHA-256;
* ``blocks``: part, block, first_id, last_id, dict_hash, id_bytes, doc_ids, starts (ids before
  each document within the part), offsets (byte offset of each frame, one more at the end),
  data. A short document is read by its block's offset index and one frame.

Order: null doc_ids first, rows with one doc_id as they are read. Null texts count as
empty, an empty text is the end id alone. An empty table gives no blocks. Too few or too
short documents for training make an empty dictionary, and frames without one. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.store import shared_path
from loupe.llm.textops import row_groups, utf8

BLOCKS = ("part int, block int, first_id bigint, last_id bigint, dict_hash string, id_bytes int, n_ids bigint, "
          "doc_ids array<bigint>, starts array<bigint>, offsets array<bigint>, data binary")


@dataclass(frozen=True)
class TokenParams:
    """``cached_words`` distinct stems are kept by a worker process. ``sample_rows`` documents of at most ``sample_bytes`` each train the dictionary; a block holds up to ``block_rows`` documents or ``block_bytes`` of frames."""
    end_id: int = 1
    level: int = 3
    dict_bytes: int = 64 << 10
    sample_rows: int = 1000
    sample_bytes: int = 8 << 10
    block_rows: int = 4096
    block_bytes: int = 4 << 20
    cached_words: int = 1 << 18


#: The normalizer and splitting under which a text's ids are those of its words (fixed values, as the vocabulary file states them).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class Encoder:
    """Ids of whole texts.

    Where the vocabulary file states the normalizer and splitting of ``BY_WORDS``, white space is dropped, a letter
    or digit is split from the punctuation after it, and case is folded; so a text's ids are those of its words, and a
    word's those of its stem and of a closing run of ``.,;:!?``. Each distinct stem of a batch is looked up
    once and ids are gathered by their places; unknown stems of plain lower-case letters, which normalization leaves alone, go to the merges alone, other words
    through the whole tokenizer. A text that may hold a special token (``<|``) keeps its case, since those are matched as written.
    Texts of any other tokenizer are encoded whole.
    """

    def __init__(self, tokenizer_json: str, cached_words: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cached_words = cached_words
        stated = json.loads(tokenizer_json)
        model = stated["model"]
        self.by_words = (all(stated.get(k) == v for k, v in BY_WORDS.items()) and all("<|" in t["content"] and not set(t["content"]) & set(" \t\n\r") for t in stated["added_tokens"])
                         and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "unk_token")))
        self.merges = None
        suffix = model.get("end_of_word_suffix") if self.by_words else None
        if suffix:
            from tokenizers.pre_tokenizers import ByteLevel

            self.merges = Tokenizer.from_str(json.dumps({**stated, "normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
            as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._forget()

    def _forget(self) -> None:
        """Empties the cache: ids of all known words one after the other, and each word's place and length."""
        self.known: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Cache the words, whose ids stand one after the other in ``ids``."""
        first, n = len(self.known), len(words)
        self.flat = grown(self.flat, self.used + len(ids))
        self.start, self.length = grown(self.start, first + n), grown(self.length, first + n)
        self.flat[self.used:self.used + len(ids)] = ids
        self.length[first:first + n] = sizes
        self.start[first:first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + n)))

    def _encode(self, words: list[str]) -> None:
        """Cache words by the whole tokenizer."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(g) for g in got], np.int64)
        self._add(words, np.fromiter((i for g in got for i in g), self.dtype, int(sizes.sum())), sizes)

    def _merge(self, words: list[str]) -> None:
        """Cache words of plain letters by the merges; a closing piece ends each word."""
        for a in range(0, len(words), 1 << 14):
            part = words[a:a + (1 << 14)]
            ids = np.array(self.merges.encode_batch_fast([[w if w.isascii() else w.translate(self.letters) for w in part]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part) and (not len(part) or ends[-1] == len(ids)):
                self._add(part, ids.astype(self.dtype), np.diff(np.r_[0, ends]))
            else:
                self._encode(part)

    def _places(self, words: list[str], plain: np.ndarray) -> np.ndarray:
        """Places of the words in the cache, which learns those it does not know; ``plain``: which consist of plain letters."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        if len(self.known) + len(new) > self.cached_words and len(self.known) > 1:
            self._forget()
            return self._places(words, plain)
        easy = plain[new] if self.merges else np.zeros(len(new), bool)
        for some, learn in ((new[easy], self._merge), (new[~easy], self._encode)):
            if len(some):
                learn([words[i] for i in some.tolist()])
        at[new] = np.fromiter((self.known[words[i]] for i in new.tolist()), np.int64, len(new))
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the cached words ``at``, and where each word's end."""
        size = self.length[at]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - ends + size, size)
        return self.flat[place], ends

    def encode_many(self, texts, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow string array's texts one after the other (null: empty), ``end`` after each, and the n + 1 offsets of the texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.string()).fill_null("")
        tail = [] if end is None else [end]
        if not self.by_words:
            got = [e.ids + tail for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            off = np.r_[0, np.cumsum([len(g) for g in got], dtype=np.int64)].astype(np.int64)
            return np.fromiter((i for g in got for i in g), self.dtype, int(off[-1])), off
        rows = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = rows.flatten().dictionary_encode()
        words = coded.dictionary
        stems = pc.utf8_rtrim(words, ".,;:!?")
        closed = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, "[A-Za-z0-9ß-öø-ÿ]$"))
        stems = pc.if_else(closed, stems, words).dictionary_encode()
        with_end = np.flatnonzero(closed.to_numpy(zero_copy_only=False))
        size = pc.subtract(pc.binary_length(words), pc.binary_length(stems.dictionary.take(stems.indices))).to_numpy()[with_end]
        ends = pa.array([w[-n:] for w, n in zip(words.take(pa.array(with_end)).to_pylist(), size.tolist())], pa.string()).dictionary_encode()
        every = [*stems.dictionary.to_pylist(), *ends.dictionary.to_pylist()]
        plain = pc.match_substring_regex(stems.dictionary, "^[a-zß-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        place = self._places(every, np.r_[plain, np.zeros(len(ends.dictionary), bool)])
        both = np.zeros((len(words), 2), np.int64)  # a word is its stem and its end; place 0 holds no ids
        both[:, 0] = place[:len(plain)][stems.indices.to_numpy()]
        both[with_end, 1] = place[len(plain):][ends.indices.to_numpy()]
        ids, ends = self._gather(both[coded.indices.to_numpy()].ravel())
        ends = ends[1::2]
        row_ends = rows.offsets.to_numpy()[1:].astype(np.int64) - rows.offsets[0].as_py()
        cut = np.r_[0, ends][row_ends]
        if end is None:
            return ids, np.r_[0, cut]
        return np.insert(ids, cut, end), np.r_[0, cut + np.arange(1, len(cut) + 1)]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for at least ``n`` entries."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


#: One encoder for each vocabulary, kept for a worker process's later tasks.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(tokenizer_json: str, cached_words: int) -> Encoder:
    key = (hashlib.sha256(tokenizer_json.encode()).hexdigest(), cached_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json, cached_words)
    return _ENCODERS[key]


def train_dictionary(docs: DataFrame, tokenizer_json: str, params: TokenParams) -> bytes:
    """A dictionary from the id arrays of a bounded sample (short documents, by the hash of id and text)."""
    import zstandard

    short = docs.filter(F.octet_length("text") <= params.sample_bytes)
    n = short.count()
    h = F.xxhash64("doc_id", "text")
    cut = min(1 << 20, int(2 * params.sample_rows / max(n, 1) * (1 << 20)) + 1)
    rows = short.filter(F.pmod(h, F.lit(1 << 20)) < cut).orderBy(h).limit(params.sample_rows).select("text").toArrow()
    ids, off = encoder_of(tokenizer_json, params.cached_words).encode_many(rows.column("text").combine_chunks(), None)
    samples = [s for s in (ids[a:z].tobytes() for a, z in zip(off, off[1:])) if len(s) >= 8]
    total = sum(map(len, samples))
    if len(samples) < 10 or total < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(params.dict_bytes, total // 4), samples).as_bytes()
    except zstandard.ZstdError:  # samples too much alike: nothing to share
        return b""


def _encode(json_text, dictionary, params: TokenParams):
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(json_text.value, params.cached_words)
        shared = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        press = zstandard.ZstdCompressor(level=params.level, dict_data=shared)
        digest = hashlib.sha256(dictionary.value).hexdigest()
        size = encoder.dtype.itemsize
        types = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_hash", pa.string()),
                           ("id_bytes", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
                           ("offsets", pa.list_(pa.int64())), ("data", pa.binary())])
        ids, starts, offsets, frames, block, at, begun = [], [], [0], [], 0, 0, 0

        def packed():
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "first_id": next((i for i in ids if i is not None), None), "last_id": ids[-1], "dict_hash": digest, "id_bytes": size, "n_ids": at - begun,
                "doc_ids": ids, "starts": starts, "offsets": offsets, "data": b"".join(frames)}], types)

        def encoded(text, off):
            for lo, hi in row_groups(off, 4 << 20):
                found, cuts = encoder.encode_many(text.slice(lo, hi - lo), params.end_id)
                yield from (found[a:z].tobytes() for a, z in zip(cuts, cuts[1:]))

        for b in batches:
            _, off = utf8(b.column("text"))
            for doc, raw in zip(b.column("doc_id").to_pylist(), encoded(b.column("text"), off)):
                frame = press.compress(raw)
                ids.append(doc)
                starts.append(at)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                at += len(raw) // size
                if len(ids) >= params.block_rows or offsets[-1] >= params.block_bytes:
                    yield packed()
                    pa.default_memory_pool().release_unused()
                    ids, starts, offsets, frames, block, begun = [], [], [0], [], block + 1, at
        if ids:
            yield packed()
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, params: TokenParams = TokenParams(), path: str | None = None) -> str:
    """Encode every row of ``docs`` (doc_id, text) and write the files; returns their folder."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:  # the driver's copy; its size does not depend on the data
        tokenizer_json = f.read()
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer_json, params)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.range(1).select(F.lit(digest).alias("dict_hash"), F.unbase64(F.lit(_b64(dictionary))).alias("dictionary")).write.parquet(f"{path}/dictionary")
    shared = [spark.sparkContext.broadcast(x) for x in (tokenizer_json, dictionary)]
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row")]  # the row number lets many equal ids be cut
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_encode(*shared, params), BLOCKS).write.parquet(f"{path}/blocks")
    return path


def _b64(data: bytes) -> str:
    import base64

    return base64.b64encode(data).decode()


def _decode(dictionary: bytes, bases: dict[int, int]):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        import pyarrow as pa
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpress = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            for block in b.to_pylist():
                if block["dict_hash"] != digest:
                    raise ValueError(f"block of dictionary {block['dict_hash']}, not {digest}")
                dtype, data, off = f"<u{block['id_bytes']}", memoryview(block["data"]), block["offsets"]
                n, crc = [], []
                for a, z in zip(off, off[1:]):
                    ids = np.frombuffer(unpress.decompress(data[a:z]), dtype)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                base = bases[block["part"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(np.array(block["starts"], np.int64) + base), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: every frame is decompressed.

    The driver adds up one total per written part (as many as tasks wrote, not rows).
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, at = {}, 0
    for r in totals:
        bases[r["part"]] = at
        at += r["n"]
    chosen = blocks.select("part", "dict_hash", "id_bytes", "doc_ids", "starts", "offsets", "data")
    return chosen.mapInArrow(_decode(read_dictionary(spark, path), bases), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the rows with one doc_id, by the blocks' bounds and offset index."""
    import zstandard

    dictionary = read_dictionary(spark, path)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    one = blocks.select("part", "block", "id_bytes", F.posexplode("doc_ids").alias("i", "id"), "offsets", "data").filter(F.col("id") == doc_id)
    frame = F.expr("substring(data, cast(offsets[i] + 1 AS int), cast(offsets[i + 1] - offsets[i] AS int))")
    rows = one.select("part", "block", "i", "id_bytes", frame.alias("frame")).orderBy("part", "block", "i").collect()
    return [np.frombuffer(unpress.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}").tolist() for r in rows]
