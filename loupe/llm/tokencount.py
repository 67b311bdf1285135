"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

Pre-tokens are the runs outside ``[\\x20\\x09-\\x0D]`` with the word mark before them. The forward
score of a prefix is the best summed log-probability over its segmentations into pieces;
it depends on the prefix alone. Each task inserts the distinct pre-tokens of a group of rows into
a trie, which is visited depth first in sorted order: scores live on the path from the root, so
what words share is computed once and memory is the longest word. The count of pieces at a
word's last node is stored, and a document's count is the sum over its words.

A character outside the vocabulary costs ``unknown`` and counts as its UTF-8 bytes. Between equal
scores the segmentation with fewer pieces wins. Null texts count as empty (no token).
Repeated rows come out as often as they go in; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from loupe.llm.textops import row_groups, utf8


@dataclass(frozen=True)
class Unigram:
    """Log-probability of each piece; ``mark`` stands before every pre-token."""
    pieces: dict[str, float]
    unknown: float
    mark: str = "▁"


def zipf_unigram(model_path: str) -> Unigram:
    """A unigram model over a SentencePiece vocabulary.

    The file's scores are merge ranks, no probabilities; pieces get the Zipf-Mandelbrot
    share ``1 / (rank + 2.7)`` of their rank, control and byte pieces none.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ids))))
    pieces = {sp.id_to_piece(i): -math.log(r + 2.7) - total for r, i in enumerate(ids)}
    return Unigram(pieces, min(pieces.values()) - 10.0)


def suffix_table(model: Unigram) -> dict[str, float | None]:
    """Every suffix of a piece; its score if it is a piece itself. A miss ends the search for longer pieces."""
    table: dict[str, float | None] = {}
    for p in model.pieces:
        for i in range(len(p)):
            table.setdefault(p[i:], None)
    table.update(model.pieces)
    return table


def terminal_counts(words: list[str], table: dict[str, float | None], unknown: float) -> list[int]:
    """Number of pieces of each word's best segmentation; ``words`` sorted, so that the trie is walked depth first."""
    score, count, out, last = [0.0], [0], [], ""
    get = table.get
    for word in words:
        shared = 0
        for a, b in zip(last, word):
            if a != b:
                break
            shared += 1
        del score[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            best, n = score[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            for begin in range(end - 1, -1, -1):
                piece = word[begin:end]
                p = get(piece, False)
                if p is False:
                    break
                if p is not None:
                    s = score[begin] + p
                    if s > best or s == best and count[begin] + 1 < n:
                        best, n = s, count[begin] + 1
            score.append(best)
            count.append(n)
        out.append(count[-1])
        last = word
    return out


def count_tokens(docs: DataFrame, model: Unigram, cached_words: int = 1 << 19) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of ``docs`` (doc_id, text); the vocabulary is the only broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.unknown, model.mark))

    def run(batches):
        import pyarrow as pa

        pieces, unknown, mark = shared.value
        table = suffix_table(Unigram(pieces, unknown, mark))
        known: dict[bytes, int] = {}
        for b in batches:
            _, off = utf8(b.column("text"))
            texts = b.column("text").cast(pa.binary()).to_pylist()
            n_words, n_tokens = [], []
            for lo, hi in row_groups(off):
                rows = [(t or b"").split() for t in texts[lo:hi]]
                if len(known) > cached_words:
                    known.clear()
                new = sorted({w.decode() for r in rows for w in r if w not in known})
                for w, n in zip(new, terminal_counts([mark + w for w in new], table, unknown)):
                    known[w.encode()] = n
                n_words += [len(r) for r in rows]
                n_tokens += [sum([known[w] for w in r]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
