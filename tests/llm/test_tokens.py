import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loupe.llm.tokencount import Unigram, count_tokens, suffix_table, terminal_counts, zipf_unigram
from loupe.llm.tokenfile import TokenParams, read_dictionary, read_document, read_token_files, write_token_files

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def brute_count(word, model):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + model.unknown, -(best[end - 1][1] + len(word[end - 1].encode())))]
        for begin in range(end):
            if word[begin:end] in model.pieces:
                options.append((best[begin][0] + model.pieces[word[begin:end]], -(best[begin][1] + 1)))
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_trie_counts_equal_word_by_word_search():
    rnd = random.Random(3)
    pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): -rnd.randint(2, 9) / 2 for _ in range(40)}
    model = Unigram(pieces, -20.0)
    words = sorted({"".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 9))) for _ in range(400)})
    assert terminal_counts(words, suffix_table(model), model.unknown) == [brute_count(w, model) for w in words]


def test_document_counts(spark, awkward, no_docs):
    model = zipf_unigram(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    for df in (docs, awkward):
        got = sorted((tuple(r) for r in count_tokens(df, model, cached_words=1000).collect()), key=str)
        want, known = [], {}
        for r in df.select("doc_id", "text").collect():
            words = [w.decode() for w in (r.text or "").encode().split()]
            for w in set(words) - known.keys():
                known[w] = brute_count("▁" + w, model)
            want.append((r.doc_id, len(words), sum(known[w] for w in words)))
        assert got == sorted(want, key=str)
    assert count_tokens(no_docs, model).count() == 0


def whole_text_ids(rows, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in rows]


@pytest.mark.parametrize("table", ["sf0.001", "awkward"])
def test_round_trip_equals_whole_text_encoding(spark, awkward, table):
    df = awkward if table == "awkward" else spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    path = write_token_files(df, VOCAB, TokenParams(block_rows=7))
    got = sorted((tuple(r) for r in read_token_files(spark, path).collect()), key=lambda r: r[1])
    ids = whole_text_ids([t for _, t in rows])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    want = sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids)), key=str)
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == want
    for (d, _), i in list(zip(rows, ids))[:3]:
        assert i in read_document(spark, path, d)
    if table != "awkward":
        assert len(read_dictionary(spark, path)) > 1000


def test_no_rows_and_too_few_to_train(spark, no_docs, make_docs):
    assert read_token_files(spark, write_token_files(no_docs, VOCAB)).count() == 0
    path = write_token_files(make_docs([(1, "only one short text")]), VOCAB)
    assert read_dictionary(spark, path) == b"" and read_token_files(spark, path).first().n_tokens == len(whole_text_ids(["only one short text"])[0])


def test_a_block_of_another_dictionary_is_refused(spark, make_docs):
    path = write_token_files(make_docs([(1, "text")]), VOCAB)
    spark.range(1).selectExpr("'x' AS dict_hash", "cast('other' AS binary) AS dictionary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        read_token_files(spark, path).count()


def test_words_encode_like_whole_texts():
    from loupe.llm.tokenfile import Encoder

    rnd = random.Random(11)
    bits = ["Don't", "WE'LL.", "ab,c", "x.,", "...", "é.", "É,", "é.", "É!", "<|endoftext|>.", "<|ENDOFTEXT|>,", "<|startoftext|>", "3.14,", " y", "İ.", "word_.", "(a).", "naïve?!", "　", "ß:", "1٣.", "a​."]
    texts = [rnd.choice([" ", "\n", "\t "]).join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(300)] + ["A" * 5000 + "."]
    with open(VOCAB, encoding="utf-8") as f:
        encoder = Encoder(f.read(), 50)
    for part in (texts, texts[:1], [None, "", " "], []):  # the cache is emptied on the way
        ids, off = encoder.encode_many(pa.array(part, pa.string()), 1)
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == whole_text_ids(part)
    assert encoder.by_words


def test_random_unicode_encodes_like_whole_texts():
    from loupe.llm.tokenfile import Encoder

    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCßàéîõÿÀÉ0123 .,;:!?'-\n\t\u0301\u00a0日本İſK£"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)]
    with open(VOCAB, encoding="utf-8") as f:
        encoder = Encoder(f.read(), 1 << 20)
    ids, off = encoder.encode_many(pa.array(texts), 1)
    assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == whole_text_ids(texts)


def test_another_vocabulary_is_encoded_whole(spark, make_docs):
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  spaces, Case kept.", "", None, "tabs\tand\nlines"]
    path = write_token_files(make_docs(list(enumerate(texts))), other, TokenParams(end_id=50256))
    want = [Tokenizer.from_file(other).encode(t or "", add_special_tokens=False).ids + [50256] for t in texts]
    assert [read_document(spark, path, i) for i in range(4)] == [[w] for w in want]
