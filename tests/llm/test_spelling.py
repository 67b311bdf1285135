import random
import re
import zlib
from collections import Counter

import pytest

from loupe.llm.spelling import near_pairs, runs_of, spelling_groups, spelling_variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_counts(rows, least, at_least, noise):
    n = Counter()
    for d, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= at_least}


def brute_groups(n, factor):
    form, near = {}, {w: [v for v in n if one_edit(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_forms_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    letters = "aeé" if seed == 1 else "abcdefghñ"
    words = {"".join(rnd.choices(letters, k=rnd.randint(4, 8 if seed == 1 else 12))) for _ in range(150)}
    for w in list(words):  # edits of edits, so that chains form
        for _ in range(3):
            i, c = rnd.randrange(len(w)), rnd.choice(letters)
            w = rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            words |= {w} if len(w) >= 4 else set()
    n = {w: rnd.choice([2, 3, 20, 30, 250, 3000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    pairs = near_pairs(df, 4).collect()
    assert sorted(tuple(sorted((r.u, r.v))) for r in pairs) == sorted({(a, b) for a in n for b in n if a < b and one_edit(a, b)})
    assert len({(r.u, r.v) for r in pairs}) == len(pairs) and all(r.n_u == n[r.u] and r.n_v == n[r.v] for r in pairs)
    assert result(spelling_groups(df, 4)) == brute_groups(n, 10)


def test_chains_are_followed_to_the_end(spark):
    word = "abcdefghij"
    n = {word[:10 - k] + "z" * k if k else word: 2 * 10 ** k for k in range(8)}
    got = {r.word: r.root for r in spelling_groups(spark.createDataFrame(list(n.items()), "word string, n bigint"), 7).collect()}
    assert set(got.values()) == {"abczzzzzzz"}


def test_long_texts_are_cut_between_runs(monkeypatch):
    from loupe.llm import spelling

    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "abcdefg hij klmnopqrstuvwxyz éàü " * 5
    assert sum(runs_of(text, 3), []) == re.findall("[a-zÀ-ÿ]{3,}", text)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spelling_variants(docs)) == brute_groups(brute_counts(rows, 7, 2, 31), 10)


def test_awkward_rows(awkward, no_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert result(spelling_variants(awkward, least=4)) == brute_groups(brute_counts(rows, 4, 2, 31), 10)
    assert spelling_variants(no_docs).count() == 0 and spelling_variants(make_docs([(1, "a b"), (2, None)])).count() == 0
