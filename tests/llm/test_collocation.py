import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loupe.llm import collocation
from loupe.llm.collocation import PhraseParams, collocations, phrase_counts
from loupe.llm.trie import build


def brute(rows, p):
    """rows: (lang, text). Every count by dictionaries, exact integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, p.longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= p.min_count}
    inside = defaultdict(int)
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], a)
    by_lang = defaultdict(list)
    for (lang, w), a in cand.items():
        if inside[lang, w] and 100 * inside[lang, w] >= p.absorb * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, t.decode(), -a, l, r, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, t, l, r) in enumerate(sorted(found)[:p.top]))


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_trie_reaches_every_phrase_and_nothing_else():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(1, 2 ** 64 - 1, 300, dtype=np.uint64))
    found, phrases, number = {}, [], 0
    for k in (1, 2, 3):
        at = np.unique(rng.integers(0, 12 if k == 3 else 300, (4000, k)), axis=0)  # nodes of one and of hundreds of children
        phrases.append((words[at], np.arange(number, number + len(at))))
        found |= {tuple(words[a].tolist()): number + i for i, a in enumerate(at)}
        number += len(at)
    trie = build(words, phrases, True)
    keys = np.concatenate([rng.choice(words, 3000), rng.integers(1, 2 ** 63, 200, dtype=np.uint64), np.zeros(100, np.uint64)])
    rng.shuffle(keys)
    code = trie.codes(keys)
    assert (code[np.isin(keys, words)] > 0).all() and (code[~np.isin(keys, words)] == 0).all()
    for k, (pos, state) in enumerate(collocation.advance(trie, code, 3), 1):
        rows = dict(zip(pos.tolist(), trie.row[state].tolist()))
        for i in range(len(keys) - k + 1):
            assert max(rows.get(i, -1), -1) == found.get(tuple(keys[i:i + k].tolist()), -1)


@pytest.mark.parametrize("tries, longest", [(1 << 20, 5), (7, 5), (1 << 20, 2)])
def test_equals_brute_force(spark, make_docs, monkeypatch, tries, longest):
    """Also with tries of at most seven phrases, which take several sweeps, and short streams and vectors."""
    monkeypatch.setattr(collocation, "STREAM_WORDS", 50)
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(15)] + ["É", "ÑU", "a'b"]
    phrases = [" ".join(rnd.choices(vocab, k=rnd.randint(2, 6))) for _ in range(8)]
    rows = []
    for i in range(300):
        text = " ".join(rnd.choice(phrases) if rnd.random() < 0.5 else rnd.choice(vocab).upper() + rnd.choice(["", "", ".", " ,", "\n", "\t"]) for _ in range(rnd.randint(0, 12)))
        rows.append((i, text, rnd.choice(["en", "en", "fr", None]), "s"))
    rows += rows[:20]
    p = PhraseParams(longest=longest, min_count=12, trie_phrases=tries, top=40, slices=3)
    assert result(collocations(make_docs(rows), p)) == brute([(r[2], r[1]) for r in rows], p)


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch, make_docs):
    big = spark.createDataFrame([("x", "a b", 2, 10 ** 12), ("x", "a", 1, 3 * 10 ** 12 + 1), ("x", "b", 1, 7 * 10 ** 12 + 3)], "lang string, phrase string, size int, f bigint")
    monkeypatch.setattr(collocation, "phrase_counts", lambda docs, p: (big, spark.createDataFrame([("x", 10 ** 15 + 7)], "lang string, n bigint")))
    row = collocations(make_docs([])).first()
    assert row.score == 1000 * 10 ** 12 * (10 ** 15 + 7) // ((3 * 10 ** 12 + 1) * (7 * 10 ** 12 + 3))


def test_awkward_rows(awkward, no_docs, make_docs):
    p = PhraseParams(min_count=3)
    rows = [(r.lang, r.text) for r in awkward.select("lang", "text").collect()]
    assert result(collocations(awkward, p)) == brute(rows, p)
    assert collocations(no_docs, p).count() == 0 and collocations(make_docs([(1, "one"), (2, None)]), p).count() == 0
    counts, totals = phrase_counts(make_docs([(1, "a b. a b; b", "en")]), PhraseParams(min_count=2))
    assert {(r.phrase, r.f) for r in counts.collect()} == {("a", 2), ("b", 3), ("a b", 2)} and totals.first().n == 5
