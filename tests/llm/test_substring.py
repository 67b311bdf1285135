import random
from hashlib import sha256

import pytest

from loupe.llm.substring import deduplicated_texts, duplicate_factors, join_factors, substring_dedup


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force_on_shuffled_passages(make_docs, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(4 if seed == 1 else 40)]  # a tiny vocabulary has periodic runs and equal anchors
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 12))]
        rows.append((rnd.randint(0, 45), "  ".join(words)))
    rows += [rows[0], rows[1], (None, rows[2][1]), (50, None), (51, "")]
    assert result(substring_dedup(make_docs(rows), window=8, seed=3)) == brute(rows, 8)


def test_one_repeated_word_and_exact_copies(make_docs):
    rows = [(i, "again " * (60 + i)) for i in range(5)] + [(9, " ".join(f"a{i}" for i in range(200)))] * 2 + [(12, " ".join(f"a{i}" for i in range(200)))]
    assert result(substring_dedup(make_docs(rows))) == brute(rows, 50)


def test_factors_name_their_source(make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (3, f"x {a} {b} {c}")]
    parsed, factors = duplicate_factors(make_docs(rows), window=10, seed=3)
    got = deduplicated_texts(factors, 10).collect()
    assert [(r.doc_id, [tuple(f) for f in r.factors]) for r in got] == [(3, [(1, 30, 1, 0), (31, 30, 2, 0)])]
    assert got[0].kept_text == f"x {c}" and parsed.count() == 3


def test_join_factors_joins_what_follows_in_the_source_too():
    spans = [{"at": 0, "n": 3, "source": 1, "source_at": 7}, {"at": 3, "n": 2, "source": 1, "source_at": 10}, {"at": 5, "n": 1, "source": 2, "source_at": 0},
             {"at": 6, "n": 1, "source": 2, "source_at": 4}, {"at": 9, "n": 1, "source": 2, "source_at": 7}]
    assert join_factors(spans, 4) == [(0, 8, 1, 7), (5, 4, 2, 0), (6, 4, 2, 4), (9, 4, 2, 7)]


def test_factors_are_runs_of_their_source(make_docs):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:50] + ["x"] + w[1:51])), (2, " ".join(w[:51])), (3, " ".join(w[:51])), (4, " ".join(["y", *w[1:51], "z", *w[:50]]))]
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in deduplicated_texts(duplicate_factors(make_docs(rows))[1]).collect()}
    assert got == {2: [(0, 50, 1, 0), (1, 50, 1, 51)], 3: [(0, 51, 2, 0)], 4: [(1, 50, 1, 51), (52, 50, 1, 0)]}


@pytest.mark.parametrize("seed", [4, 5])
def test_every_factor_stands_in_its_source(make_docs, seed):
    rnd = random.Random(seed)
    passages = [[f"w{rnd.randrange(60)}" for _ in range(rnd.randint(8, 40))] for _ in range(10)]
    rows = [(i, " ".join(sum((rnd.choice(passages) + [f"u{rnd.random()}"] * (rnd.random() < 0.5) for _ in range(rnd.randint(1, 5))), []))) for i in range(40)]
    words = {i: t.split() for i, t in rows}
    gone = {i: set() for i in words}
    for r in deduplicated_texts(duplicate_factors(make_docs(rows), 8, 3)[1], 8).collect():
        for a, n, source, at in r.factors:
            assert source < r.doc_id and n >= 8 and words[r.doc_id][a:a + n] == words[source][at:at + n]
            gone[r.doc_id] |= set(range(a, a + n))
    assert [(i, len(g)) for i, g in sorted(gone.items())] == sorted((i, n) for i, _, n, _ in brute(rows, 8))


def test_repeated_rows_are_parsed_once(make_docs):
    text = " ".join(f"p{i}" for i in range(120))
    df = make_docs([(1, text)] + [(2, f"q {text} r")] * 300 + [(3, "q " + text)])
    spans = duplicate_factors(df)[1].selectExpr("doc_id", "size(spans) AS n").collect()
    assert sorted(r.doc_id for r in spans) == [2, 3] and sum(r.n for r in spans) < 300
    got = result(substring_dedup(df))
    assert len(got) == 302 and sum(r[2] == 120 for r in got) == 300 and got[-1][:3] == (3, 121, 121)


def test_awkward_rows(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert result(substring_dedup(awkward)) == brute(rows, 50)
    assert result(substring_dedup(no_docs)) == []
