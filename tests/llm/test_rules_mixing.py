import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loupe.llm.mixing import MixParams, leaf_budgets, mix, mix_documents
from loupe.llm.rules import default_rules, estimate, posterior, quality_by_rules, text_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = {}
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check_measures(df):
    got = sorted((tuple(r) for r in text_measures(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    want = sorted(((r.doc_id, *measures(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_measures_equal_brute_force(spark, make_docs, awkward):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "c ", "dd ", "\n", "\t", "| ", "$", "é", "\U0001f600 ", "\x0b", "\x1c"]) for _ in range(rnd.randint(0, 80)))) for i in range(150)]
    check_measures(make_docs(rows))
    check_measures(awkward)
    check_measures(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_estimate_finds_the_hidden_classes():
    rnd = random.Random(1)
    good, bad = [0.995, 0.992, 0.999, 1.0], [0.4, 0.3, 0.5, 0.2]
    seen, patterns = [], {}
    for _ in range(20_000):
        y = rnd.random() < 0.85
        votes = tuple(-1 if rnd.random() < 0.2 else int((rnd.random() < good[j]) if y else not (rnd.random() < bad[j])) for j in range(4))
        seen.append((y, votes))
        patterns[votes] = patterns.get(votes, 0) + 1
    model = estimate(sorted(patterns.items()), 4)
    assert abs(model.prior - 0.85) < 0.05
    assert all(abs(a - b) < 0.08 for a, b in zip(model.good, good)) and all(abs(a - b) < 0.15 for a, b in zip(model.bad, bad))
    right = sum((posterior(v, model) >= 0.5) == y for y, v in seen) / len(seen)
    assert right > 0.95
    assert estimate([], 4).prior == 0.8


def test_verdict_follows_votes_and_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_by_rules(docs).collect()
    names = [f"vote_{k}" for k in default_rules()]
    patterns = {}
    for r in got:
        v = tuple(r[n] for n in names)
        patterns[v] = patterns.get(v, 0) + 1
    model = estimate(sorted(patterns.items()), len(names))
    for r in got:
        p = posterior(tuple(r[n] for n in names), model)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert math.isclose(r.p_good, p, abs_tol=1e-9) and r.base_failed == failed and r.kept == (not failed and p >= 0.5)
    marked = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [r for r in got if marked.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r for r in got if marked.get(r.doc_id) == 0]
    assert sum(r.kept for r in clean) / len(clean) > 0.98 and sum(r.kept for r in poor) / len(poor) < 0.2


def test_rules_on_awkward_rows(awkward, no_docs):
    assert quality_by_rules(awkward).count() == awkward.count() and quality_by_rules(no_docs).count() == 0


def brute_fill(nodes, budget):
    """nodes: name -> (weight, limit): raise the level until the budget is spent."""
    nodes = {k: v for k, v in nodes.items() if v[0] > 0}
    share, open_ = {}, dict(nodes)
    while open_:
        level = budget / sum(w for w, _ in open_.values())
        full = [k for k, (w, lim) in open_.items() if lim <= level * w]
        if not full:
            return share | {k: level * w for k, (w, _) in open_.items()}
        for k in full:
            share[k] = open_.pop(k)[1]
            budget -= share[k]
    return share


def brute_budgets(supply, p):
    weight = lambda table, k: table.get(k, p.other)
    lim = {k: s * p.max_epochs for k, s in supply.items() if s}
    total = p.budget if p.budget is not None else sum(supply.values()) * p.budget_share
    under = lambda *head: sum(v for k, v in lim.items() if k[:len(head)] == head)
    out = {}
    for d, bd in brute_fill({d: (weight(p.domains, d), under(d)) for d in {k[0] for k in lim}}, total).items():
        for la, bl in brute_fill({x: (weight(p.languages, x), under(d, x)) for x in {k[1] for k in lim if k[0] == d}}, bd).items():
            for s, b in brute_fill({x: (weight(p.sources, x), lim[d, la, x]) for x in {k[2] for k in lim if k[:2] == (d, la)}}, bl).items():
                out[d, la, s] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_budgets_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    supply = {(f"d{a}", f"l{b}", f"s{c}"): rnd.choice([0, 1, 10, 1000, 50_000]) for a in range(3) for b in range(3) for c in range(4) if rnd.random() < 0.8}
    p = MixParams(domains={"d0": 5.0, "d1": 1.0}, languages={"l0": 3.0, "l2": 0.0}, sources={"s1": 2.5}, other=0.7, budget_share=rnd.choice([0.1, 0.9, 1.7, 5.0]), max_epochs=3)
    df = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, supply bigint")
    got = {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(df, p).collect()}
    want = brute_budgets(supply, p)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = MixParams(domains={"src0": 3.0}, languages={"en": 2.0}, budget_share=1.3, max_epochs=3, seed=5)
    got = sorted((r.doc_id, r.epoch) for r in mix(docs, F.col("source"), p).collect())
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = [((r.doc_id, md5(r.text or "")), (r.source, r.lang, r.source), len(WORD.findall(r.text or ""))) for r in docs.collect()]
    supply = {}
    for _, leaf, n in rows:
        supply[leaf] = supply.get(leaf, 0) + n
    want = []
    for leaf, b in brute_budgets(supply, p).items():
        budget = math.floor(b + 1e-6)
        epochs, rest = divmod(budget, supply[leaf])
        mine = sorted((md5(f"5:{epochs}:{d}:{digest}:0"), d, n) for (d, digest), x, n in rows if x == leaf)
        used = 0
        for _, d, n in mine:
            used += n
            want += [(d, e) for e in range(epochs + (used <= rest))]
    assert got == sorted(want)
    assert sum(1 for _, e in got if e > 0) > 0


def test_mixing_keeps_columns_and_takes_awkward_rows(spark, awkward, no_docs):
    p = MixParams(budget_share=2.0, max_epochs=2)
    got = mix_documents(awkward, F.col("source"), p)
    assert got.columns == awkward.columns
    rows = [r.doc_id for r in got.collect()]
    assert rows.count(5) == 2 and rows.count(1) == 6  # every row of a leaf with tokens, twice
    assert mix(no_docs, F.col("source"), p).count() == 0 and mix_documents(no_docs, F.col("source"), p).count() == 0
    assert mix(awkward, F.col("source"), MixParams(budget=0)).filter("n_tokens > 0").count() == 0


@pytest.mark.parametrize("repeat", ["ids", "rows", "nulls"])
def test_equal_ids_fill_the_budget(spark, repeat):
    rows = [(None if repeat == "nulls" else 7, "one two three four" if repeat == "rows" else f"one two three w{i}", "en", "s1", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for share, least in ((0.5, 500), (1.25, 1250)):
        p = MixParams(budget_share=share, max_epochs=3)
        assert mix(docs, F.col("source"), p).count() == mix_documents(docs, F.col("source"), p).count() == least
