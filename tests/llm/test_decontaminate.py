import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loupe.llm.decontaminate import SeedParams, drop_leaking, leaks, token_hashes
from loupe.llm.textops import utf8

P = SeedParams()


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items, p=P):
    """Every (doc, item) with a common seed on a diagonal whose best window around it agrees enough."""
    out = {}
    for d, text in docs:
        t = tokens(text)
        for i, item in items:
            u = tokens(item)
            n = min(p.overlap, len(u))
            for shift in range(-len(u) + 1, len(t)):
                a, b = max(shift, 0), min(len(t), len(u) + shift)
                if b - a < max(n, p.span):
                    continue
                same = [t[k] == u[k - shift] for k in range(a, b)]
                if not any(all(same[k + j] for j, c in enumerate(m) if c == "1") for m in p.masks for k in range(len(same) - p.span + 1)):
                    continue
                best = max(sum(same[k:k + n]) for k in range(len(same) - n + 1))
                if best >= p.share * n:
                    out[d, i] = max(out.get((d, i), 0), best)
    return sorted((d, i, n) for (d, i), n in out.items())


def test_equals_brute_force_with_substitutions(spark, make_docs):
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(12, 45)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = rnd.choices(vocab, k=rnd.randint(0, 60))
        if d % 2:
            passage = tokens(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 9)):
                passage[rnd.randrange(len(passage))] = rnd.choice(vocab)
            at = rnd.randint(0, len(words))
            words[at:at] = passage[rnd.randint(0, 3):]
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(w.upper() if rnd.random() < 0.1 else w for w in words)))
    got = leaks(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    found = sorted((r.doc_id, r.item_id, r.n_equal) for r in got.collect())
    assert found == brute(docs, items) and 10 < len(found)
    assert any(n < 20 for _, _, n in found)  # some only match with substitutions


def test_a_full_filter_changes_no_result(spark, make_docs):
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(8)]
    docs = [(d, " ".join(rnd.choices(vocab, k=20) + items[d % 8][1].split()[d % 5:])) for d in range(16)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, leaks(make_docs(docs), bench).collect()))
    assert sorted(map(tuple, leaks(make_docs(docs), bench, SeedParams(filter_bits=7)).collect())) == want


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    exact = set()
    items = [(r.item_id, " " + " ".join(tokens(r.text)) + " ") for r in bench.collect()]
    for r in docs.collect():
        text = " " + " ".join(tokens(r.text)) + " "
        exact |= {(r.doc_id, i) for i, t in items if t in text}
    assert exact and exact <= got
    kept = {r.doc_id for r in drop_leaking(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_awkward_rows(spark, awkward, no_docs, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta " * 6), (1, "alpha beta gamma delta " * 6), (None, "w0 tail0 w1 tail1 w2 tail2 w3 tail3 w4 tail4 w5 tail5 w6 tail6"),
                                   (2, None), (3, ""), (4, "too short")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id) for r in leaks(awkward, bench).collect()), key=str)
    assert got == [(1, 1), (5, None), (6, None)]
    kept = drop_leaking(awkward, bench)
    assert kept.columns == awkward.columns
    left = sorted((r.doc_id for r in kept.collect()), key=str)
    assert left == sorted([1, 2, None, None, 3, 4, 7, 8, 9, 10], key=str)  # the other text with id 1 stays
    assert leaks(no_docs, bench).count() == 0 and drop_leaking(no_docs, bench).count() == 0
    assert leaks(awkward, bench.limit(0)).count() == 0 and drop_leaking(awkward, bench.limit(0)).count() == awkward.count()


def allowed(n, p=P):
    """Substitutions that a window of ``n`` tokens may hold."""
    return n - math.ceil(p.share * n - 1e-9)


def by_overlap(docs, items, p=P):
    """Every (doc, item, most equal tokens) by the overlap criterion alone."""
    out = {}
    for d, text in docs:
        t = tokens(text)
        for i, item in items:
            u = tokens(item)
            n = min(p.overlap, len(u))
            for a in range(len(t) - n + 1 if n else 0):
                for b in range(len(u) - n + 1):
                    same = sum(x == y for x, y in zip(t[a:a + n], u[b:b + n]))
                    if n - same <= allowed(n, p):
                        out[d, i] = max(out.get((d, i), 0), same)
    return sorted((d, i, n) for (d, i), n in out.items())


def test_masks_leave_no_pattern_out():
    for n in range(P.span, P.overlap + 1):
        marked = [{k + j for j, c in enumerate(m) if c == "1"} for m in P.masks for k in range(n - len(m) + 1)]
        missed = [e for e in itertools.combinations(range(n), allowed(n)) if all(m & set(e) for m in marked)]
        assert not missed, (n, len(missed), missed[:3])


def test_equals_the_overlap_criterion_at_its_limit(spark, make_docs):
    rnd = random.Random(9)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(n))) for i, n in enumerate([11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 26])]
    docs = []
    for i, item in items:
        for extra in (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1):
            words = item.split()[:P.overlap]
            for k in rnd.sample(range(len(words)), allowed(len(words)) + extra):
                words[k] = f"other{rnd.getrandbits(40)}"
            docs.append((len(docs), " ".join(["before", *words, "after"])))
    words = items[9][1].split()  # no seed of the four former masks
    docs.append((len(docs), " ".join("other" if k in (1, 6, 8, 9) else w for k, w in enumerate(words))))
    got = leaks(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_equal) for r in got.collect()) == by_overlap(docs, items)


def characters(text):
    """Tokens where Chinese, Japanese and Thai characters stand alone."""
    own = "\u0e00-\u0fff\u2e80-\ua4cf\U00020000-\U0003ffff"
    return re.findall(f"[{own}]|(?:(?![{own}])[0-9a-z\x80-\U0010ffff])+", (text or "").lower())


def test_tokens_of_scripts_without_spaces():
    rnd = random.Random(10)
    rows = ["".join(rnd.choices(["ab", "9", " ", "é", ".", "語", "かな", "ไทย", "한글", "\U00020bb7", "\U0001f600", "—"], k=rnd.randint(0, 12))) for _ in range(300)]
    data, off = utf8(pa.array(rows))
    hashes, first = token_hashes(None, 0, len(rows), data, off)
    want = [characters(r) for r in rows]
    assert list(np.diff(first)) == [len(w) for w in want]
    known = {}
    for h, w in zip(hashes.tolist(), (w for ws in want for w in ws)):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_short_items_and_scripts_without_spaces(spark, make_docs):
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(1, 11)]
    docs = []
    for n, item in items:
        for e in itertools.combinations(range(n), allowed(n)):
            docs.append((len(docs), " ".join(["so", *("z" if k in e else w for k, w in enumerate(item.split())), "on"])))
        spoilt = item.split()
        for k in range(allowed(n) + 1):
            spoilt[k * 2 % n] = "z"
        docs.append((len(docs), " ".join(spoilt)))
    long = len(docs)
    docs += [(long, "q1x0 " * 3000 + items[4][1] + " q2x0 q2x1" * 300)]
    unspaced = [(20, "请问下面哪一个城市是法国的首都"), (21, "日本で一番高い山は何ですか"), (22, "เมืองหลวงของไทย")]
    for _, t in unspaced:
        docs += [(len(docs), f"前文{t}后文"), (len(docs) + 1, f"前文{t[:5]}錯{t[6:]}后文"), (len(docs) + 2, f"前文{t[:4]}")]
    bench = spark.createDataFrame(items + unspaced, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_equal, r.n_compared) for r in leaks(make_docs(docs), bench).collect()}
    want = {(d, i, n, len(tokens(dict(items)[i]))) for d, i, n in by_overlap(docs, items) if d != long}
    assert {g for g in got if g[0] < long} == want and {g[1] for g in want} == set(range(1, 11))
    assert {g[1:] for g in got if g[0] == long} == {(1, 1, 1), (2, 2, 2), (5, 5, 5)}
    copies = [(long + 1 + 3 * k + j, i, min(20, len(t)) - j, min(20, len(t))) for k, (i, t) in enumerate(unspaced) for j in (0, 1)]
    assert {g for g in got if g[0] > long} == set(copies)


def test_short_items_leak_only_as_whole_lines(spark, make_docs):
    docs = make_docs([(1, "yes we can say that this is fine"), (2, "Question?\n YES!\nmore"), (3, "yes"), (None, "Yes."), (5, "a text\nnew  york, city"), (6, "in new york city today"), (7, "请问"),
                      (8, "请问下面"), (9, None)])
    clash = docs.withColumn("_own_hash", F.lit("x")).withColumn("_key", F.lit("y")).withColumn("_text_hash", F.lit("z"))
    bench = spark.createDataFrame([(1, "yes"), (2, "New York City"), (3, "请问"), (4, "...")], "item_id bigint, text string")
    kept = drop_leaking(clash, bench)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6, 8, 9]
    assert {(r._own_hash, r._key, r._text_hash) for r in kept.collect()} == {("x", "y", "z")}
    assert sorted(r.doc_id for r in drop_leaking(docs, bench, alone=1).filter("doc_id IS NOT NULL").collect()) == [9]
