import corpus_pipeline
from loupe.llm.queries import domain, ratings, table
from loupe.llm.decontaminate import leaks
from loupe.llm.quality import fit_quality, score_quality
from loupe.llm.simhash import simhash_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        kept.append((docs, docs := spark.read.parquet(str(tmp_path / str(i)))))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (a, b), (b2, c), (c2, d), (d2, e), (e2, f) = kept
    scored = score_quality(a, fit_quality(a, ratings(spark, SF))).collect()
    assert ids(b) == sorted(r.doc_id for r in scored if r.p_tail >= 0.5) and len(ids(b)) < len(ids(a))
    assert ids(c) == sorted({r.component_id for r in simhash_groups(b).collect()}) and len(ids(c)) < len(ids(b))
    leaking = {r.doc_id for r in leaks(c, table(spark, SF, "benchmark")).collect()}
    assert ids(d) == [i for i in ids(c) if i not in leaking] and leaking
    assert set(ids(e)) <= set(ids(d)) and len(ids(f)) == len(ids(e))
    assert {r.d for r in e.select(domain().alias("d")).distinct().collect()} <= {"web", "books", "forum"}


def test_stages_take_awkward_and_empty_tables(spark, awkward, no_docs):
    for docs in (awkward, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
