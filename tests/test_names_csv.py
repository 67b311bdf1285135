"""Ordinary CSV files, columns of any name through every step, session settings by master."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loupe import session
from loupe.functions.names import named, quoted
from loupe.operators import eda as E
from loupe.operators import issues as I
from loupe.operators import prep as P
from loupe.operators import profile as PR
from loupe.operators import report as R
from loupe.sources.csv import read_csv, spans_lines


def _file(text):
    path = os.path.join(tempfile.mkdtemp(prefix="loupe-csv-"), "in.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_quotes_separators_and_line_breaks(spark):
    path = _file('id,"full, name",note\n1,"a ""quoted"" one, too",plain\n2,"two\nlines",""\n3,NA,"x"\n')
    assert spans_lines(spark, path)
    rows = read_csv(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "quoted" one, too', "plain"), (2, "two\nlines", None), (3, None, "x")]
    assert rows[0].asDict().keys() == {"id", "full, name", "note"}
    plain = _file('id,v\n1,"say ""hi"", you"\n2,b\n')
    assert not spans_lines(spark, plain)
    assert [tuple(r) for r in read_csv(spark, plain).orderBy("id").collect()] == [(1, 'say "hi", you'), (2, "b")]


ODD = ["Sepal.Length", "Petal Width", "tick`y", "a.b.c", "kind.of", "the target"]


def odd_frame(spark, n=240):
    path = _file(",".join(ODD) + "\n" + "".join(
        f"{i % 17 + 0.5},{'' if i % 11 == 0 else i % 13},{i % 5},{1000 if i == 7 else i % 10},{'xyz'[i % 3]},{int(i % 17 > 8)}\n" for i in range(n)))
    df = read_csv(spark, path)
    assert df.columns == ODD
    return df


def test_every_step_takes_odd_names(spark):
    df = odd_frame(spark)
    target, nums = "the target", ODD[:4]
    for made in (PR.table_overview(df), PR.preview(df, [named(c) for c in ODD[:2]]), PR.column_types(df), PR.describe(df), PR.categorical_summary(df), PR.class_distribution(df, target),
                 E.missing_summary(df), E.missing_global(df), E.missing_patterns(df), E.outliers_iqr(df, nums), E.outliers_zscore(df, nums), E.boxplot(df, nums), E.boxplot(df, nums, ["kind.of"]),
                 E.histogram(df, nums), E.correlation_matrix(df, nums), E.moments(df, nums), E.value_counts(df, "kind.of"), E.crosstab_pct(df, "kind.of", target),
                 I.issue_report(df, target), I.issue_count(df, target), R.report_tables(df, target), P.drop_duplicates(df), P.class_table(df, target)):
        assert made.count() > 0
    got = {r["column_name"]: r["q50"] for r in PR.describe(df).collect()}
    assert got["Sepal.Length"] == df.agg(F.expr(f"percentile({quoted('Sepal.Length')}, 0.5)")).first()[0]
    filled = P.apply_numeric_imputer(df, P.fit_numeric_imputer(df, nums, "median"), nums)
    assert filled.columns == ODD and filled.where(named("Petal Width").isNull()).count() == 0
    capped = P.cap_outliers(filled, I.flagged_bounds(filled, target))
    assert capped.agg(F.max(named("a.b.c"))).first()[0] < 1000
    hot = P.apply_one_hot(capped, P.fit_one_hot(capped, ["kind.of"]))
    assert hot.columns == [*ODD[:4], "kind.of_y", "kind.of_z", target]
    assert P.label_encode(capped, ["kind.of"]).agg(F.max(named("kind.of"))).first()[0] == 2


def test_workflow_and_models_take_odd_names(spark):
    from loupe.plans.workflow import prepare, train_models
    df = odd_frame(spark).withColumn("row.key", F.monotonically_increasing_id())
    done = prepare(df, "the target", ["row.key"], P.PrepConfig(outlier_handling="cap"))
    train, test = done.data.where("split = 'train'"), done.data.where("split = 'test'")
    got = train_models(train, test, done.features, done.label, "row.key")
    assert [r.status for r in got.status.collect()] == ["ok"] * 7
    acc = {r.model: r.a for r in got.predictions.groupBy("model").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).collect()}
    assert acc["decision_tree"] > 0.95 and acc["logistic_regression"] > 0.9


class Builder:
    """Records what a session builder is told."""

    def __init__(self):
        self.told, self.named = {}, None

    def appName(self, name):
        return self

    def master(self, m):
        self.named = m
        return self

    def config(self, k, v):
        self.told[k] = v
        return self

    def getOrCreate(self):
        raise StopIteration


@pytest.mark.parametrize("master, launched, defaults", [("local[2]", False, True), (None, False, True), ("yarn", False, False), ("spark://h:7077", False, False),
                                                       ("local-cluster[2,1,1024]", False, False), (None, True, False)])
def test_defaults_only_on_local_masters(monkeypatch, master, launched, defaults):
    class Sessions:
        builder = Builder()
        getActiveSession = staticmethod(lambda: None)

    Sessions.builder = Builder()
    monkeypatch.setattr(session, "SparkSession", Sessions)
    monkeypatch.delenv("LOUPE_MASTER", raising=False)
    (monkeypatch.setenv if launched else lambda k, _: monkeypatch.delenv(k, raising=False))("PYSPARK_GATEWAY_PORT", "1")
    with pytest.raises(StopIteration):
        session.get_session(master, **{"spark.sql.shuffle.partitions": "77"})
    told = Sessions.builder.told
    assert told["spark.sql.shuffle.partitions"] == "77" and Sessions.builder.named == (master or (None if launched else "local[*]"))
    assert ("spark.checkpoint.dir" in told) == defaults and (len(told) > 1) == defaults


def test_a_cluster_without_a_checkpoint_folder_is_an_error():
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Spark:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.checkpoint_dir(Spark())
