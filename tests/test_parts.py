"""Rows that are read many times lie in even parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import learn


def test_training_rows_lie_in_even_parts(spark):
    one = spark.range(4_000).coalesce(1).select("id", F.rand(1).alias("x"))
    train, test = learn.split_tables(one, ["id"])
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * 3_200 / len(sizes)
    assert test.count() == 800


def test_blend_reads_even_parts_of_a_class(spark, monkeypatch):
    """The rows that a blend trains on lie in even parts, and marking a hold-out by class sends no class to one task."""
    from pyspark.ml.functions import array_to_vector

    from tidewatch.operators import sampling

    rows = spark.range(4000).select("id", array_to_vector(F.array(F.col("id") % 7.0, F.col("id") % 5.0)).alias("features"), (F.col("id") % 10 == 0).cast("double").alias("label"))
    read = []
    fit = learn.DecisionTreeClassifier.fit
    monkeypatch.setattr(learn.DecisionTreeClassifier, "fit", lambda self, df, *rest: read.append(df) or fit(self, df, *rest))
    learn.blend(rows, {"decision_tree": learn.decision_tree(depth=2)}, ["id"])
    sizes = [r["n"] for r in read[-1].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) == 2 * spark.sparkContext.defaultParallelism and max(sizes) < 4 * 4000 / len(sizes)
    marked = [sampling.mark_fraction(rows, ["id"], fraction=0.2, by="label", few_classes=few) for few in (True, False)]
    assert "hashpartitioning(label" not in marked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in marked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert marked[0].exceptAll(marked[1]).isEmpty() and marked[0].where("picked").count() == 800


def test_connection_rows_are_written_once(tables, monkeypatch):
    """Whole rows are made and written by the split alone; the errors of a reconstruction are written without them."""
    from tidewatch import runtime
    from tidewatch.plans import learn as plans

    names, keep = [], runtime.materialize
    monkeypatch.setattr(runtime, "materialize", lambda df, name: names.append((name, df.columns)) or keep(df, name))
    monkeypatch.setattr(learn, "materialize", runtime.materialize)
    train, test = learn.split_tables(plans.connection_training(tables), ["flow_no", "flow_line"])
    assert [n for n, _ in names] == ["split"] and train.count() + test.count() == tables.lineitem.count()
    found = learn.reconstruction(train, test, components=8)
    assert names[1:] == [("errors", ["error"])] and found.count() == test.count()


def test_permuted_rows_of_a_linear_model_are_not_copied(tables, monkeypatch):
    from tidewatch.plans import learn as plans

    fitted, _, test = plans.trained(tables)
    fast = learn.permutation_importance(fitted, test, plans.FEATURES, ["row_id"])
    assert "explode" not in fast._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(learn, "LogisticRegressionModel", learn.RandomForestClassifier)  # any other model
    plain = {r["feature"]: r["importance"] for r in learn.permutation_importance(fitted, test, plans.FEATURES, ["row_id"]).collect()}
    got = {r["feature"]: r["importance"] for r in fast.collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in got)
