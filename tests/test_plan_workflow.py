import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.plans.feature_plan import FeaturePlan, fit_plan
from tessera.sources.tables import read_table


@pytest.fixture(scope="module")
def orders_plan(spark, sf):
    o = read_table(spark, sf, "orders")
    return o, *fit_plan(o, "o_orderpriority")


def test_plan_decisions(orders_plan):
    o, plan, train, test = orders_plan
    assert plan.task == "Classification"
    assert plan.dropped == {"o_orderkey": "row_number"}
    assert plan.classes == ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    assert "o_orderdate_year" in plan.features and "o_orderstatus_F" in plan.features
    n = train.count() + test.count()
    assert n == o.count()
    assert 0.15 < test.count() / n < 0.25


def test_train_score_consistency(spark, orders_plan):
    o, plan, train, test = orders_plan
    scored = plan.transform(o, keep=["o_orderkey"])
    a = scored.select(vector_to_array("features").alias("v"), "label").orderBy("label", "v").collect()
    b = train.unionByName(test).select(vector_to_array("features").alias("v"), "label").orderBy("label", "v").collect()
    # capping is fit-time only; orders have no capped values at this scale
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x["label"] == y["label"]
        assert x["v"] == pytest.approx(y["v"], abs=1e-9)


def test_save_load_roundtrip(spark, orders_plan):
    o, plan, _, _ = orders_plan
    path = tempfile.mkdtemp(prefix="plan-", dir="/tmp") + "/p"
    plan.save(path)
    back = FeaturePlan.load(spark, path)
    assert back.features == plan.features and back.imputer == plan.imputer
    x = plan.transform(o).select(vector_to_array("features").alias("v")).collect()
    y = back.transform(o).select(vector_to_array("features").alias("v")).collect()
    assert x == y


def test_workflow_predict_and_stream(spark, sf):
    from tessera.operators.models import build
    from tessera.operators.tune import fit_context
    from tessera.plans.workflow import FittedWorkflow
    from tessera.streaming.scoring import predict_stream
    o = read_table(spark, sf, "orders")
    plan, train, test = fit_plan(o, "o_orderpriority")
    model = build(plan.task, "LR", {}, fit_context(train, plan.task)).fit(train)
    wf = FittedWorkflow(plan, model, "LR", {}, None)
    batch = wf.predict(o, keep=["o_orderkey"])
    assert batch.count() == o.count()
    assert set(r[0] for r in batch.select("prediction").distinct().collect()) <= set(plan.classes)
    src = spark.readStream.schema(o.schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    q = predict_stream(wf, src, keep=["o_orderkey"]).writeStream.format("memory").queryName("scored_t").start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.table("scored_t")
    assert streamed.exceptAll(batch.select("o_orderkey", "prediction")).count() == 0
    assert streamed.count() == o.count()


def test_leaderboard_rule(spark, sf):
    from tessera.operators.tune import leaderboard
    d = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents"), "doc_id")
    plan, train, test = fit_plan(d, "quality")
    b = leaderboard(train, test, plan.task, models=["LR", "DT"]).collect()
    assert sum(r["best"] for r in b) == 1
    best = [r for r in b if r["best"]][0]
    assert best["score"] == max(r["score"] for r in b if r["score"] is not None)


def test_score_stream_foreach_batch(spark, sf):
    from tessera.operators.models import build
    from tessera.operators.tune import fit_context
    from tessera.plans.workflow import FittedWorkflow
    from tessera.streaming.scoring import score_stream
    o = read_table(spark, sf, "orders")
    plan, train, _ = fit_plan(o, "o_orderpriority")
    wf = FittedWorkflow(plan, build(plan.task, "DT", {}, fit_context(train, plan.task)).fit(train), "DT", {}, None)
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = spark.readStream.schema(o.schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    q = score_stream(wf, src, base + "/out", base + "/ckpt", keep=["o_orderkey"])
    q.awaitTermination()
    got = spark.read.parquet(base + "/out")
    assert got.count() == o.count()
    assert got.select("o_orderkey", "prediction").exceptAll(wf.predict(o, keep=["o_orderkey"]).select(
        "o_orderkey", "prediction")).count() == 0


def test_few_rows_are_read_in_few_partitions(spark, orders_plan, monkeypatch):
    """A table read many times has the partitions that its size asks for, not those of the shuffle."""
    from tessera.operators import profile
    o, plan, train, _ = orders_plan
    cores = spark.sparkContext.defaultParallelism
    many = o.repartition(40)
    assert profile.sized(many, 1000, 100).rdd.getNumPartitions() == 2 * cores
    assert profile.sized(many, 1000, 1 << 20).rdd.getNumPartitions() == 40     # none is added
    monkeypatch.setattr(profile, "PART_BYTES", 1000)
    assert profile.sized(many, 1500, 10).rdd.getNumPartitions() == max(2 * cores, 15)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.undo()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        again = fit_plan(o, "o_orderpriority")[1]
        assert again.rdd.getNumPartitions() <= 2 * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    real = [i for i, c in enumerate(plan.features) if plan.scaler[c][1] > 1e-12]   # the shares of an id are equal but for rounding
    for x, y in zip(again.orderBy("row_id").collect(), train.orderBy("row_id").collect(), strict=True):
        assert x["row_id"] == y["row_id"] and x["label"] == y["label"] and x["features"].toArray()[real] == pytest.approx(y["features"].toArray()[real])


def test_keys_with_gaps_are_kept(spark, sf):
    """Keys that aren't 0..n-1 become a feature and must come back all the same."""
    from tessera.operators.models import build
    from tessera.operators.tune import fit_context
    from tessera.plans.workflow import FittedWorkflow
    o = read_table(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") * 7 + 3)
    plan, train, _ = fit_plan(o, "o_orderpriority")
    assert "o_orderkey" in plan.inputs
    wf = FittedWorkflow(plan, build(plan.task, "LR", {}, fit_context(train, plan.task)).fit(train), "LR", {}, None)
    got = wf.predict(o, keep=["o_orderkey", "o_custkey"])
    assert got.columns == ["o_orderkey", "o_custkey", "label", "prediction"]
    assert got.select("o_orderkey", "o_custkey").exceptAll(o.select("o_orderkey", "o_custkey")).count() == 0 and got.count() == o.count()
