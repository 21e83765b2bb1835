"""fit_orders runs the whole workflow: report, every model, the reference's trials and folds, evaluation."""

from pyspark.ml.classification import DecisionTreeClassifier

from tessera.operators import tune as U
from tessera.operators.models import registry
from tessera.plans import workflow as W
from tessera.queries import QUERIES


def test_fit_orders_leaves_nothing_out(spark, tmp_path, monkeypatch):
    sf = f"file://{tmp_path}"
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(150).write.parquet(f"{sf}/orders.parquet")
    called, built = [], []

    def spied(module, name):
        own = getattr(module, name)

        def run(*args, **kwargs):
            out = own(*args, **kwargs)
            called.append((name, out))
            return out
        monkeypatch.setattr(module, name, run)

    def stump(task, name, params, ctx):      # every fit is made, of a model that is quick
        built.append((name, str(params)))
        return DecisionTreeClassifier(maxDepth=1 if name == "GB" else 0)

    for module, name in ((W.analyze, "report"), (W, "tune"), (W, "evaluate")):
        spied(module, name)
    monkeypatch.setattr(U, "build", stump)
    rows = QUERIES["fit_orders"](spark, sf).collect()
    names = list(registry("Classification"))
    assert sorted(r["model"] for r in rows) == sorted(names) and sorted(r["rank"] for r in rows) == list(range(1, 8))
    assert [n for n, p in built if p == "{}"] and {n for n, p in built if p == "{}"} == set(names)
    assert [n for n, _ in called] == ["report", "tune", "evaluate"]
    trials = [r["params"] for r in dict(called)["tune"][3].collect()]
    best = next(r["model"] for r in rows if r["best"])
    assert len(trials) == 10
    if best != "LR":                         # whose trials and folds share their passes
        assert sum(p != "{}" for _, p in built) == 10 * 5 + 1
