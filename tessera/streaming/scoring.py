"""SCO-2: scoring an unbounded table with a fitted workflow.

Two forms:
* ``predict_stream`` - the plan and an MLlib model are pure per-row
  transforms plus stream-static broadcast joins, so the scored stream is an
  ordinary streaming DataFrame (stateless, no watermark needed).
* ``score_stream`` - ``foreachBatch`` applies the batch ``predict`` to every
  micro-batch and appends to a parquet sink; works for every model,
  including the KNN join, and is exactly-once with the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import decode_label


def predict_stream(wf, sdf: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    feats = wf.plan.transform(sdf, keep=keep)
    out = wf.model.transform(feats)
    pred = out.select(*[c for c in keep if c in out.columns], F.col("prediction").cast("double").alias("prediction"))
    if wf.plan.classes is not None:
        pred = decode_label(pred, "prediction", wf.plan.classes)
    return pred


def score_stream(wf, sdf: DataFrame, sink_path: str, checkpoint: str, keep: list[str] | tuple = (),
                 trigger_once: bool = True):
    """Start the micro-batch scoring query; returns the ``StreamingQuery``."""
    def batch(bdf: DataFrame, epoch: int) -> None:
        wf.predict(bdf, keep=keep).withColumn("epoch", F.lit(epoch)) \
            .write.mode("append").parquet(sink_path)

    w = sdf.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
