"""IO-6..8: report sinks. Sections are written long-form as parquet (the
distributed form) and as one nested JSON document in the reference's shape,
built from the sections' few rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

DESCRIBE_KEYS = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%",
                 "q50": "50%", "q75": "75%", "max": "max", "skewness": "skewness"}
OUTLIER_KEYS = {"q1": "Q1", "q3": "Q3", "iqr": "IQR", "lower_bound": "lower_bound",
                "upper_bound": "upper_bound", "outlier_count": "outlier_count",
                "outlier_percent": "outlier_percent"}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]      # report sections: one row per column


def nested_report(sections: dict[str, DataFrame]) -> dict:
    out: dict = {}
    for name, df in sections.items():
        rows = _rows(df)
        if name in ("dataset_overview", "target_analysis"):
            out[name] = rows[0] if rows else {}
        elif name == "column_analysis":
            out[name] = rows
        elif name == "numeric_analysis":
            out[name] = {r["column"]: {v: r[k] for k, v in DESCRIBE_KEYS.items()} for r in rows}
        elif name == "outlier_analysis":
            out[name] = {r["column"]: {v: r[k] for k, v in OUTLIER_KEYS.items()} for r in rows}
        elif name == "categorical_analysis":
            out[name] = {r["column"]: {"Categories Count": r["categories_count"]} for r in rows}
        elif name == "correlations":
            m: dict = {}
            for r in rows:
                m.setdefault(r["column_a"], {})[r["column_b"]] = r["corr"]
            out[name] = m
        else:
            out[name] = rows
    return out


def write_json(spark: SparkSession, doc, path: str) -> None:
    spark.createDataFrame([(json.dumps(doc, indent=4, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """IO-6: ``path/<section>`` parquet plus ``path/analysis.json``."""
    spark = next(iter(sections.values())).sparkSession
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_json(spark, nested_report(sections), f"{path}/analysis.json")


def write_evaluation(metrics: DataFrame, path: str) -> None:
    """IO-7: the one-row metrics DataFrame as ``evaluation.json``."""
    row = metrics.first().asDict()
    write_json(metrics.sparkSession, row, f"{path}/evaluation.json")


def write_inputs(spark: SparkSession, inputs: list[str], path: str) -> None:
    """IO-8: the scoring input contract (feature names before vectorising)."""
    write_json(spark, inputs, f"{path}/inputs.json")
