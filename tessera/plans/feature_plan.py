"""FeaturePlan: every fitted preprocessing step in one object.

``fit_plan(df, target)`` runs the reference's preprocessing order
(validate, prune, date coercion, typing, date features, task, impute,
de-duplicate, text, de-skew, cap, encode, split, scale, project) where each
step is a small aggregate (fit) followed by pure column expressions
(transform). ``plan.transform(df)`` replays the transforms for batch or
streaming scoring, so training and scoring share one code path.
Scalars persist as JSON; dictionaries too large for JSON persist as parquet.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field, fields

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import DATE_FORMATS, parse_with
from ..operators import clean, datefeat, encode, shape
from ..operators import split as S
from ..operators.profile import column_stats, distinct_and_parsed, q, row_width, sized, text_columns, value_counts
from ..operators.prune import prune_columns
from ..operators.tfidf import fit_tfidf, tfidf_columns, tokenize
from ..operators.types import coerce_dates, feature_types, group_types, problem_type, rates_from_profile
from ..operators.validate import validate
from ..session import ensure_checkpoint_dir
from ..sources.tables import normalize_nan

PCA_WHEN_OVER = 50
PCA_COMPONENTS = 10
KEY = "__row_key"


def row_key(cols: list[str], seed: int):
    """md5 of the raw row (every input column as text): what splits, folds and
    row ids hang on, so that they don't depend on fitted numbers or partitions."""
    parts = [F.coalesce(F.col(q(c)).cast("string"), F.lit("\\N")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hex_number(key, start: int, digits: int):
    """The hexadecimal digits of ``key`` from ``start`` (1-based) as a bigint."""
    return F.conv(F.substring(key, start, digits), 16, 10).cast("bigint")


@dataclass
class FeaturePlan:
    target: str
    task: str = ""
    input_schema: str = ""                              # raw input StructType as JSON
    dropped: dict = field(default_factory=dict)         # PRJ: column -> rule
    coerced: dict = field(default_factory=dict)         # TYP-1/2: column -> format
    types: dict = field(default_factory=dict)           # TYP-4: column -> feature type
    dates: dict = field(default_factory=dict)           # DT: column -> {min_micros, with_time}
    imputer: dict = field(default_factory=dict)         # MIS: {"mean": {...}, "mode": {...}}
    text: dict = field(default_factory=dict)            # TXT: column -> tf-idf params
    yeo: dict = field(default_factory=dict)             # SKW: column -> {lambda, mean, std}
    caps: dict = field(default_factory=dict)            # OUT: column -> bounds (fit only by default)
    encoders: dict = field(default_factory=dict)        # ENC: column -> params (tables kept aside)
    classes: list | None = None                         # ENC-1: label classes
    inputs: list = field(default_factory=list)          # IO-8: columns a scoring row must carry
    features: list = field(default_factory=list)        # encoded columns, in order
    scaler: dict = field(default_factory=dict)          # SCL: column -> [mean, std]
    pca: dict | None = None                             # PCA: components and means
    cap_at_scoring: bool = False
    null_target_rows: int = 0
    duplicates_dropped: int = 0
    tables: dict = field(default_factory=dict, repr=False)   # encoder column -> DataFrame (not JSON)

    # ------------------------------------------------------------------ transform

    def prepare(self, df: DataFrame, capped: bool = False, keep: list[str] | tuple = ()) -> DataFrame:
        """Raw rows -> encoded, aligned (unscaled) feature columns (+ label
        when the target is present; ``keep`` columns ride along untouched)."""
        df = normalize_nan(df)
        has_target = self.target in df.columns
        keep = [k for k in keep if k in df.columns and k not in self.inputs and k != self.target]
        cols = keep + [c for c in self.inputs if c in df.columns] + ([self.target] if has_target else [])
        df = df.select(*[F.col(q(c)) for c in cols])
        if self.coerced:
            df = df.select(*[parse_with(F.col(q(c)), self.coerced[c]).alias(c) if c in self.coerced
                             else F.col(q(c)) for c in df.columns])
        if self.dates:
            df = datefeat.date_features(df, {c: p for c, p in self.dates.items() if c in df.columns})
        df = clean.impute(df, self.imputer)
        for c, p in self.text.items():
            if c in df.columns:
                df = tfidf_columns(df, p)
        if self.yeo:
            df = shape.yeo_johnson_transform(df, self.yeo)
        if self.caps and (capped or self.cap_at_scoring):
            df = shape.cap_outliers(df, self.caps)
        enc = {}
        for c, p in self.encoders.items():
            enc[c] = {**p, "table": self.tables[c]} if p.get("kind") == "frequency" and c in self.tables else p
        df = encode.encode(df, enc)
        if has_target and self.classes is not None:
            df = encode.encode_label(df, self.target, self.classes)
        feats = [F.col(q(c)).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c)
                 for c in self.features]          # PRJ-7: absent -> 0, extra dropped
        kept = [F.col(q(k)) for k in keep]
        if has_target:
            return df.select(*kept, *feats, F.col(q(self.target)).cast("double").alias("label"))
        return df.select(*kept, *feats)

    def finish(self, df: DataFrame) -> DataFrame:
        """Scale, project and assemble ``features`` (keeps ``label`` and any
        pass-through columns)."""
        extra = [c for c in df.columns if c not in self.features]
        df = S.scale(df, {c: tuple(v) for c, v in self.scaler.items()})
        cols = self.features
        if self.pca:
            df = S.pca_transform(df, self.pca, keep=extra, prefix="pc")
            cols = [f"pc{i}" for i in range(len(self.pca["components"]))]
        # the assembler resolves names as expressions, so columns such as ``tax_0.0`` get plain ones
        plain = [f"__x{i}" for i in range(len(cols))]
        df = df.select(*[F.col(q(c)) for c in extra], *[F.col(q(c)).alias(x) for c, x in zip(cols, plain)])
        asm = VectorAssembler(inputCols=plain, outputCol="features", handleInvalid="keep")
        return asm.transform(df).select(*[F.col(q(c)) for c in extra], "features")

    def transform(self, df: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
        """SCO-1: raw rows -> ``features`` (+ ``label`` if present)."""
        return self.finish(self.prepare(df, keep=keep))

    # ------------------------------------------------------------------ persistence

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        os.makedirs(path, exist_ok=True) if "://" not in path else None
        meta = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "tables"}
        enc = {}
        for c, p in self.encoders.items():
            enc[c] = {k: v for k, v in p.items() if k != "table"}
        meta["encoders"] = enc
        meta["table_columns"] = list(self.tables)
        for i, t in enumerate(self.tables.values()):
            t.write.mode("overwrite").parquet(f"{path}/tables/{i}")
        spark.createDataFrame([(json.dumps(meta),)], "plan string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/plan")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeaturePlan":
        meta = json.loads(spark.read.text(f"{path}/plan").first()[0])
        cols = meta.pop("table_columns", [])
        plan = FeaturePlan(**meta)
        plan.scaler = {c: tuple(v) for c, v in plan.scaler.items()}
        plan.tables = {c: spark.read.parquet(f"{path}/tables/{i}") for i, c in enumerate(cols)}
        return plan


# ---------------------------------------------------------------------- fit

def fit_plan(df: DataFrame, target: str, seed: int = 42, test_size: float = 0.2, scale: bool = True,
             distinct_cap: int | None = None, exact_test: bool = False):
    """Fit every preprocessing step. The test part is a share of about ``test_size``
    by row hash, or with ``exact_test`` the ceil(test_size n) rows of the smallest hash. Returns ``(plan, train, test)`` where
    train/test carry ``row_id``, ``features`` and ``label`` and are
    checkpointed (lineage cut in the shared checkpoint folder)."""
    validate(df, target)
    ensure_checkpoint_dir(df.sparkSession)     # the cluster's shared folder; a local one only if unset
    raw = normalize_nan(df)
    plan = FeaturePlan(target=target, input_schema=raw.schema.json())

    # PRJ: name rules before any scan, then data rules from one profile
    df, plan.dropped = prune_columns(raw, target)

    # TYP-1: early date coercion (> 0.6 of all rows), then typing on one cached frequency table
    df, plan.coerced = coerce_dates(df, 0.6, exclude=[target])
    prof = column_stats(df)
    rows, width = prof[target].n_rows, row_width(prof)
    freq = sized(value_counts(df, named=text_columns(df, prof, [target])), rows, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        distinct_and_parsed(df, prof, freq, DATE_FORMATS)
        rates = rates_from_profile(prof)
        plan.types = feature_types(df, prof, distinct_cap=distinct_cap, rates=rates)
        # TYP-2: late coercion of string columns typed datetime (by their non-null rate) or over 0.5 of all rows
        late = {c: r["format"] for c, r in rates.items() if c != target and c not in plan.coerced
                and (plan.types[c] == "datetime" or r["rate_all"] > 0.5)}
        plan.coerced.update(late)
        plan.types.update(dict.fromkeys(late, "datetime"))
        # from here on every row carries the key of its raw columns
        df = raw.select(row_key(raw.columns, seed).alias(KEY),
                        *[parse_with(F.col(q(c)), plan.coerced[c]).alias(c) if c in plan.coerced else F.col(q(c))
                          for c in df.columns])
        groups = group_types(plan.types)
        plan.task = problem_type(df, target, prof[target])

        # DT: fitted minimum / time flag per datetime column (target exempt)
        dt_cols = [c for c in groups["datetime"] if c != target]
        plan.dates = datefeat.fit_dates(df, dt_cols)

        # rows without a target cannot train (recorded deviation)
        plan.null_target_rows = prof[target].missing
        df = df.where(F.col(q(target)).isNotNull())

        # MIS: imputers fitted on all (non-null-target) rows
        num = [c for c in groups["numerical"] if c != target]
        modes = [c for c in groups["categorical"] + groups["id"] + groups["boolean"] if c != target]
        freq_ok = plan.null_target_rows == 0
        plan.imputer = clean.fit_imputer(df, num, modes, freq if freq_ok else None)
    finally:
        freq.unpersist()
    plan.inputs = [c for c in df.columns if c not in (target, KEY)]

    df = datefeat.date_features(df, plan.dates)
    derived = [c for c in df.columns if c not in plan.types and c not in (target, KEY)]
    if derived:
        plan.imputer["mean"].update(clean.means(df, derived))
    text_cols = [c for c in groups["text"] if c != target]
    for c in text_cols:
        plan.imputer["mode"][c] = ""
    df = clean.impute(df, plan.imputer)

    # DUP-2 (after imputation); materialise: every later fit reads it
    before = prof[target].n_rows - plan.null_target_rows
    df = df.groupBy(*[F.col(q(c)) for c in df.columns if c != KEY]).agg(F.min(KEY).alias(KEY))
    df = sized(df, before, width + 8 * len(derived) + 48).persist(StorageLevel.MEMORY_AND_DISK)
    plan.duplicates_dropped = before - df.count()

    # TXT: tokenize once into the persisted frame, fit, then vectorise
    cached = [df]
    if text_cols:
        for c in text_cols:
            df = tokenize(df, c)
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(df)
    for c in text_cols:
        plan.text[c] = fit_tfidf(df, c, 100)
        df = tfidf_columns(df, plan.text[c])

    # SKW: Yeo-Johnson for |G1| > 0.5
    if num:
        st = column_stats(df, num)
        plan.yeo = shape.fit_yeo_johnson(df, shape.skewed_columns(st, num))
        df = shape.yeo_johnson_transform(df, plan.yeo)

    # OUT: bounds fitted and applied at fit time (scoring skips them by default)
    if num:
        plan.caps = shape.fit_outliers(df, num)
        df = shape.cap_outliers(df, plan.caps)

    # ENC
    enc_cols = [c for c in groups["categorical"] + groups["id"] if c != target and c in df.columns]
    fitted = encode.fit_encoders(df, enc_cols)
    for c, p in fitted.items():
        if "table" in p:
            plan.tables[c] = p["table"].checkpoint()
            plan.encoders[c] = {k: v for k, v in p.items() if k != "table"}
        else:
            plan.encoders[c] = p
    if plan.task == "Classification":
        plan.classes = encode.fit_label(df, target)
    df = encode.encode(df, fitted)
    if plan.classes is not None:
        df = encode.encode_label(df, target, plan.classes)
    plan.features = [c for c in df.columns if c not in (target, KEY)]

    # SPL: split and row id from the key of the raw row; materialise once
    df = df.select(*[F.col(q(c)).cast("double").alias(c) for c in plan.features],
                   F.col(q(target)).cast("double").alias("label"),
                   (hex_number(F.col(KEY), 1, 8) / F.lit(4294967296.0) < F.lit(test_size)).alias("is_test"),
                   hex_number(F.col(KEY), 9, 15).alias("row_id"), *([F.col(KEY)] if exact_test else [])).checkpoint()
    if exact_test:      # keys are hashes of distinct rows
        df = df.withColumn("is_test", S.smallest(df, F.col(KEY), math.ceil(test_size * df.count()))[0]).drop(KEY)
    for c in cached:          # the checkpoint now holds everything later steps read
        c.unpersist()
    train_raw, test_raw = df.where(~F.col("is_test")), df.where(F.col("is_test"))

    # SCL on the training part (population std)
    plan.scaler = S.fit_scaler(train_raw, plan.features) if scale else {}
    # PCA-1 when the encoded table (with target) is wider than 50 columns
    if len(plan.features) + 1 > PCA_WHEN_OVER:
        scaled = S.scale(train_raw, plan.scaler)
        plan.pca = S.fit_pca(scaled, plan.features, PCA_COMPONENTS)
    train = plan.finish(train_raw.drop("is_test"))
    test = plan.finish(test_raw.drop("is_test"))
    return plan, train, test


def plan_summary(spark, plan: FeaturePlan) -> DataFrame:
    """PIP-2: one-row training summary."""
    return spark.createDataFrame(
        [(plan.target, plan.task, len(plan.inputs), len(plan.features), json.dumps(plan.inputs),
          json.dumps(plan.dropped), plan.duplicates_dropped, plan.null_target_rows, plan.pca is not None)],
        "target string, task string, n_inputs int, n_features int, inputs string, dropped string, "
        "duplicates_dropped bigint, null_target_rows bigint, projected boolean")


__all__ = ["FeaturePlan", "fit_plan", "plan_summary"]
