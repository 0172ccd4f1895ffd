"""A normative reference, and z-scores against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morpholake.schema import LEADING


def feature_columns(df: DataFrame, leading: Sequence[str] = tuple(LEADING)) -> list[str]:
    """df's numeric columns that are not leading ones."""
    return [f.name for f in df.schema if f.name not in leading and isinstance(f.dataType, T.NumericType)]


def build_reference(controls: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, mean, sd, n) over frontal rows: mean, sample standard deviation and count of what is neither NULL nor NaN. One pass, one small shuffle."""
    features = list(features or feature_columns(controls))
    if not features:
        raise ValueError("no feature columns")
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    sums = controls.where("frontal_ok").agg(*[f(value(c)).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"), F.col(f"n{i}").alias("n")) for i, c in enumerate(features)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def load_reference(df: DataFrame) -> DataFrame:
    """A reference table as it is, or one built from a table of controls; anything else is an error."""
    if {"feature", "mean", "sd"} <= set(df.columns):
        if "n" not in df.columns:
            raise ValueError("a reference table needs the columns feature, mean, sd and n")
        return df.select("feature", F.col("mean").cast("double"), F.col("sd").cast("double"), F.col("n").cast("bigint"))
    if "frontal_ok" in df.columns:
        return build_reference(df)
    raise ValueError("neither a reference table nor a table of controls")


def zscore(df: DataFrame, reference: DataFrame, leading: Sequence[str] = tuple(LEADING)) -> DataFrame:
    """df with each feature as (value - mean) / sd; NULL without a reference row or with sd <= 0.

    The reference has a row for each column of df, so it is collected (its size is bounded by df's width), and scoring
    is a narrow projection without any join.
    """
    features = feature_columns(df, leading)
    if not features:
        raise ValueError("no feature columns to score")
    known = {r["feature"]: r for r in reference.where(F.col("feature").isin(features)).collect()}

    def score(c: str) -> F.Column:
        r = known.get(c)
        if r is None or r["mean"] is None or r["sd"] is None or not r["sd"] > 0:
            return F.lit(None).cast("double").alias(c)
        return ((F.col(c).cast("double") - F.lit(r["mean"])) / F.lit(r["sd"])).alias(c)

    return df.select(*[c for c in leading if c in df.columns], *[score(c) for c in features])


def zscore_long(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value, z) rows, by a join with the reference on the feature's name."""
    features = feature_columns(df, keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(keys), features, "feature", "value")
    small = F.broadcast(reference.where(F.col("feature").isin(features)).select("feature", "mean", "sd"))  # at most a row for each column of df
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))
    return long.join(small, "feature", "left").select(*keys, "feature", "value", z.alias("z"))
