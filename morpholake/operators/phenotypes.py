"""From landmark records to the wide table of measurements."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.operators.features import FEATURES, families, with_features
from morpholake.operators.plugins import Registry, with_plugins
from morpholake.operators.pose import canonical, pixels, point_columns, with_pose, with_rotation, with_scales
from morpholake.schema import LEADING, POINTS

#: Points that any measurement uses.
USED = sorted({int(i) for f in families().values() for e in f.measured.values() for i in re.findall(r"\b[xy](\d+)\b", e)})


def extract_features(records: DataFrame, depth: Sequence[float] | None = None, frontal_check: bool = False, features: Iterable[str] | None = None, plugins: Registry | None = None) -> DataFrame:
    """The leading columns, the measurements (those in features, all by default) and the plugins' columns of each landmark record.

    depth: the canonical depth of each point; without it, rotation is not undone (roll is). frontal_check: rows that are
    known not to be frontal get no measurements and no derotated; a record without a matrix is then an error. A record
    of fewer than 478 points, or of points without two coordinates, is an error. Everything is a narrow projection.
    """
    enough = (F.size("landmarks_3d") >= POINTS) & F.forall("landmarks_3d", lambda p: F.size(p) >= 2)
    checked = records.withColumn("landmarks_3d", F.when(enough, F.col("landmarks_3d")).otherwise(F.raise_error(F.lit(f"a record needs {POINTS} points of two coordinates")).cast("array<array<double>>")))
    if frontal_check:
        checked = checked.withColumn("transformation_matrix", F.coalesce("transformation_matrix", F.raise_error(F.lit("frontal_check needs a transformation matrix in every record")).cast("array<array<double>>")))
    posed = with_pose(checked).withColumn("points", F.slice(pixels(), 1, POINTS))
    posed = with_rotation(posed) if depth is not None else posed.withColumn("rotation", F.lit(None).cast("struct<a:double,b:double,c:double,d:double,e:double,f:double>"))
    scaled = with_scales(canonical(posed, depth))
    own = plugins.freeze() if plugins else []
    flat = point_columns(with_plugins(scaled, plugins) if own else scaled, USED)
    skip = "frontal_ok = false" if frontal_check else None
    names = FEATURES if features is None else [f for f in FEATURES if f in set(features)]
    out = with_features(flat, names, skip)
    derotated = F.when(~F.coalesce(F.expr(skip), F.lit(False)), F.col("derotated")) if skip else F.col("derotated")
    return out.select(*[derotated.alias(c) if c == "derotated" else F.coalesce("disease", F.lit("")).alias(c) if c == "disease" else F.col(c) for c in LEADING], *names, *[F.when(~F.coalesce(F.expr(skip), F.lit(False)), F.col(c)).alias(c) if skip else F.col(c) for c in own])


def assert_single_definition(df: DataFrame) -> DataFrame:
    """df, or an error if it mixes rows with and without de-rotation."""
    if df.where("derotated is not null").select("derotated").distinct().count() > 1:
        raise ValueError("rows with and without de-rotation must not be pooled")
    return df
