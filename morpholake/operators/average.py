"""Average faces: boundary points, mean and weighted landmarks, and where an aligned face goes. Pixels are not touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounding_rect(points: Column) -> Column:
    """struct<x, y, w, h> of integer points; both ends count."""
    low = lambda a: F.array_min(F.transform(points, lambda p: p[a])).cast("int")
    high = lambda a: F.array_max(F.transform(points, lambda p: p[a])).cast("int")
    return F.struct(low("x").alias("x"), low("y").alias("y"), (high("x") - low("x") + 1).alias("w"), (high("y") - low("y") + 1).alias("h"))


def boundary_points(points: Column, inset: float = 0.1) -> Column:
    """Two points at the upper corners of the bounding rectangle, a tenth inside."""
    r = bounding_rect(points)
    dx, dy = (r["w"] * inset).cast("int"), (r["h"] * inset).cast("int")
    at = lambda x: F.struct(x.cast("double").alias("x"), (r["y"] + dy).cast("double").alias("y"))
    return F.array(at(r["x"] + dx), at(r["x"] + r["w"] - dx))


def with_boundary(df: DataFrame) -> DataFrame:
    """points with their boundary points behind them."""
    return df.withColumn("points", F.concat("points", boundary_points(F.col("points"))))


def average_points(df: DataFrame, keys: tuple[str, ...] = ("disease",)) -> DataFrame:
    """(keys, point, x, y): the mean position of each point, truncated; partial sums before the shuffle."""
    # Outer: an inner explode has Catalyst filter on the array, which repeats its expression below every projection.
    rows = df.select(*keys, F.posexplode_outer("points").alias("point", "p")).where("point is not null")
    return rows.groupBy(*keys, "point").agg(F.avg("p.x").cast("int").alias("x"), F.avg("p.y").cast("int").alias("y"))


def weighted_points(start: Column, end: Column, percent: float = 0.5) -> Column:
    """percent of start and the rest of end, truncated; all of one of them outside 0 to 1."""
    if percent <= 0:
        return end
    if percent >= 1:
        return start
    mixed = lambda p, q, a: (p[a] * percent + q[a] * (1 - percent)).cast("int").cast("double").alias(a)
    return F.zip_with(start, end, lambda p, q: F.struct(mixed(p, q, "x"), mixed(p, q, "y")))


def aligned(points: Column, width: int, height: int, share: float = 0.8) -> Column:
    """struct<scale, dx, dy>: scaled so that the bounding rectangle fills share of the frame, and centred there."""
    r = bounding_rect(points)
    scale = F.least(share * width / r["w"], share * height / r["h"])
    return F.struct(scale.alias("scale"), (width / 2.0 - scale * (r["x"] + r["w"] / 2.0)).alias("dx"), (height / 2.0 - scale * (r["y"] + r["h"] / 2.0)).alias("dy"))
