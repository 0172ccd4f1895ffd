"""Decisions about images, and logs of them, as expressions over what was measured in the images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATURATION, MIN_FACE = 0.03, 256


def is_grayscale(channels: Column, mean_saturation: Column, threshold: float = SATURATION) -> Column:
    """One channel, or a mean HSV saturation (0 to 255) below a share of 255."""
    return (channels == 1) | (mean_saturation / 255.0 < threshold)


def face_short_side(points: Column) -> Column:
    """The shorter side of the points' bounding box, truncated."""
    side = lambda a: F.array_max(F.transform(points, lambda p: p[a])) - F.array_min(F.transform(points, lambda p: p[a]))
    return F.least(side("x"), side("y")).cast("int")


def crop_box(points: Column, margin: float) -> Column:
    """struct<x0, y0, side>: the square around the points with a margin on each side; halves are rounded to even."""
    low, high = (lambda a: F.array_min(F.transform(points, lambda p: p[a]))), (lambda a: F.array_max(F.transform(points, lambda p: p[a])))
    exact = F.greatest(high("x") - low("x"), high("y") - low("y")) * (1.0 + 2.0 * margin)
    side = F.greatest(F.rint(exact).cast("int"), F.lit(1))
    corner = lambda a: F.rint((low(a) + high(a)) / 2.0 - side / 2.0).cast("int")
    return F.struct(corner("x").alias("x0"), corner("y").alias("y0"), side.alias("side"))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def enhance_log(images: DataFrame, colorize: bool = True, restore: bool = True, force_colorize: bool = False, force_restore: bool = False, min_face: int = MIN_FACE, saturation: float = SATURATION) -> DataFrame:
    """(cohort, image, grayscale, face_px, colorized, restored, status) from (cohort, image, readable, channels, mean_saturation, face_px)."""
    ok = F.coalesce(F.col("readable"), F.lit(False))
    gray = is_grayscale(F.col("channels"), F.col("mean_saturation"), saturation)
    face = F.when(F.lit(restore), F.col("face_px"))
    color = F.lit(colorize) & (gray | F.lit(force_colorize))
    fix = F.lit(restore) & (F.lit(force_restore) | F.coalesce(face < min_face, F.lit(False)))
    return images.select(
        "cohort", "image", F.when(ok, gray).alias("grayscale"), F.when(ok, face).alias("face_px"), (ok & F.coalesce(color, F.lit(False))).alias("colorized"),
        (ok & fix).alias("restored"), F.when(ok, "ok").otherwise("unreadable").alias("status"),
    )


def pack_log(images: DataFrame) -> DataFrame:
    """(cohort, image, status) from (cohort, image, readable, faces)."""
    status = F.when(~F.coalesce(F.col("readable"), F.lit(False)), "unreadable").when(F.coalesce(F.col("faces"), F.lit(0)) < 1, "no_face").otherwise("ok")
    return images.select("cohort", "image", status.alias("status"))


def log_summary(log: DataFrame) -> DataFrame:
    """(cohort, total, ok, and counts of colorized and restored where there are such columns)."""
    extra = [F.count_if(F.col(c)).alias(c) for c in ("colorized", "restored") if c in log.columns]
    return log.groupBy("cohort").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), *extra)
