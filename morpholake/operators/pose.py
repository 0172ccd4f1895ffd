"""Pose angles, the frontal gate, and canonical landmarks.

Angles come from the raw 3x3 block of the transformation matrix, the de-rotation from its nearest pure rotation. That
needs an SVD, the one step that leaves the JVM: nine numbers for each row go out, six come back, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

YAW, PITCH, ROLL = 15.0, 15.0, 10.0
#: Landmarks of the frame: cheekbones, inner eye corners, and those of the scales.
ZYGOMA, INNER = (234, 454), (133, 362)
TRICHION, MENTON, NASION, SUBNASALE, COMMISSURES = 10, 152, 168, 2, (61, 291)


def _entry(row: int, col: int, matrix: str = "transformation_matrix") -> Column:
    return F.col(matrix)[row][col]


def with_pose(df: DataFrame) -> DataFrame:
    """Adds pose_yaw, pose_pitch, pose_roll (degrees) and frontal_ok; all NULL without a transformation matrix."""
    lean = F.sqrt(_entry(0, 0) * _entry(0, 0) + _entry(1, 0) * _entry(1, 0))
    regular = lean > 1e-6
    yaw = F.degrees(F.atan2(-_entry(2, 0), lean))
    pitch = F.degrees(F.when(regular, F.atan2(_entry(2, 1), _entry(2, 2))).otherwise(F.atan2(-_entry(1, 2), _entry(1, 1))))
    roll = F.degrees(F.when(regular, F.atan2(_entry(1, 0), _entry(0, 0))).otherwise(F.lit(0.0)))
    known = F.col("transformation_matrix").isNotNull()
    out = df.withColumns({"pose_yaw": F.when(known, yaw), "pose_pitch": F.when(known, pitch), "pose_roll": F.when(known, roll)})
    return out.withColumn("frontal_ok", frontal("pose_yaw", "pose_pitch", "pose_roll"))


def frontal(yaw: str, pitch: str, roll: str) -> Column:
    """Whether all angles are within their limits (inclusive); NULL if they are."""
    return (F.abs(yaw) <= YAW) & (F.abs(pitch) <= PITCH) & (F.abs(roll) <= ROLL)


_ROTATION = T.StructType([T.StructField(c, T.DoubleType()) for c in "abcdef"])


@F.pandas_udf(_ROTATION)
def nearest_rotation(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """First two rows of the rotation nearest to each 3x3 matrix, given as nine numbers; NULL for NULL."""
    for column in parts:
        out = np.full((len(column), 6), np.nan)
        have = np.flatnonzero(column.notna().to_numpy())
        if len(have):
            u, _, v = np.linalg.svd(np.stack([np.asarray(x, dtype=np.float64) for x in column.iloc[have]]).reshape(-1, 3, 3))
            turned = np.linalg.det(u @ v) < 0
            u[turned, :, -1] *= -1
            out[have] = (u @ v)[:, :2].reshape(-1, 6)
        yield pd.DataFrame(out, columns=list("abcdef"))


def with_rotation(df: DataFrame) -> DataFrame:
    """Adds rotation, the first two rows of the nearest pure rotation; NULL without a matrix."""
    flat = F.when(F.col("transformation_matrix").isNotNull(), F.array(*[_entry(i, j) for i in range(3) for j in range(3)]))
    return df.withColumn("_flat", flat).withColumn("_near", nearest_rotation("_flat")).withColumn("rotation", F.when(F.col("_flat").isNotNull(), F.col("_near"))).drop("_flat", "_near")


def pixels() -> Column:
    """Landmarks as (x, y) structs in pixels; depth is dropped."""
    return F.transform("landmarks_3d", lambda p: F.struct((p[0] * F.col("image_size")[0]).alias("x"), (p[1] * F.col("image_size")[1]).alias("y")))


def canonical(df: DataFrame, depth: Sequence[float] | None) -> DataFrame:
    """Adds canon (points in the frontal plane, origin between the inner eye corners) and derotated.

    df has points (array of x, y) and rotation. depth: a depth for each point in cheekbone widths. With a rotation whose
    upper left block can be inverted, yaw, pitch and roll are undone by those fixed depths; otherwise roll alone, from
    the line between the inner eye corners. Points need not be centred first: the origin is moved at the end.
    To list canon's points use explode_outer: for explode, Spark infers a filter on canon and computes it twice.
    """
    r = lambda name: F.col("rotation")[name]
    p = lambda i, axis: F.col("points")[i][axis]
    det = r("a") * r("e") - r("b") * r("d")
    turns = F.coalesce(F.abs(det) > 1e-6, F.lit(False)) if depth is not None else F.lit(False)
    df = df.withColumns({
        "_turns": turns, "_det": det,
        "_w": F.sqrt(F.pow(p(ZYGOMA[0], "x") - p(ZYGOMA[1], "x"), 2) + F.pow(p(ZYGOMA[0], "y") - p(ZYGOMA[1], "y"), 2)),
        "_t": F.atan2(p(INNER[1], "y") - p(INNER[0], "y"), p(INNER[1], "x") - p(INNER[0], "x")),
        "_ox": (p(INNER[0], "x") + p(INNER[1], "x")) / 2.0, "_oy": (p(INNER[0], "y") + p(INNER[1], "y")) / 2.0,
    })
    df = df.withColumns({"_c": F.cos(-F.col("_t")), "_s": F.sin(-F.col("_t"))})
    c = F.col
    flat = F.transform("points", lambda q: F.struct(
        (c("_c") * (q["x"] - c("_ox")) - c("_s") * (q["y"] - c("_oy"))).alias("x"),
        (c("_s") * (q["x"] - c("_ox")) + c("_c") * (q["y"] - c("_oy"))).alias("y"),
    ))
    if depth is not None:
        deep = F.expr(f"array({', '.join(f'CAST({float(z)!r} AS DOUBLE)' for z in depth)})")

        def straight(q: Column, z: Column) -> Column:
            x = q["x"] - z * c("_w") * r("c")
            y = q["y"] - z * c("_w") * r("f")
            return F.struct(((r("e") * x - r("b") * y) / c("_det")).alias("x"), ((r("a") * y - r("d") * x) / c("_det")).alias("y"))

        df = df.withColumn("_straight", F.when(c("_turns"), F.zip_with("points", deep, straight)))
        middle = lambda axis: (c("_straight")[INNER[0]][axis] + c("_straight")[INNER[1]][axis]) / 2.0
        df = df.withColumns({"_sx": middle("x"), "_sy": middle("y")})
        turned = F.transform("_straight", lambda q: F.struct((q["x"] - c("_sx")).alias("x"), (q["y"] - c("_sy")).alias("y")))
        flat = F.when(c("_turns"), turned).otherwise(flat)
    out = df.withColumn("canon", flat).withColumn("derotated", c("_turns"))
    return out.drop(*[name for name in out.columns if name.startswith("_")])


def with_scales(df: DataFrame) -> DataFrame:
    """Adds bizyg, face_h, midface_h and mouth_w, from canon."""
    p = lambda i, axis: F.col("canon")[i][axis]
    far = lambda a, b: F.sqrt((p(a, "x") - p(b, "x")) * (p(a, "x") - p(b, "x")) + (p(a, "y") - p(b, "y")) * (p(a, "y") - p(b, "y")))
    return df.withColumns({
        "bizyg": far(*ZYGOMA), "face_h": F.abs(p(TRICHION, "y") - p(MENTON, "y")),
        "midface_h": F.abs(p(NASION, "y") - p(SUBNASALE, "y")), "mouth_w": far(*COMMISSURES),
    })


def point_columns(df: DataFrame, used: Sequence[int]) -> DataFrame:
    """canon as columns x0, y0, .. for the points used."""
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c != "canon"], *[f"canon[{i}].{a} AS {a}{i}" for i in used for a in "xy"])
