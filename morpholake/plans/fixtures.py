"""Inputs for the queries, derived from the driver's tables by integer arithmetic that Spark and DuckDB do alike."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morpholake.operators.features import BROW_LOWER, BROW_UPPER, EYE_RING, OVAL
from morpholake.schema import POINTS

#: Points at the right of a schematic face of 1000 x 1000 pixels, and their mirrored partners.
_RIGHT = {
    (468, 473): (418, 431), (98, 327): (455, 580), (49, 279): (448, 560), (196, 419): (485, 490), (45, 275): (480, 565),
    (61, 291): (430, 672), (185, 409): (440, 665), (40, 270): (452, 657), (39, 269): (466, 651), (37, 267): (480, 647),
    (191, 415): (442, 670), (80, 310): (455, 669), (81, 311): (468, 668), (82, 312): (484, 667),
    (146, 375): (442, 684), (91, 321): (455, 694), (181, 405): (468, 700), (84, 314): (484, 704),
    (95, 324): (442, 675), (88, 318): (455, 676), (178, 402): (468, 677), (87, 317): (484, 677),
    (116, 345): (330, 540), (205, 425): (400, 620),
}
_MIDDLE = {168: 430, 1: 560, 2: 590, 0: 650, 13: 668, 14: 676, 17: 705, 18: 725, 9: 250}


def _template() -> tuple[list[int], list[int]]:
    xs, ys = [500] * POINTS, [500] * POINTS

    def put(i: int, x: float, y: float) -> None:
        xs[i], ys[i] = round(x), round(y)

    for k, i in enumerate(OVAL):
        put(i, 500 + 300 * math.sin(2 * math.pi * k / 36), 500 - 400 * math.cos(2 * math.pi * k / 36))
    for k, (r, l) in enumerate(zip(EYE_RING["r"], EYE_RING["l"], strict=True)):
        x, y = 417 - 38 * math.cos(2 * math.pi * k / 16), 431 + 16 * math.sin(2 * math.pi * k / 16)
        put(r, x, y)
        put(l, 1000 - round(x), y)
    for k in range(5):
        for which, y in ((BROW_UPPER, (385, 375, 370, 372, 378)), (BROW_LOWER, (398, 390, 386, 387, 392))):
            put(which["r"][k], 350 + 25 * k, y[k])
            put(which["l"][k], 650 - 25 * k, y[k])
    for (r, l), (x, y) in _RIGHT.items():
        put(r, x, y)
        put(l, 1000 - x, y)
    for i, y in _MIDDLE.items():
        put(i, 500, y)
    return xs, ys


XS, YS = _template()
DEPTH = [((i * 37) % 101) / 101.0 - 0.5 for i in range(POINTS)]


def _turned(yaw: tuple[float, float], pitch: tuple[float, float]) -> list[list[float]]:
    (cy, sy), (cp, sp) = yaw, pitch
    return [[cy, sy * sp, sy * cp, 0.0], [0.0, cp, -sp, 0.0], [-sy, cy * sp, cy * cp, 0.0], [0.0, 0.0, 0.0, 1.0]]


#: Matrix of vec_id % 4: none, identity, a small rotation, and one beyond the frontal gate.
MATRICES = {1: _turned((1.0, 0.0), (1.0, 0.0)), 2: _turned((40 / 41, 9 / 41), (60 / 61, 11 / 61)), 3: _turned((24 / 25, 7 / 25), (40 / 41, 9 / 41))}


def jitter(i: str, v: str, a: int, b: int) -> str:
    """SQL for -10 to 10 pixels, in hundredths."""
    return f"((({i} * {a} + {v} * {b} + {i} * {v} * 613) % 2003) - 1001)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding sets: cohort = label, split by vec_id."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    split = F.element_at(F.array(F.lit("train"), F.lit("heldout"), F.lit("synthetic")), (F.col("vec_id") % 3 + 1).cast("int"))
    return df.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("cohort"), split.alias("split"), "embedding")


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landmark record for each vec_id, with vec_id."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    arr = lambda name, values: F.expr(f"array({', '.join(map(str, values))})").alias(name)
    dx, dy = jitter("CAST(i AS BIGINT)", "vec_id", 7919, 104729), jitter("CAST(i AS BIGINT)", "vec_id", 6101, 15485863)
    point = f"array((tx[i] * 100 + {dx}) / CAST(100000.0 AS DOUBLE), (ty[i] * 100 + {dy}) / CAST(100000.0 AS DOUBLE), CAST(0.25 AS DOUBLE))"
    matrix = F.lit(None).cast("array<array<double>>")
    for k, m in MATRICES.items():
        matrix = F.when(F.col("vec_id") % 4 == k, F.array(*[F.array(*[F.lit(x) for x in row]) for row in m])).otherwise(matrix)
    shaped = df.select("vec_id", "label", arr("tx", XS), arr("ty", YS)).withColumn("landmarks_3d", F.expr(f"transform(sequence(0, {POINTS - 1}), i -> {point})"))
    return shaped.select(
        "vec_id", F.concat(F.lit("face"), F.col("vec_id")).alias("image_id"), F.col("label").cast("string").alias("disease"), "landmarks_3d",
        F.array(F.lit(1000.0), F.lit(1000.0)).alias("image_size"), matrix.alias("transformation_matrix"), F.lit(None).cast("array<double>").alias("blendshapes"),
    )


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of four measurements with two leading columns, from lineitem."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    frontal = F.when(F.col("l_linenumber") != 7, F.col("l_linestatus") == "O")
    return df.select(
        F.col("l_returnflag").alias("disease"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"), frontal.alias("frontal_ok"),
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    )
