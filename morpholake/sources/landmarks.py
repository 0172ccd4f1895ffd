"""Landmark records from JSON Lines, with what is wrong with the rejected ones; images and cohorts from folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morpholake.schema import LANDMARKS

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
_RAW = T.StructType([*LANDMARKS.fields, T.StructField("_corrupt_record", T.StringType())])


def with_reason(raw: DataFrame) -> DataFrame:
    """Adds reason: NULL for a usable record, else the first thing that is wrong with it."""
    points, size = F.col("landmarks_3d"), F.col("image_size")
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "not JSON of the right types")
        .when(F.col("image_id").isNull(), "no image_id")
        .when(points.isNull() | F.exists(points, lambda p: p.isNull()) | F.exists(points, lambda p: F.exists(p, lambda v: v.isNull())), "no landmarks")
        .when(~F.forall(points, lambda p: F.size(p) == F.size(points[0])), "ragged landmarks")
        .when(size.isNull() | (F.size(size) != 2) | F.exists(size, lambda v: v.isNull()), "image_size is not two numbers")
    )
    return raw.withColumn("reason", reason)


def split_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of rows with _corrupt_record; a record without a disease has an empty one."""
    checked = with_reason(raw)
    good = checked.where("reason is null").select(*[F.coalesce("disease", F.lit("")).alias("disease") if c == "disease" else F.col(c) for c in LANDMARKS.fieldNames()])
    return good, checked.where("reason is not null").select("image_id", "reason", "_corrupt_record")


def read_landmarks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON Lines; blank lines are no records at all."""
    return split_records(spark.read.schema(_RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def parse_landmarks(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The same from a column of JSON texts."""
    parsed = F.from_json(F.col(column), _RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return split_records(lines.where(F.trim(column) != "").select(parsed.alias("r")).select("r.*"))


def has_any_matrix(records: DataFrame) -> bool:
    """Whether any record has a transformation matrix; stops at the first."""
    return not records.where("transformation_matrix is not null").limit(1).isEmpty()


def cohorts(records: DataFrame) -> DataFrame:
    """The distinct cohorts that are not empty, in order."""
    return records.select("disease").where("disease <> ''").distinct().orderBy("disease")


def read_images(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, content: bool = True) -> DataFrame:
    """(cohort, image_id, path[, content]) of a folder: its subfolders are cohorts, or it is one. Images beside subfolders of images are an error."""
    pattern = "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/")
    inside = F.substring_index(F.col("path"), root.rsplit(":", 1)[-1] + "/", -1)
    depth = F.size(F.split(inside, "/"))
    found = files.select("path", *(["content"] if content else []), inside.alias("inside"), depth.alias("depth"))
    depths = [r[0] for r in found.select("depth").where("depth <= 2").distinct().collect()]
    if len(depths) > 1:
        raise ValueError(f"{path} has images beside folders of images")
    cohort = F.when(F.col("depth") >= 2, F.element_at(F.split("inside", "/"), 1)).otherwise(F.lit(root.rsplit("/", 1)[-1]))
    return found.select(cohort.alias("cohort"), stem(F.col("path")).alias("image_id"), "path", *(["content"] if content else []))


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def write_landmarks(records: DataFrame, path: str) -> None:
    """Records as JSON Lines."""
    records.select(*LANDMARKS.fieldNames()).write.json(path)


def rich_records(records: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One nested record for each image: integer pixels (truncated), relative points, and scores by name."""
    w, h = F.col("image_size")[0], F.col("image_size")[1]
    flat = F.transform("landmarks_3d", lambda p: F.array((p[0] * w).cast("int"), (p[1] * h).cast("int")))
    scores = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("blendshapes")) if names else F.lit(None).cast("map<string,double>")
    face = F.struct(flat.alias("landmarks_2d"), F.col("landmarks_3d"), scores.alias("blendshapes"), F.col("transformation_matrix"))
    return records.select(F.struct(F.col("image_id").alias("filename"), w.cast("int").alias("width"), h.cast("int").alias("height")).alias("image"), F.lit(1).alias("num_faces"), F.array(face).alias("faces"))
