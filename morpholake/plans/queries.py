"""The library's own queries, each on its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morpholake.operators import average, decisions, extraction, ontology, phenotypes, pose, privacy, reference, selection
from morpholake.operators.features import families, with_features
from morpholake.operators.plugins import Registry
from morpholake.plans import fixtures
from morpholake.plans import oracles as o
from morpholake.plans.oracles import ORACLE_SQL as ORACLE_SQL
from morpholake.sources import landmarks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + F.lit(0) for n in names})


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.drop_no_face(fixtures.embeddings(spark, sf_dir))


def _split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    faces = _faces(spark, sf_dir)
    return tuple(privacy.nearest_distance(_split(faces, s), _split(faces, "train")) for s in ("synthetic", "heldout"))


@_query
def flagging_table(spark, sf_dir):
    return _round(privacy.flagging(*_near(spark, sf_dir)), "threshold")


@_query
def nearest_train_distance(spark, sf_dir):
    synthetic, heldout = _near(spark, sf_dir)
    both = synthetic.withColumn("split", F.lit("synthetic")).unionAll(heldout.withColumn("split", F.lit("heldout")))
    return _round(both, "dist")


@_query
def heldout_thresholds(spark, sf_dir):
    return flagging_table(spark, sf_dir).select("percentile", "threshold")


@_query
def no_face_counts(spark, sf_dir):
    return privacy.no_face_counts(fixtures.embeddings(spark, sf_dir))


@_query
def embedding_norms(spark, sf_dir):
    return _round(privacy.prepared(fixtures.embeddings(spark, sf_dir)).select("id", "norm"), "norm")


@_query
def cohort_coverage(spark, sf_dir):
    return privacy.cohort_coverage(fixtures.embeddings(spark, sf_dir))


@_query
def aa_point_train_syn(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    return _round(privacy.adversarial_accuracy(_split(faces, "train"), _split(faces, "synthetic")), "aa")


@_query
def aa_point_heldout_syn(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    return _round(privacy.adversarial_accuracy(_split(faces, "heldout"), _split(faces, "synthetic")), "aa")


@_query
def privacy_loss_point(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    found = privacy.privacy_loss(*[_split(faces, s) for s in ("train", "heldout", "synthetic")])
    return _round(found, "aa_train_synth", "aa_heldout_synth", "privacy_loss")


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", side.alias("side"), F.col("l_tax").alias("cross"), F.col("l_discount").alias("within"))


@_query
def aa_from_min_dists(spark, sf_dir):
    return _round(privacy.aa_from_min_distances(_distances(spark, sf_dir)), "aa")


@_query
def bootstrap_summary(spark, sf_dir):
    rows = _distances(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    u = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("draw") * 1299709 + F.col("l_orderkey") * F.col("draw") * 613) % 10007 / F.lit(10007.0)
    return _round(privacy.summary(privacy.resampled(rows, u)), "mean", "median", "std", "ci_lower", "ci_upper")


@_query
def bootstrap_rows(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    return privacy.summary(privacy.bootstrap_rows(_split(faces, "train"), _split(faces, "synthetic"), draws=1000))


@_query
def nnaa_table(spark, sf_dir):
    return privacy.run_audit(fixtures.embeddings(spark, sf_dir), draws=1000)["nnaa"]


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose.with_pose(fixtures.landmarks(spark, sf_dir))


@_query
def pose_angles(spark, sf_dir):
    return _round(_posed(spark, sf_dir).select("vec_id", "pose_yaw", "pose_pitch", "pose_roll"), "pose_yaw", "pose_pitch", "pose_roll")


@_query
def frontal_gate(spark, sf_dir):
    return _posed(spark, sf_dir).select("vec_id", "frontal_ok")


@_query
def frontal_counts_by_cohort(spark, sf_dir):
    ok = F.col("frontal_ok")
    return _posed(spark, sf_dir).groupBy("disease").agg(F.count_if(ok).alias("frontal"), F.count_if(~ok).alias("turned"), F.count_if(ok.isNull()).alias("unknown"))


def _canonical(spark: SparkSession, sf_dir: str, turned: bool) -> DataFrame:
    df = fixtures.landmarks(spark, sf_dir).withColumn("points", landmarks_pixels())
    df = pose.with_rotation(df) if turned else df.withColumn("rotation", F.lit(None).cast("struct<a:double,b:double,c:double,d:double,e:double,f:double>"))
    return pose.canonical(df, fixtures.DEPTH if turned else None)


def landmarks_pixels() -> Column:
    return pose.pixels()


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode_outer("canon").alias("point", "p"))
    return _round(rows.select(*keys, "point", "p.x", "p.y"), "x", "y")


@_query
def canonical_points_rollonly(spark, sf_dir):
    return _shown(_canonical(spark, sf_dir, False), "vec_id")


@_query
def canonical_points_derotated(spark, sf_dir):
    return _shown(_canonical(spark, sf_dir, True), "vec_id", "derotated")


_SCALES = ("bizyg", "face_h", "midface_h", "mouth_w")


@_query
def landmark_scales(spark, sf_dir):
    return _round(pose.with_scales(_canonical(spark, sf_dir, False)).select("vec_id", *_SCALES), *_SCALES)


@_query
def face_short_side(spark, sf_dir):
    points = fixtures.landmarks(spark, sf_dir).withColumn("points", pose.pixels())
    return points.select("vec_id", decisions.face_short_side(F.col("points")).alias("face_px"))


@_query
def crop_box(spark, sf_dir):
    points = fixtures.landmarks(spark, sf_dir).withColumn("points", pose.pixels())
    return points.select("vec_id", decisions.crop_box(F.col("points"), 0.3).alias("b")).select("vec_id", "b.*")


@_query
def average_landmarks(spark, sf_dir):
    return average.average_points(fixtures.landmarks(spark, sf_dir).withColumn("points", pose.pixels()))


def _family(name: str) -> Query:
    names = families()[name].order

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = pose.point_columns(pose.with_scales(_canonical(spark, sf_dir, False)).select("vec_id", "canon", *_SCALES), phenotypes.USED)
        return _round(with_features(flat, names).select("vec_id", *names), *names)

    return run


QUERIES |= {f"feat_{name}": _family(name) for name in families()}


@_query
def features_all_120(spark, sf_dir):
    records = fixtures.landmarks(spark, sf_dir)
    found = phenotypes.extract_features(records, fixtures.DEPTH)
    names = phenotypes.FEATURES
    return _round(found.select(F.substr("image_id", F.lit(5)).cast("bigint").alias("vec_id"), *names), *names)


_SHOWN = ("eye_area_mean", "eye_fissure_length_r", "mouth_width", "chin_width", "face_span")


def _span_plugin() -> Registry:
    plugins = Registry(groups=["eyes"])
    plugins.register(group="span", columns=["face_span"], native=True)(lambda p, scales: {"face_span": (p(454, "x") - p(234, "x")) / scales["bizyg"]})
    return plugins


def _custom(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even cohorts keep the group of the eyes, odd ones a column; every third also a plugin's."""
    records = fixtures.landmarks(spark, sf_dir)
    cohorts = records.select(F.col("disease").alias("cohort")).where("cohort <> ''").distinct()
    number = F.col("cohort").cast("bigint")
    first = F.when(number % 2 == 0, F.struct(F.lit("feature_groups").alias("kind"), F.lit("eyes").alias("item"))).otherwise(F.struct(F.lit("extra_columns").alias("kind"), F.lit("chin_width").alias("item")))
    third = F.when(number % 3 == 0, F.struct(F.lit("custom_features").alias("kind"), F.lit("span").alias("item")))
    mapping = cohorts.select("cohort", F.explode(F.array_compact(F.array(first, third))).alias("x")).select("cohort", "x.*")
    return extraction.extract_custom(records, mapping, _groups(spark), _span_plugin(), fixtures.DEPTH)


@_query
def custom_extraction(spark, sf_dir):
    table, _ = _custom(spark, sf_dir)
    return _round(table.select(F.substr("image_id", F.lit(5)).cast("bigint").alias("vec_id"), "disease", *_SHOWN), *_SHOWN)


@_query
def custom_extraction_report(spark, sf_dir):
    return _custom(spark, sf_dir)[1]


def _disease(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cohorts are spellings of two names of the ontology; the mapping's keys are other spellings of both."""
    spelt = F.when(F.col("vec_id") % 2 == 0, "Noonan syndrome 1").otherwise("MARFAN")
    mapping = spark.createDataFrame([("marfan syndrome", "eyes"), ("noonan  syndrome type 2", "lips")], "json_key string, item string")
    return extraction.extract_for_diseases(fixtures.landmarks(spark, sf_dir).withColumn("disease", spelt), mapping, _groups(spark), *_ontology(spark), fixtures.DEPTH)


@_query
def disease_extraction(spark, sf_dir):
    table, _ = _disease(spark, sf_dir)
    shown = _SHOWN[:-1]
    return _round(table.select(F.substr("image_id", F.lit(5)).cast("bigint").alias("vec_id"), "disease", *shown), *shown)


@_query
def disease_extraction_report(spark, sf_dir):
    return _disease(spark, sf_dir)[1]


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.build_reference(fixtures.phenotypes(spark, sf_dir))


_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@_query
def reference_from_controls(spark, sf_dir):
    return _round(_reference(spark, sf_dir), "mean", "sd")


@_query
def zscore_wide(spark, sf_dir):
    return _round(reference.zscore(fixtures.phenotypes(spark, sf_dir), _reference(spark, sf_dir)), *_FOUR)


@_query
def zscore_long(spark, sf_dir):
    wide = fixtures.phenotypes(spark, sf_dir).drop("frontal_ok")
    return _round(reference.zscore_long(wide, _reference(spark, sf_dir), ["disease", "image_id"]), "z")


@_query
def zscore_missing_reference(spark, sf_dir):
    partial = _reference(spark, sf_dir).where("feature <> 'l_tax'").withColumn("sd", F.when(F.col("feature") == "l_discount", 0.0).otherwise(F.col("sd")))
    return _round(reference.zscore(fixtures.phenotypes(spark, sf_dir), partial), *_FOUR)


def _columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in [*o.COLUMNS, *_FOUR]], "csv_column string")


def _groups(spark: SparkSession) -> DataFrame:
    return tables.clean_groups(spark.createDataFrame(o.GROUPS, "feature_group string, csv_column string"))


def _selected(spark: SparkSession) -> DataFrame:
    return selection.selected_columns(spark.createDataFrame(o.MAPPING, "cohort string, kind string, item string"), _groups(spark), _columns(spark))


@_query
def suffix_stems(spark, sf_dir):
    return _columns(spark).select("csv_column", selection.strip_suffix(F.col("csv_column")).alias("stem"))


@_query
def column_families(spark, sf_dir):
    return selection.families(_columns(spark)).withColumn("family", F.array_join("family", ";"))


@_query
def group_to_columns(spark, sf_dir):
    return selection.group_columns(_groups(spark), _columns(spark))


@_query
def selected_columns_by_cohort(spark, sf_dir):
    return _selected(spark)


@_query
def selection_report(spark, sf_dir):
    return selection.selection_report(_selected(spark))


@_query
def masked_phenotypes(spark, sf_dir):
    return selection.mask(fixtures.phenotypes(spark, sf_dir), _selected(spark))


def _ontology(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.createDataFrame(rows, kind) for rows, kind in ((o.TERMS, ontology.TERM), (o.SYNONYMS, ontology.SYNONYM), (o.XREFS, ontology.XREF)))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(n,) for n in o.NAMES], "name string")
    return own.union(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name")).distinct()


@_query
def fuzzy_variants(spark, sf_dir):
    return _names(spark, sf_dir).select(F.col("name").alias("query_name"), F.array_join(ontology.fuzzy_variants(F.col("name")), "|").alias("variants"))


@_query
def resolve_ladder(spark, sf_dir):
    return ontology.resolve(_names(spark, sf_dir), *_ontology(spark))


@_query
def suggest_neighbours(spark, sf_dir):
    names, found = _names(spark, sf_dir), resolve_ladder(spark, sf_dir)
    return ontology.suggest(names.join(found, F.col("name") == F.col("query_name"), "left_anti"), _ontology(spark)[0])


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cache = spark.createDataFrame(o.CACHE, ", ".join(f"{c} string" for c in ontology.CACHE.fieldNames()))
    return ontology.resolve_with_cache(_names(spark, sf_dir), cache, *_ontology(spark))


@_query
def cache_upsert(spark, sf_dir):
    return _cached(spark, sf_dir)[2]


@_query
def resolve_with_cache(spark, sf_dir):
    return _cached(spark, sf_dir)[0]


@_query
def mapping_join_failures(spark, sf_dir):
    cohorts = _names(spark, sf_dir).withColumnRenamed("name", "cohort")
    keys = spark.createDataFrame([("MARFAN",), ("Large bolt",), ("widget 4",), ("Marfan syndrome",)], "json_key string")
    return selection.cohorts_to_keys(cohorts, keys, resolve_ladder(spark, sf_dir))[1]


@_query
def parse_props(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@_query
def jsonl_validation_report(spark, sf_dir):
    """Records made from events, four of five broken in one way or another, read as JSON Lines."""
    points, ragged = '[[0.1, 0.2, 0.3], [0.4, 0.5, 0.6]]', '[[0.1, 0.2, 0.3], [0.4]]'
    whole = lambda extra, pts, size: F.concat(F.lit("{" + extra + '"landmarks_3d": ' + pts + ', "image_size": ' + size + ', "k": '), F.col("props"), F.lit("}"))
    line = (
        F.when(F.col("event_id") % 5 == 0, whole('"image_id": "a", ', points, "[10, 20]")).when(F.col("event_id") % 5 == 1, whole("", points, "[10, 20]"))
        .when(F.col("event_id") % 5 == 2, whole('"image_id": "a", ', ragged, "[10, 20]")).when(F.col("event_id") % 5 == 3, whole('"image_id": "a", ', points, "[10, 20, 30]"))
        .otherwise(F.concat(F.lit("{"), F.col("props")))
    )
    good, bad = landmarks.parse_landmarks(spark.read.parquet(f"{sf_dir}/events.parquet").select(line.alias("value")))
    return good.select(F.lit("ok").alias("reason")).unionAll(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("cohort"), F.concat(F.lit("image"), key).alias("image"), (F.col("p_size") != 13).alias("readable"),
        F.when(F.col("p_size") % 7 == 0, 1).otherwise(3).alias("channels"), (key % 50).cast("double").alias("mean_saturation"),
        F.when(key % 11 != 0, (key * 37 % 600).cast("int")).alias("face_px"), (key % 3).alias("faces"),
    )


@_query
def enhance_decisions(spark, sf_dir):
    return decisions.enhance_log(_images(spark, sf_dir))


@_query
def pack_log_summary(spark, sf_dir):
    return decisions.log_summary(decisions.pack_log(_images(spark, sf_dir)))


@_query
def seed_ranges(spark, sf_dir):
    key = F.col("n_nationkey")
    spec = F.concat_ws(", ", key, F.concat_ws("-", key + 10, key + 12))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(tables.seeds(spec)).alias("seed"))
