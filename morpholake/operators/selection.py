"""From mappings of cohorts to the columns that they keep, masks, and reports. All of it is joins of small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morpholake.schema import LEADING

#: Fixed value: the endings that set members of a family apart.
SUFFIX = "(?:_mean|_asym|_r|_l|_x|_y)$"


def strip_suffix(name: Column) -> Column:
    """name without one trailing side, axis or summary ending."""
    return F.regexp_replace(name, SUFFIX, "")


def families(columns: DataFrame) -> DataFrame:
    """(csv_column, stem, family): each column with the sorted columns that share its stem."""
    stems = columns.select("csv_column", strip_suffix(F.col("csv_column")).alias("stem")).distinct()
    return stems.join(stems.groupBy("stem").agg(F.array_sort(F.collect_set("csv_column")).alias("family")), "stem").select("csv_column", "stem", "family")


def group_columns(groups: DataFrame, columns: DataFrame) -> DataFrame:
    """(feature_group, csv_column): every column of the schema in the family of a column that the group names."""
    named = groups.select("feature_group", strip_suffix(F.col("csv_column")).alias("stem")).distinct()
    known = columns.select("csv_column", strip_suffix(F.col("csv_column")).alias("stem")).distinct()
    return named.join(known, "stem").select("feature_group", "csv_column").distinct()


def selected_columns(mapping: DataFrame, groups: DataFrame | None, columns: DataFrame, plugins: DataFrame | None = None) -> DataFrame:
    """(cohort, csv_column) from (cohort, kind, item) rows; kind: feature_groups, extra_columns or custom_features.

    Unknown groups select nothing. Unknown extra columns or plugins, and groups without a table of groups, are errors.
    plugins: (plugin, csv_column).
    """
    items = lambda kind: mapping.where(F.col("kind") == kind).select("cohort", "item")
    wanted = items("feature_groups")
    if groups is None:
        if not wanted.isEmpty():
            raise ValueError("feature_groups need a table of groups")
        by_group = wanted.withColumnRenamed("item", "csv_column")
    else:
        by_group = wanted.join(group_columns(groups, columns), F.col("item") == F.col("feature_group")).select("cohort", "csv_column")
    extra = items("extra_columns").withColumnRenamed("item", "csv_column")
    if bad := sorted(r[0] for r in extra.join(columns, "csv_column", "left_anti").select("csv_column").distinct().collect()):
        raise ValueError(f"unknown extra_columns: {bad}")
    custom = items("custom_features").withColumnRenamed("item", "plugin")
    if plugins is None:
        plugins = mapping.sparkSession.createDataFrame([], "plugin string, csv_column string")
    if bad := sorted(r[0] for r in custom.join(plugins, "plugin", "left_anti").select("plugin").distinct().collect()):
        raise ValueError(f"custom_features without a plugin: {bad}")
    return by_group.unionAll(extra).unionAll(custom.join(plugins, "plugin").select("cohort", "csv_column")).distinct()


def check_cohorts(df: DataFrame, mapping: DataFrame, strict: bool = False) -> None:
    """Fails before any heavy work if a cohort of df is not in the mapping. strict: rows without a cohort fail, too."""
    cohorts = df.select(F.coalesce("disease", F.lit("")).alias("cohort")).distinct()
    cohorts = cohorts if strict else cohorts.where("cohort <> ''")
    if missing := sorted(r[0] for r in cohorts.join(mapping.select("cohort"), "cohort", "left_anti").collect()):
        raise ValueError(f"cohorts without a mapping: {missing}")


def mask(df: DataFrame, selected: DataFrame, leading: Sequence[str] = tuple(LEADING), cohorts: DataFrame | None = None) -> DataFrame:
    """df with the features that a row's cohort does not select set to NULL.

    Rows of a cohort without any selection, or of none, are not masked; of cohorts (cohort) without one, all is. The selection has at most a row for each cohort
    and column; it is gathered by cohort and joined (broadcast only if Spark finds it small).
    """
    keep = selected.groupBy("cohort").agg(F.collect_set("csv_column").alias("_keep"))
    if cohorts is not None:
        keep = cohorts.select("cohort").distinct().join(keep, "cohort", "left").withColumn("_keep", F.coalesce("_keep", F.array().cast("array<string>")))
    features = [c for c in df.columns if c not in leading]
    joined = df.join(keep, F.col("disease") == F.col("cohort"), "left")
    return joined.select(*[c for c in leading if c in df.columns], *[F.when(F.col("_keep").isNull() | F.array_contains("_keep", c), F.col(c)).alias(c) for c in features])


def selection_report(selected: DataFrame, cohorts: DataFrame | None = None) -> DataFrame:
    """(cohort_name, n_columns_selected, columns_selected), the columns sorted and joined by semicolons; cohorts (cohort): those that are in it in any case."""
    if cohorts is not None:
        selected = cohorts.select("cohort").distinct().join(selected.select("cohort", "csv_column"), "cohort", "left")
    return selected.groupBy(F.col("cohort").alias("cohort_name")).agg(F.countDistinct("csv_column").alias("n_columns_selected"), F.array_join(F.array_sort(F.collect_set("csv_column")), ";").alias("columns_selected"))


def cohorts_to_keys(cohorts: DataFrame, keys: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cohorts joined with a mapping's keys over the ids that both resolve to, and what fails.

    cohorts: (cohort); keys: (json_key); resolved: (query_name, mondo_id). Of several keys with one id the first in
    order wins. Returned: (cohort, mondo_id, json_key), and (name, problem) with problem cohort_unresolved,
    key_unresolved or not_mapped.
    """
    ids = resolved.select("query_name", "mondo_id")
    cohort_ids = cohorts.join(ids, F.col("cohort") == F.col("query_name"), "left").select("cohort", "mondo_id")
    key_ids = keys.join(ids, F.col("json_key") == F.col("query_name"), "left").select("json_key", "mondo_id")
    first = key_ids.where("mondo_id is not null").groupBy("mondo_id").agg(F.min("json_key").alias("json_key"))
    met = cohort_ids.where("mondo_id is not null").join(first, "mondo_id", "left")
    problem = lambda df, name, what: df.select(F.col(name).alias("name"), F.lit(what).alias("problem"))
    failures = problem(cohort_ids.where("mondo_id is null"), "cohort", "cohort_unresolved").unionAll(problem(key_ids.where("mondo_id is null"), "json_key", "key_unresolved")).unionAll(problem(met.where("json_key is null"), "cohort", "not_mapped"))
    return met.where("json_key is not null").select("cohort", "mondo_id", "json_key"), failures


def disease_plan(cohorts: DataFrame, mapping: DataFrame, groups: DataFrame, columns: DataFrame, resolved: DataFrame) -> DataFrame:
    """(cohort, mondo_id, json_key, csv_column): the columns of each cohort by way of ids; failures are one error. mapping: (json_key, item)."""
    met, failures = cohorts_to_keys(cohorts, mapping.select("json_key").distinct(), resolved)
    if bad := failures.orderBy("problem", "name").collect():
        raise ValueError("; ".join(f"{r['problem']}: {r['name']}" for r in bad))
    items = mapping.join(group_columns(groups, columns), F.col("item") == F.col("feature_group")).select("json_key", "csv_column")
    return met.join(items, "json_key").select("cohort", "mondo_id", "json_key", "csv_column").distinct()
