"""Control tables: phenotypes, references, feature groups, mappings, caches, ontologies; and short textual lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morpholake.operators.reference import load_reference
from morpholake.schema import CACHE, phenotypes

_KINDS = ("feature_groups", "extra_columns", "custom_features")


def read_phenotypes(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> DataFrame:
    """A wide table of measurements from CSV: with features by an explicit schema, else as inferred."""
    if features is not None:
        return spark.read.csv(path, header=True, schema=phenotypes(list(features)), enforceSchema=False)
    return spark.read.csv(path, header=True, inferSchema=True)


def write_phenotypes(df: DataFrame, path: str) -> None:
    """A wide table as CSV with a header; NULL is an empty field."""
    df.write.csv(path, header=True, nullValue="", emptyValue="")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A reference from CSV: a reference table, or a table of controls to be aggregated."""
    return load_reference(spark.read.csv(path, header=True, inferSchema=True))


def write_reference(reference: DataFrame, path: str) -> None:
    """A reference as one CSV file, numbers with ten significant digits."""
    short = lambda c: F.format_string("%.10g", c).alias(c)
    reference.select("feature", short("mean"), short("sd"), "n").coalesce(1).write.csv(path, header=True)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(feature_group, csv_column) from CSV, without blanks and NOT_APPLICABLE; other columns are dropped."""
    return clean_groups(spark.read.csv(path, header=True))


def clean_groups(df: DataFrame) -> DataFrame:
    trimmed = df.select(F.trim("feature_group").alias("feature_group"), F.trim("csv_column").alias("csv_column"))
    return trimmed.where("feature_group <> '' and csv_column <> '' and csv_column <> 'NOT_APPLICABLE'").distinct()


def read_mapping(spark: SparkSession, path: str, kinds: Sequence[str] = _KINDS) -> DataFrame:
    """(cohort, kind, item) from a JSON file of one object, by_disease: cohort: {kind: [items]}."""
    return mapping_rows(spark.read.text(path, wholetext=True), kinds)


def mapping_rows(texts: DataFrame, kinds: Sequence[str] = _KINDS, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts. A cohort needs at least one list that is not empty; other shapes are errors."""
    fields = ", ".join(f"{k}: array<string>" for k in kinds)
    parsed = texts.select(F.from_json(column, f"by_disease map<string, struct<{fields}>>, _corrupt_record string").alias("m"))
    bad = F.col("m").isNull() | F.col("m.by_disease").isNull() | F.col("m._corrupt_record").isNotNull()
    whole = parsed.select(F.when(bad, F.raise_error(F.lit("a mapping is an object with by_disease")).cast(f"map<string, struct<{fields}>>")).otherwise(F.col("m.by_disease")).alias("d"))
    cohorts = whole.select(F.explode("d").alias("cohort", "spec"))
    lists = F.concat(*[F.transform(F.coalesce(F.col("spec")[k], F.array().cast("array<string>")), _tagged(k)) for k in kinds])
    named = F.when(F.size(lists) == 0, F.raise_error(F.concat(F.lit("a cohort without any column: "), F.col("cohort"))).cast("array<struct<kind:string,item:string>>")).otherwise(lists)
    return cohorts.select("cohort", F.explode(named).alias("x")).select("cohort", "x.kind", "x.item")


def _tagged(kind: str):
    return lambda item: F.struct(F.lit(kind).alias("kind"), item.alias("item"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CACHE, enforceSchema=False)


def write_cache(cache: DataFrame, path: str) -> None:
    """A resolution cache as one CSV file, by name."""
    cache.orderBy("query_name").coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, synonyms, xrefs) of an OBO file; stanzas are rows, obsolete terms are left out."""
    return obo_tables(spark.read.option("lineSep", "\n[").text(path))


def obo_tables(stanzas: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    terms = stanzas.where(F.col(column).startswith("Term]")).select(F.split(column, r"\r?\n").alias("lines"))
    first = lambda key: F.element_at(F.filter("lines", lambda s: s.startswith(f"{key}: ")), 1)
    kept = terms.where(~F.exists("lines", lambda s: s.startswith("is_obsolete: true"))).where(F.exists("lines", lambda s: s.startswith("id: ")))
    safe = lambda key: F.when(F.exists("lines", lambda s: s.startswith(f"{key}: ")), F.trim(F.substr(first(key), F.lit(len(key) + 3))))
    kept = kept.withColumn("curie", safe("id")).withColumn("label", safe("name"))
    many = lambda key, pattern, name: kept.select("curie", F.explode(F.filter("lines", lambda s: s.startswith(f"{key}: "))).alias("s")).select("curie", F.regexp_extract("s", pattern, 1).alias(name)).where(F.col(name) != "")
    return kept.select("curie", "label").where("label is not null"), many("synonym", r'^synonym: "((?:[^"\\]|\\.)*)"', "synonym"), many("xref", r"^xref: (\S+)", "xref")


def seeds(spec: Column) -> Column:
    """Array of seeds from text such as '0,3,10-12'; an empty list, or a part that is no number or range, is an error."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    wrong = (F.size(parts) == 0) | F.exists(parts, lambda p: ~p.rlike(r"^\d+(-\d+)?$"))
    span = lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int"))
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a list of seeds: "), F.coalesce(spec, F.lit("NULL")))).cast("array<int>")).otherwise(F.flatten(F.transform(parts, span)))


def percentiles(spec: Column) -> Column:
    """Array of percentiles from text such as '1,5,5,10': each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.split(spec, ","), lambda p: F.trim(p).cast("int"))))
