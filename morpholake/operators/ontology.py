"""Names resolved to terms of an ontology: exact label, synonym, then ever looser forms; and a cache of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morpholake.schema import CACHE

#: Fixed value: a number, or "type" and a number, at a name's end.
TRAILING_NUMBER = r"\s*(?:[-,]\s*\d+|\btype\s+\d+|\d+)\s*$"


def normal(name: Column) -> Column:
    return F.lower(F.trim(name))


def fuzzy_variants(name: Column) -> Column:
    """The name trimmed, lower-cased, without a trailing number, with single spaces; each once, in that order."""
    base = F.trim(name)
    low = F.lower(base)
    stripped = F.trim(F.regexp_replace(low, TRAILING_NUMBER, ""))
    # Both are pieces of the ladder only where they differ from what comes before.
    third = F.when((stripped != "") & (stripped != low), stripped)
    collapsed = F.trim(F.regexp_replace(F.coalesce(F.when(stripped != "", stripped), low), r"\s+", " "))
    return F.array_distinct(F.array_compact(F.array(base, low, third, F.when(collapsed != "", collapsed))))


def label_index(terms: DataFrame) -> DataFrame:
    """(key, curie): the smallest id of each normalised label."""
    return terms.where("label is not null").groupBy(normal(F.col("label")).alias("key")).agg(F.min("curie").alias("curie"))


def synonym_index(synonyms: DataFrame) -> DataFrame:
    """(key, curie): the smallest id of each normalised synonym."""
    return synonyms.where("synonym is not null").groupBy(normal(F.col("synonym")).alias("key")).agg(F.min("curie").alias("curie"))


def resolve(names: DataFrame, terms: DataFrame, synonyms: DataFrame, xrefs: DataFrame, name_col: str = "name") -> DataFrame:
    """(query_name, mondo_id, mondo_name, omim_xrefs, matched_via, manual_override) for each distinct name that resolves.

    Every name meets both indexes once, with all its forms; the best rung of the ladder wins.
    """
    forms = names.select(F.col(name_col).alias("query_name")).where("query_name is not null").distinct()
    ladder = forms.select("query_name", F.posexplode(fuzzy_variants(F.col("query_name"))).alias("form", "variant")).select("query_name", "form", normal(F.col("variant")).alias("key"))
    rung = lambda index, k: ladder.join(index, "key").select("query_name", F.struct((F.col("form") * 2 + k).alias("rung"), F.col("curie")).alias("hit"))
    best = rung(label_index(terms), 0).unionAll(rung(synonym_index(synonyms), 1)).groupBy("query_name").agg(F.min("hit").alias("hit"))
    found = best.select("query_name", F.col("hit.curie").alias("mondo_id"), F.when(F.col("hit.rung") == 0, "exact").when(F.col("hit.rung") == 1, "synonym").otherwise("fuzzy").alias("matched_via"))
    label = terms.groupBy(F.col("curie").alias("mondo_id")).agg(F.min("label").alias("mondo_name"))
    omim = xrefs.where(F.startswith("xref", F.lit("OMIM:"))).groupBy(F.col("curie").alias("mondo_id")).agg(F.array_join(F.array_sort(F.collect_set("xref")), ";").alias("omim_xrefs"))
    out = found.join(label, "mondo_id", "left").join(omim, "mondo_id", "left")
    return out.select("query_name", "mondo_id", "mondo_name", F.coalesce("omim_xrefs", F.lit("")).alias("omim_xrefs"), "matched_via", F.lit("false").alias("manual_override"))


def resolve_with_cache(names: DataFrame, cache: DataFrame, terms: DataFrame, synonyms: DataFrame, xrefs: DataFrame, name_col: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, unresolved, new cache). Cached rows win; a manual one says so in matched_via. Unresolved names are not cached."""
    cache = cache.select(*CACHE.fieldNames())
    asked = names.select(F.col(name_col).alias("query_name")).where("query_name is not null").distinct()
    hits = cache.join(asked, "query_name", "left_semi")
    fresh = resolve(asked.join(cache, "query_name", "left_anti"), terms, synonyms, xrefs, "query_name")
    told = hits.withColumn("matched_via", F.when(F.lower("manual_override") == "true", "manual").otherwise(F.col("matched_via")))
    resolved = told.unionByName(fresh)
    return resolved, asked.join(resolved, "query_name", "left_anti"), cache.unionByName(fresh).orderBy("query_name")


def suggest(names: DataFrame, terms: DataFrame, k: int = 3, name_col: str = "name") -> DataFrame:
    """(query_name, position, suggestion): up to k labels that hold the name (without its trailing number, or whole), in the order of their ids.

    The unresolved names are few, and are what is broadcast if Spark finds them small; of each name's labels only the
    first k survive in every task (a window's group limit), so a name that many labels hold does no harm.
    """
    asked = names.select(F.col(name_col).alias("query_name")).distinct()
    target = normal(F.col("query_name"))
    asked = asked.select("query_name", target.alias("whole"), F.trim(F.regexp_replace(target, TRAILING_NUMBER, "")).alias("bare"))
    holds = ((F.col("bare") != "") & F.contains("key", "bare")) | ((F.col("whole") != "") & F.contains("key", "whole"))
    met = label_index(terms).join(asked, holds)
    ranked = met.withColumn("position", F.row_number().over(Window.partitionBy("query_name").orderBy("curie", "key")))
    return ranked.where(F.col("position") <= k).select("query_name", "position", F.col("key").alias("suggestion"))


#: Types of the tables that sources.tables.read_obo gives.
TERM, SYNONYM, XREF = (T.StructType([T.StructField("curie", T.StringType()), T.StructField(x, T.StringType())]) for x in ("label", "synonym", "xref"))
