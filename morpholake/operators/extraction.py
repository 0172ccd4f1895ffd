"""Extraction with a choice of columns for each cohort, end to end: measurements, plugins, masks and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.operators.features import FEATURES
from morpholake.operators.ontology import resolve
from morpholake.operators.phenotypes import extract_features
from morpholake.operators.plugins import Registry
from morpholake.operators.selection import check_cohorts, cohorts_to_keys, disease_plan, mask, selected_columns, selection_report


def _columns(records: DataFrame, plugins: Registry | None) -> DataFrame:
    own = plugins.freeze() if plugins else []
    return records.sparkSession.createDataFrame([(c,) for c in [*FEATURES, *own]], "csv_column string")


def _cohorts(records: DataFrame) -> DataFrame:
    return records.select(F.col("disease").alias("cohort")).where("cohort <> ''").distinct()


def extract_custom(
    records: DataFrame, mapping: DataFrame, groups: DataFrame | None = None, plugins: Registry | None = None,
    depth: Sequence[float] | None = None, frontal_check: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The wide table, in which each cohort keeps what a user's mapping selects, and the report (cohort_name, n_columns_selected, columns_selected).

    mapping: (cohort, kind, item), as selected_columns takes it; a cohort of the records that is not in it is an error
    before anything is measured. A cohort that selects nothing keeps nothing; rows without a cohort keep everything.
    """
    check_cohorts(records, mapping)
    cohorts = _cohorts(records)
    own = mapping.join(cohorts, "cohort", "left_semi")
    selected = selected_columns(own, groups, _columns(records, plugins), plugins.table(records.sparkSession) if plugins else None)
    return mask(extract_features(records, depth, frontal_check, plugins=plugins), selected, cohorts=cohorts), selection_report(selected, cohorts)


def extract_for_diseases(
    records: DataFrame, mapping: DataFrame, groups: DataFrame, terms: DataFrame, synonyms: DataFrame, xrefs: DataFrame,
    depth: Sequence[float] | None = None, frontal_check: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The wide table, in which each cohort keeps the columns of the disease that its name resolves to, and the report (cohort_name, mondo_id, json_disease_key, n_columns_selected, columns_selected).

    mapping: (json_key, item), item a feature group. Cohorts and keys meet by the id that both names resolve to; names
    that do not resolve, and cohorts without a key, are one error that lists them.
    """
    cohorts = _cohorts(records)
    names = cohorts.select(F.col("cohort").alias("name")).union(mapping.select("json_key")).distinct()
    resolved = resolve(names, terms, synonyms, xrefs)
    plan = disease_plan(cohorts, mapping, groups, _columns(records, None), resolved)
    met, _ = cohorts_to_keys(cohorts, mapping.select("json_key").distinct(), resolved)
    report = selection_report(plan, cohorts).join(met.select(F.col("cohort").alias("cohort_name"), "mondo_id", F.col("json_key").alias("json_disease_key")), "cohort_name")
    table = mask(extract_features(records, depth, frontal_check), plan, cohorts=cohorts)
    return table, report.select("cohort_name", "mondo_id", "json_disease_key", "n_columns_selected", "columns_selected")
