"""Result files of the audit and of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagging_rows(flagging: DataFrame, metric: str = "cosine") -> DataFrame:
    """(metric, percentile, threshold with six places, synthetic_pct, heldout_pct, n_synthetic, n_heldout)."""
    return flagging.select(F.lit(metric).alias("metric"), "percentile", F.format_string("%.6f", "threshold").alias("threshold"), "synthetic_pct", "heldout_pct", F.col("synthetic_total").alias("n_synthetic"), F.col("heldout_total").alias("n_heldout"))


def nnaa_rows(nnaa: DataFrame, sizes: dict[str, int], draws: int, metric: str = "cosine") -> DataFrame:
    """One row of medians and the loss's interval with four places, the last three signed."""
    of = lambda q, c: F.max(F.when(F.col("quantity") == q, F.col(c)))
    return nnaa.agg(
        F.lit(metric).alias("metric"), F.format_string("%.4f", of("aa_train_synth", "median")).alias("aa_train_synth"), F.format_string("%.4f", of("aa_test_synth", "median")).alias("aa_heldout_synth"),
        *[F.format_string("%+.4f", of("privacy_loss", c)).alias(n) for n, c in (("privacy_loss", "median"), ("ci_lower", "ci_lower"), ("ci_upper", "ci_upper"))],
        *[F.lit(sizes.get(s)).alias(f"n_{s}") for s in ("train", "heldout", "synthetic")], F.lit(draws).alias("n_bootstrap"),
    )


def results_json(flagging: DataFrame, nnaa: DataFrame) -> DataFrame:
    """(value): one JSON text of both tables; they have a row for each percentile and quantity."""
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return rows(flagging, "flagging").crossJoin(rows(nnaa, "nnaa")).select(F.to_json(F.struct("flagging", "nnaa")).alias("value"))


def write_one_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
