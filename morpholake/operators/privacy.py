"""Whether synthetic images lie too close to training images: flagging, adversarial accuracy, privacy loss."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_NORM = 0.1
#: Rows of a block of the nearest-neighbour join, about.
BLOCK_ROWS = 4096
PERCENTILES = (1, 2, 5, 10, 20)


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def prepared(df: DataFrame) -> DataFrame:
    """df with embedding as doubles and its norm."""
    return df.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("norm", norm("embedding"))


def drop_no_face(df: DataFrame) -> DataFrame:
    """Rows whose embedding has a norm over MIN_NORM; all-zero rows mark images without a face."""
    return prepared(df).where(F.col("norm") > MIN_NORM)


def no_face_counts(df: DataFrame, keys: Sequence[str] = ("cohort", "split")) -> DataFrame:
    return prepared(df).groupBy(*keys).agg(F.count_if(F.col("norm") <= MIN_NORM).alias("no_face"), F.count("*").alias("total"))


def cohort_coverage(df: DataFrame, splits: Sequence[str] = ("train", "heldout", "synthetic")) -> DataFrame:
    """(cohort, n_splits, in_all, and whether it is in each split)."""
    has = [F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"in_{s}") for s in splits]
    out = df.where(F.col("split").isin(*splits) & (F.col("cohort") != "")).groupBy("cohort").agg(*has)
    n = sum((F.col(f"in_{s}") for s in splits), F.lit(0))
    return out.withColumn("n_splits", n).withColumn("in_all", n == len(splits))


def _unit(df: DataFrame) -> DataFrame:
    return df.withColumn("unit", F.transform("embedding", lambda x: x / F.col("norm")))


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine of two unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_distance(queries: DataFrame, refs: DataFrame, on: Sequence[str] = ("cohort",), exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, dist): each query's cosine distance to its nearest ref of the same on-columns; queries without refs are left out.

    Queries and refs of a key are dealt to blocks of about block_rows; every block of queries meets every block of refs
    as one matrix product, and the blocks' minima are combined. So a key of any size is spread over tasks of bounded
    size, and a pair is a number, not a row. Distances have twelve decimals: those of equal pairs are equal, whatever
    the order of the sums. Queries and refs need id and embedding (without zero rows).
    """
    kind = queries.schema["id"].dataType.simpleString()
    blocks = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(name))
    every = blocks(queries, "q_blocks").join(blocks(refs, "r_blocks"), list(on))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = _unit(queries).join(every, list(on)).select(*on, "id", "unit", own("q_blocks").alias("q_block"), "r_blocks").select(*on, "id", "unit", "q_block", each("r_blocks").alias("r_block"))
    r = _unit(refs).join(every, list(on)).select(*on, "id", "unit", own("r_blocks").alias("r_block"), "q_blocks").select(*on, "id", "unit", "r_block", each("q_blocks").alias("q_block"))

    keys = [*on, "q_block", "r_block"]
    r = r.select(*[F.col(c).alias(f"ref_{c}") for c in (*keys, "id", "unit")])  # names and attributes of its own, whatever the two have in common

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"id": left["id"].slice(0, 0), "dist": pa.array([], pa.float64())})
        matrix = lambda t: t.combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        ids, x, y, best = left["id"], matrix(left["unit"]), matrix(right["ref_unit"]), np.full(len(left), np.inf)
        for i in range(0, len(x), 1024):
            d = np.round(1 - x[i : i + 1024] @ y.T, 12)
            if exclude_self:
                d[ids.to_numpy()[i : i + 1024, None] == right["ref_id"].to_numpy()[None, :]] = np.inf
            best[i : i + 1024] = d.min(axis=1)
        some = pa.array(np.isfinite(best))
        return pa.table({"id": ids.filter(some), "dist": pa.array(best).filter(some)})

    return q.groupBy(*keys).cogroup(r.groupBy(*[f"ref_{k}" for k in keys])).applyInArrow(nearest, f"id {kind}, dist double").groupBy("id").agg(F.min("dist").alias("dist"))


def flagging(synthetic: DataFrame, heldout: DataFrame, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """Counts of nearest distances strictly below percentiles of the held-out ones (linear interpolation)."""
    percentiles = sorted({int(p) for p in percentiles})
    heldout = heldout.persist()  # an id and a number for each row, read twice
    cut = heldout.agg(F.percentile("dist", F.array(*[F.lit(p / 100.0) for p in percentiles])).alias("cuts"), F.count("dist").alias("n"))
    row = cut.first()
    if not row["n"]:
        raise ValueError("no held-out distances to take percentiles of")
    below = lambda k, df: df.agg(*[F.count_if(F.col("dist") < F.lit(c)).alias(f"{k}{i}") for i, c in enumerate(row["cuts"])], F.count("dist").alias(f"{k}_total"))
    both = below("s", synthetic).crossJoin(below("h", heldout))  # one row each
    share = lambda n, total: F.when(F.col(total) > 0, F.round(100.0 * F.col(n) / F.col(total), 2)).otherwise(F.lit(0.0))
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("percentile"), F.lit(c).alias("threshold"), F.col(f"s{i}").alias("synthetic_below"), F.col("s_total").alias("synthetic_total"),
            share(f"s{i}", "s_total").alias("synthetic_pct"), F.col(f"h{i}").alias("heldout_below"), F.col("h_total").alias("heldout_total"), share(f"h{i}", "h_total").alias("heldout_pct"),
        )
        for i, (p, c) in enumerate(zip(percentiles, row["cuts"], strict=True))
    ])
    return both.select(F.explode(rows).alias("r")).select("r.*")


def subsample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n rows, those with the smallest hash of id and seed."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def _pooled(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.lit(0))


def within_distances(a: DataFrame) -> DataFrame:
    """(id, dist): each row's nearest distance to another of its own set."""
    return nearest_distance(_pooled(a), _pooled(a), ("k",), exclude_self=True)


def min_distances(a: DataFrame, b: DataFrame, within_b: DataFrame | None = None) -> DataFrame:
    """(side, id, cross, within): for each row of both sets its nearest distance to the other set and to its own; within_b: b's own, if known."""

    def side(x: DataFrame, y: DataFrame, within: DataFrame, name: str) -> DataFrame:
        cross = nearest_distance(_pooled(x), _pooled(y), ("k",)).withColumnRenamed("dist", "cross")
        return cross.join(within.withColumnRenamed("dist", "within"), "id").select(F.lit(name).alias("side"), "id", "cross", "within")

    return side(a, b, within_distances(a), "a").unionAll(side(b, a, within_distances(b) if within_b is None else within_b, "b"))


def aa_from_min_distances(distances: DataFrame) -> DataFrame:
    """(aa): adversarial accuracy from (side, cross, within); NULL if a side is empty. NaN or NULL pairs are left out."""
    usable = distances.where("cross is not null and within is not null and not isnan(cross) and not isnan(within)")
    score = lambda s: F.avg(F.when(F.col("side") == s, (F.col("cross") > F.col("within")).cast("double")))
    return usable.agg(((score("a") + score("b")) / 2).alias("aa"))


def adversarial_accuracy(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aa): how often a row is nearer to its own set than to the other, averaged over both; NULL if a set has fewer than two rows."""
    return aa_from_min_distances(min_distances(a, b))


def privacy_loss(train: DataFrame, heldout: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(aa_train_synth, aa_heldout_synth, privacy_loss), all point estimates."""
    own = within_distances(synthetic).persist()  # an id and a number for each row, read twice
    aa = lambda a, name: aa_from_min_distances(min_distances(a, synthetic, own)).withColumnRenamed("aa", name)
    both = aa(train, "aa_train_synth").crossJoin(aa(heldout, "aa_heldout_synth"))  # one row each
    return both.withColumn("privacy_loss", F.col("aa_heldout_synth") - F.col("aa_train_synth"))


def bootstrap_distances(distances: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, aa): resamples rows of precomputed distances by Poisson(1) weights from a hash of (id, draw): no row is collected, and any number of rows will do."""
    if draws < 1:
        raise ValueError("a bootstrap needs at least one draw")
    u = F.pmod(F.xxhash64("side", "id", "draw", F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return resampled(distances.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), u)


def resampled(rows: DataFrame, u: Column) -> DataFrame:
    """(draw, aa) of rows with draw, each weighted by the Poisson(1) quantile of u (0 to 1)."""
    edges = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
    weight = sum((F.when(F.col("_u") >= float(e), 1).otherwise(0) for e in edges), F.lit(0))
    return _weighted(rows.withColumn("_u", u).withColumn("w", weight))


def _weighted(df: DataFrame) -> DataFrame:
    part = lambda s: F.try_divide(F.sum(F.when((F.col("side") == s) & (F.col("cross") > F.col("within")), F.col("w")).otherwise(0)).cast("double"), F.sum(F.when(F.col("side") == s, F.col("w")).otherwise(0)).cast("double"))
    return df.groupBy("draw").agg(((part("a") + part("b")) / 2).alias("aa"))


def bootstrap_rows(a: DataFrame, b: DataFrame, draws: int, cap: int = 1000, seed: int = 0) -> DataFrame:
    """(draw, aa): resamples rows with replacement, so that a row drawn twice has its twin at distance 0.

    Both sets are capped at cap rows (as this estimator is defined: its cost is draws * cap^2), so both distance
    matrices are bounded and go to every task; the draws are spread over tasks.
    """
    if draws < 1:
        raise ValueError("a bootstrap needs at least one draw")
    spark = a.sparkSession
    sets = [np.array([r["embedding"] for r in subsample(x, cap, seed).select("embedding").collect()], dtype=np.float64) for x in (a, b)]
    if min(len(s) for s in sets) < 2:
        return spark.range(draws).select(F.col("id").cast("int").alias("draw"), F.lit(None).cast("double").alias("aa"))
    shared = spark.sparkContext.broadcast([s / np.linalg.norm(s, axis=1)[:, None] for s in sets])

    def run(parts):
        x, y = shared.value
        xx, yy, xy = 1 - x @ x.T, 1 - y @ y.T, 1 - x @ y.T
        for pdf in parts:
            out = []
            for draw in pdf["id"]:
                rng = np.random.default_rng([seed, int(draw)])
                i, j = rng.integers(len(x), size=len(x)), rng.integers(len(y), size=len(y))
                own_x, own_y, cross = xx[np.ix_(i, i)], yy[np.ix_(j, j)], xy[np.ix_(i, j)]
                np.fill_diagonal(own_x, np.inf)
                np.fill_diagonal(own_y, np.inf)
                out.append(0.5 * (np.mean(cross.min(axis=1) > own_x.min(axis=1)) + np.mean(cross.min(axis=0) > own_y.min(axis=1))))
            yield pd.DataFrame({"draw": pdf["id"].astype("int32"), "aa": out})

    return spark.range(draws).repartition(min(draws, spark.sparkContext.defaultParallelism)).mapInPandas(run, "draw int, aa double")


def summary(samples: DataFrame, column: str = "aa", alpha: float = 0.05) -> DataFrame:
    """(mean, median, std, ci_lower, ci_upper) of a column; std is the population's."""
    return samples.agg(
        F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.stddev_pop(column).alias("std"),
        F.percentile(column, F.lit(alpha / 2)).alias("ci_lower"), F.percentile(column, F.lit(1 - alpha / 2)).alias("ci_upper"),
    )


def nnaa_summary(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """(quantity, mean, median, std, ci_lower, ci_upper) of both accuracies and of the privacy loss, paired by draw."""
    both = train.withColumnRenamed("aa", "t").join(heldout.withColumnRenamed("aa", "h"), "draw")
    parts = [("aa_train_synth", F.col("t")), ("aa_test_synth", F.col("h")), ("privacy_loss", F.col("h") - F.col("t"))]
    frames = [summary(both.select(e.alias("v")), "v").select(F.lit(name).alias("quantity"), "*") for name, e in parts]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


def run_audit(df: DataFrame, percentiles: Sequence[int] = PERCENTILES, draws: int = 1000, cap: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """flagging (per cohort, pooled) and nnaa (pooled over cohorts) of one table of embeddings with id, split and cohort.

    Only cohorts in all three splits count; having none is an error.
    """
    common = cohort_coverage(df).where("in_all").select("cohort")
    if common.isEmpty():
        raise ValueError("no cohort is in train, heldout and synthetic")
    faces = drop_no_face(df).join(common, "cohort", "left_semi")
    split = {s: faces.where(F.col("split") == s) for s in ("train", "heldout", "synthetic")}
    near = {s: nearest_distance(split[s], split["train"]) for s in ("synthetic", "heldout")}
    capped = {s: subsample(x, cap, seed) for s, x in split.items()}
    draws_of = {s: bootstrap_rows(capped[s], capped["synthetic"], draws, cap, seed) for s in ("train", "heldout")}
    return {"flagging": flagging(near["synthetic"], near["heldout"], percentiles), "nnaa": nnaa_summary(draws_of["train"], draws_of["heldout"]), "no_face": no_face_counts(df)}
