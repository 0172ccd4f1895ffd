"""Where models plug in: detectors, recognisers, perceptual distances. A factory runs once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.schema import LANDMARKS

Detector = Callable[[bytes], Mapping[str, Any] | None]
Embedder = Callable[[bytes], np.ndarray | None]
Distance = Callable[[bytes, list[bytes]], np.ndarray]


@lru_cache(maxsize=8)
def _worker_model(factory: Callable[[], Any]) -> Any:
    return factory()


def detect_landmarks(images: DataFrame, factory: Callable[[], Detector], default_cohort: str | None = None) -> DataFrame:
    """Landmark records of (cohort, image_id, content) rows; images that the detector rejects or fails on are left out."""
    cohort = F.lit(default_cohort) if default_cohort is not None else F.col("cohort")
    rows = images.select(cohort.alias("disease"), "image_id", "content")
    arrow = pa.schema([
        ("image_id", pa.string()), ("disease", pa.string()), ("landmarks_3d", pa.list_(pa.list_(pa.float64()))), ("image_size", pa.list_(pa.float64())),
        ("transformation_matrix", pa.list_(pa.list_(pa.float64()))), ("blendshapes", pa.list_(pa.float64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = _worker_model(factory)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    found = detect(row["content"])
                except Exception:  # one unreadable image must not end the job
                    found = None
                if found is not None:
                    out.append({f.name: found.get(f.name) for f in arrow} | {"image_id": row["image_id"], "disease": row["disease"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, LANDMARKS)


def embed_images(images: DataFrame, factory: Callable[[], Embedder], dim: int, backbone: str, split: str) -> DataFrame:
    """(split, cohort, image, backbone, embedding); a row of zeros where there is no face. Write it as Parquet to reuse it."""
    rows = images.select("cohort", F.col("image_id").alias("image"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = _worker_model(factory)
        for batch in batches:
            found = []
            for content in batch.column(2).to_pylist():
                try:
                    v = embed(content)
                except Exception:  # as an image without a face
                    v = None
                found.append(np.zeros(dim, dtype=np.float32) if v is None else np.asarray(v, dtype=np.float32))
            n = len(batch)
            yield pa.RecordBatch.from_pydict({"split": pa.array([split] * n), "cohort": batch.column(0), "image": batch.column(1), "backbone": pa.array([backbone] * n), "embedding": pa.array(found, pa.list_(pa.float32()))})

    return rows.mapInArrow(run, "split string, cohort string, image string, backbone string, embedding array<float>")


def perceptual_nearest(queries: DataFrame, refs: DataFrame, factory: Callable[[], Distance], exclude_self: bool = False, batch: int = 64) -> DataFrame:
    """(id, dist): the smallest distance of each query to the refs of its cohort; both have id, cohort and content.

    Pairs meet by cohort in an equi-join of ids; the model sees a query with up to batch refs at once. The set sizes
    are the caller's (the audit caps them), since every pair costs a model call.
    """
    q = queries.select("id", "cohort", F.col("content").alias("q"))
    r = refs.select(F.col("id").alias("ref"), "cohort", F.col("content").alias("r"))
    pairs = q.join(r, "cohort")
    pairs = pairs.where("id <> ref") if exclude_self else pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _worker_model(factory)
        for part in batches:
            ids, qs, rs = (part.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(ids):
                j = i
                while j < len(ids) and ids[j] == ids[i] and j - i < batch:
                    j += 1
                d = np.asarray(distance(qs[i], rs[i:j]), dtype=np.float64)
                d = d[np.isfinite(d)]
                if len(d):
                    yield pa.RecordBatch.from_pydict({"id": pa.array([ids[i]]), "dist": pa.array([float(d.min())])})
                i = j

    kind = queries.schema["id"].dataType.simpleString()
    return pairs.select("id", "q", "r").mapInArrow(run, f"id {kind}, dist double").groupBy("id").agg(F.min("dist").alias("dist"))
