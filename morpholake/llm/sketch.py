"""Document fingerprints: the k smallest hashes of a text's distinct word shingles.

Sketches of parts merge into the sketch of the whole (the k smallest of both). Two sketches estimate resemblance (the
share of the k smallest hashes of the union that both hold), containment, and each the number of distinct shingles.

Cases: a null text is empty; a text without words has an empty sketch, which is like another empty one (1.0) and unlike
any other (0.0); a text of fewer words than a shingle has one shingle of them all; equal texts have equal sketches; a
table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import Block, id_and_text, shingle_hashes, span_hashes, text_blocks, words

K, SHINGLE = 256, 5
#: Bytes of input for each part of a table that is put in order, and quantiles of ids, at most.
PART_BYTES, CUTS = 1 << 20, 4096


def sketches(block: Block, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each row's k smallest distinct hashes, in order."""
    w = words(block)
    hashes, at = shingle_hashes(span_hashes(w.data, w.start, w.end), w.first, shingle)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(hashes[i:j])[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.unique(np.concatenate((a, b)))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of distinct shingles of either that both have."""
    both = np.sort(np.concatenate((a, b)))
    if not len(both):
        return 1.0
    twice = np.concatenate((both[1:] == both[:-1], [False]))
    first = np.concatenate(([True], ~twice[:-1]))
    union = min(k, int(first.sum()))
    return float(twice[first][:union].sum() / union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's distinct shingles that b has too; 1.0 for an empty a."""
    if not len(a):
        return 1.0
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na)


def written(a: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, big-endian."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    """A sketch from its text."""
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def fingerprint_texts(df: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_shingles) for each row; no shuffle."""
    texts = id_and_text(df, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            own = sketches(block, k, shingle)
            yield pa.RecordBatch.from_pydict({"doc_id": block.ids, "fingerprint": pa.array([written(x) for x in own], pa.string()), "n_shingles": pa.array([distinct_shingles(x, k) for x in own], pa.float64())})

    return texts.mapInArrow(run, f"doc_id {kind}, fingerprint string, n_shingles double")


def in_order(df: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, text, part, guest): rows of a part lie together and ascend by doc_id; a guest, at the end of each part, repeats the first row of the next part (of the first part after the last).

    Parts are ranges of ids, as many as there are part_bytes of input, so that a task's part does not grow with the
    input: ranges between quantiles (CUTS at most), each cut into ranges of equal width where there are more parts. What
    reaches the driver is the quantiles and a row for each part. Rows without an id come first.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(16, size // part_bytes if size < 1 << 60 else 4 * df.rdd.getNumPartitions())  # an input of unknown size has the largest number there
    ranges, within = min(parts, CUTS), -(-parts // CUTS)
    cuts = df.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges), F.min("doc_id"), F.max("doc_id")).first()
    cuts, low, high = sorted(set(cuts[0] or [])), cuts[1], cuts[2]
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    if within > 1 and cuts:
        ends = F.array(*[F.lit(c) for c in [low - 1, *cuts, high]]).cast("array<bigint>")
        begin, end = F.element_at(ends, part + 1), F.element_at(ends, part + 2)
        step = F.floor((F.col("doc_id") - begin - 1).cast("double") * within / F.greatest(end - begin, F.lit(1))).cast("int")
        part = part * within + F.coalesce(F.greatest(F.least(step, F.lit(within - 1)), F.lit(0)), F.lit(0))
    rows = df.withColumn("part", part).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id"), F.col("tie"))).alias("head"))
    found = sorted((r["part"], r["head"]["doc_id"], r["head"]["tie"]) for r in heads.collect()) if cuts else [(r["part"], r["head"]["doc_id"], r["head"]["tie"]) for r in heads.collect()]
    if not found:
        return rows.withColumn("guest", F.lit(False)).drop("tie").select("doc_id", "text", "part", "guest")
    before = [found[i - 1][0] for i in range(len(found))]
    wanted = df.sparkSession.createDataFrame([(i, t, b) for (_, i, t), b in zip(found, before, strict=True)], "head_id bigint, head_tie bigint, host int")
    guests = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))).dropDuplicates(["host"])
    guests = guests.select("doc_id", "text", F.col("host").alias("part"), "tie", F.lit(True).alias("guest"))
    every = rows.select("doc_id", "text", "part", "tie", F.lit(False).alias("guest")).unionAll(guests)
    return every.repartition(max(1, len(found) // 8), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text", "part", "guest")


def edit_likeness(df: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's, and their likeness; ids are integers.

    Edited: the last half (rounded down) of the code points is replaced by as many of the next document's first ones,
    or all of them; documents are in ascending order, and after the last comes the first.
    """
    rows = in_order(id_and_text(df.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: id, part, text, sketch
        for batch in batches:
            done = 0
            for block in text_blocks(iter([batch])):
                n = len(block.ids)
                ids, parts, guests = block.ids.to_pylist(), batch.column(2).slice(done, n).to_pylist(), batch.column(3).slice(done, n).to_pylist()
                done += n
                own = sketches(block, k, shingle)
                raw = np.frombuffer(block.data, dtype=np.uint8)
                chars = np.flatnonzero((raw & 0xC0) != 0x80)
                ends = np.append(chars, len(raw))
                at = block.offsets
                first = np.searchsorted(chars, at)
                queue: list[tuple] = []  # finished pairs: id, n_chars, edited, sketch, next sketch
                previous = held
                for r in range(n):
                    size = int(first[r + 1] - first[r])
                    if previous is not None and not previous[5] and previous[1] == parts[r]:
                        _, _, text, size0, sketch, _, head = previous
                        take = min(size0 // 2, size)
                        edited = text[:head] + block.data[at[r] : ends[first[r] + take]]
                        queue.append((previous[0], size0, edited, sketch, own[r]))
                    text = block.data[at[r] : at[r + 1]]
                    head = int(ends[first[r] + size - size // 2] - at[r])
                    previous = (ids[r], parts[r], text, size, own[r], guests[r], head)
                held = previous
                yield _pairs(queue, k, shingle)

    def _pairs(queue: list[tuple], k: int, shingle: int) -> pa.RecordBatch:
        edited = [q[2] for q in queue]
        again = sketches(Block(None, b"".join(edited), np.concatenate(([0], np.cumsum([len(x) for x in edited]))).astype(np.int64)), k, shingle)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([q[0] for q in queue], pa.int64()),
            "n_chars": pa.array([q[1] for q in queue], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            "fingerprint": pa.array([written(q[3]) for q in queue], pa.string()),
            "edited_fingerprint": pa.array([written(x) for x in again], pa.string()),
            "near_edited": pa.array([resemblance(q[3], x, k) for q, x in zip(queue, again, strict=True)], pa.float64()),
            "near_next": pa.array([resemblance(q[3], q[4], k) for q in queue], pa.float64()),
            "n_shingles": pa.array([distinct_shingles(q[3], k) for q in queue], pa.float64()),
            "held_by_edited": pa.array([containment(q[3], x, k) for q, x in zip(queue, again, strict=True)], pa.float64()),
        })

    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held_by_edited double")
