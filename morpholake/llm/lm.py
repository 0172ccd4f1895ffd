"""Stupid-backoff scores of documents by the n-gram counts of all other documents.

score(w | h) = c(h w) / c(h) if c(h w) > 0, else ALPHA * score(w | h less its first word); without a context it is
c(w) / N. A word's context h is the ORDER - 1 words before it, as many as its row has. Counts are those of the whole
corpus less the row's own (leave one out), so that a text does not vouch for itself; a word that no other row has counts
as half a word. N: words of all other rows (1 at least). Words are lower-cased runs without white space.

It is a join of exploded n-grams with count tables that are partitioned by hash, in columns instead of rows:
 1. Documents are gathered into units of about UNIT bytes, and dealt by unit.
 2. A unit's n-grams of all orders are added up to its distinct ones, sorted by hash, and cut into hash ranges: a row
    for each unit and bucket. (This is the partial aggregation: an n-gram costs a unit one entry, however frequent.)
 3. A bucket is a part of the count table. It adds up its units' entries and answers each unit's row with the counts
    that all other units have, entry by entry.
 4. A unit meets the answers to its rows, takes each document's own n-grams off, and sums the scores by document.

The number of buckets grows with the text, so that a bucket's size does not; entries are never dropped or sampled, and
nothing is broadcast. A unit writes no more rows than it has entries. N-grams are told apart by KEY_BITS bits of hash.

Cases: a null text is empty; a text without words has score 0.0 of 0 words; repeated rows and ids are rows of their own
(each other's evidence, too); a null id stays null; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import U64, Block, checkpointed, id_and_text, mix, span_hashes, text_blocks, words

ALPHA, ORDER = 0.4, 3
#: Bytes of text of a unit, and characters of text for each bucket.
UNIT, BUCKET_CHARS = 4 << 20, 12 << 20
KEY_BITS = 60
_UNITS = "unit bigint, ids binary, valid binary, offsets binary, data binary"
_ENTRIES = "unit bigint, bucket int, n bigint, keys binary, counts binary"
_ANSWERS = "unit bigint, bucket int, n bigint, others binary"
_SCORES = "doc_id bigint, n_tokens bigint, n_backoff bigint, n_base bigint, part double"


def _packed(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes: the planes of small numbers' upper bytes take no room."""
    return zstandard.ZstdCompressor(1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Grams:
    """All n-grams of a block: order 1 first, each order's in the order of their places."""

    def __init__(self, block: Block, order: int):
        w = words(block)
        self.rows, self.length = len(block.offsets) - 1, np.diff(w.first)
        row = np.repeat(np.arange(self.rows), self.length)
        one = last = span_hashes(w.data, w.start, w.end)
        self.place, keys = [], []  # of each order: the place of the n-gram's first word
        at = np.arange(len(one))
        for k in range(1, order + 1):
            if k > 1:
                fits = at[at + k - 1 < len(one)]
                fits = fits[row[fits] == row[fits + k - 1]]
                last = mix(last[np.searchsorted(at, fits)] + U64(0x9E3779B97F4A7C15)) ^ one[fits + k - 1]
                at = fits
            self.place.append(at)
            keys.append(mix(last + U64(k)) >> U64(64 - KEY_BITS))
        self.row = row
        self.key = np.concatenate(keys)
        self.of_row = np.concatenate([row[p] for p in self.place])
        self.cut = np.cumsum([0, *map(len, keys)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.key, return_counts=True)

    def others(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each n-gram its count in all other rows; elsewhere: of each distinct key, in order, its count in other units."""
        order = np.argsort(self.key, kind="stable")  # rows ascend within a key
        key, row = self.key[order], self.of_row[order]
        new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=bool)
        new_own = new_key | np.concatenate(([True], row[1:] != row[:-1])) if len(key) else new_key
        if new_key.sum() != len(elsewhere):
            raise RuntimeError("a unit's texts changed between two readings: documents must be read in an order that does not vary")
        each = lambda new: np.diff(np.append(np.flatnonzero(new), len(new)))
        out = np.empty(len(order), dtype=np.int64)
        here = np.repeat(each(new_key) + elsewhere, each(new_key)) - np.repeat(each(new_own), each(new_own))
        out[order] = here
        return out


def _scores(g: Grams, elsewhere: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: backoff steps, words scored without a context, and the sum of the scores but for those words' -ln N."""
    count = g.others(elsewhere)
    of = [count[i:j] for i, j in zip(g.cut[:-1], g.cut[1:], strict=True)]
    n = len(of[0])
    score, done = np.zeros(n), np.zeros(n, dtype=bool)
    steps = np.zeros(n, dtype=np.int64)
    for k in range(len(of), 1, -1):
        first = g.place[k - 1]
        word = first + k - 1
        c, context = of[k - 1], of[k - 2][np.searchsorted(g.place[k - 2], first)]
        ask = ~done[word]
        hit = ask & (c > 0)
        score[word[hit]] += np.log(c[hit] / context[hit])
        done[word[hit]] = True
        miss = word[ask & ~hit]
        score[miss] += math.log(alpha)
        steps[miss] += 1
    score[~done] += np.log(np.maximum(of[0][~done], 0.5))
    total = lambda x: np.bincount(g.row, weights=x, minlength=g.rows)
    return total(steps).astype(np.int64), total(~done).astype(np.int64), total(score)


def _units(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3)
        for block in text_blocks(batches, UNIT):
            ids = block.ids.cast(pa.int64())
            valid = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), dtype=np.uint8)
            known = np.asarray(ids.fill_null(0)).astype("<i8")
            yield _batch(_UNITS, [unit], [known.tobytes()], [valid.tobytes()], [block.offsets.astype("<i8").tobytes()], [press.compress(block.data)])
            unit += 1

    return texts.mapInArrow(run, _UNITS)


def _block(offsets: bytes, data: bytes) -> Block:
    return Block(None, zstandard.ZstdDecompressor().decompress(data), np.frombuffer(offsets, dtype="<i8"))


def _entries(units: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each unit's distinct n-grams with their counts, a row for each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(b << KEY_BITS) // buckets for b in range(buckets + 1)], dtype=U64)
        for batch in batches:
            for unit, offsets, data in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                key, count = Grams(_block(offsets.as_py(), data.as_py()), order).distinct()
                cut = np.searchsorted(key, bounds)
                full = np.flatnonzero(np.diff(cut))
                for some in np.array_split(full, -(-len(full) // 64) or 1):
                    parts = [(int(b), slice(int(cut[b]), int(cut[b + 1]))) for b in some]
                    keys = [_packed(np.diff(key[s], prepend=U64(0))) for _, s in parts]
                    yield _batch(_ENTRIES, [unit] * len(parts), [b for b, _ in parts], [s.stop - s.start for _, s in parts], keys, [_packed(count[s]) for _, s in parts])

    return units.mapInArrow(run, _ENTRIES)


def _answers(entries: DataFrame) -> DataFrame:
    """To each row of entries the counts that other units have of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, u, n, k, c) for batch in batches for u, b, n, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            unit, keys, counts = [], [], []
            for _, u, _, k, c in group:
                unit.append(u)
                keys.append(np.cumsum(_unpacked(k), dtype=U64))
                counts.append(_unpacked(c).astype(np.uint32))
            cut = np.cumsum([0, *map(len, keys)])
            key, count = np.concatenate(keys), np.concatenate(counts)
            del keys, counts
            order = np.argsort(key)
            key = key[order]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            del key
            total = np.add.reduceat(count[order].astype(np.int64), head)
            others = np.empty(len(order), dtype=np.int64)
            others[order] = np.repeat(total, np.diff(np.append(head, len(order))))
            others -= count
            del order, head, total, count
            for i in range(0, len(unit), 64):
                part = range(i, min(i + 64, len(unit)))
                yield _batch(_ANSWERS, [unit[k] for k in part], [bucket] * len(part), [int(cut[k + 1] - cut[k]) for k in part], [_packed(others[cut[k] : cut[k + 1]]) for k in part])

    return entries.repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(run, _ANSWERS)


def _met(units: DataFrame, answers: DataFrame, order: int, alpha: float) -> DataFrame:
    def score(one: pa.Table, found: pa.Table) -> pa.Table:
        r = one.to_pylist()[0]
        g = Grams(_block(r["offsets"], r["data"]), order)
        rows = sorted(found.select(["bucket", "others"]).to_pylist(), key=lambda x: x["bucket"])
        elsewhere = np.concatenate([*(_unpacked(x["others"]).astype(np.int64) for x in rows), np.zeros(0, dtype=np.int64)])
        steps, base, part = _scores(g, elsewhere, alpha)
        ids = pa.array(np.frombuffer(r["ids"], dtype="<i8"), mask=np.frombuffer(r["valid"], dtype=np.uint8) == 0)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([ids, pa.array(g.length.astype(np.int64)), pa.array(steps), pa.array(base), pa.array(part)], [f.split()[0] for f in _SCORES.split(", ")])])

    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(score, _SCORES)


def score_documents(df: DataFrame, alpha: float = ALPHA, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_backoff, log_score) for each row: its words, the times a shorter context was taken, and the sum of the natural logarithms of its words' scores. Ids are integers."""
    if order < 1:
        raise ValueError("the order is that of unigrams, 1, or more")
    texts = id_and_text(df.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(32, -(-size // BUCKET_CHARS))
    units = _units(texts).repartition("unit")
    scored = checkpointed(_met(units, _answers(_entries(units, order, buckets)), order, alpha))
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    others = F.greatest(F.lit(total) - F.col("n_tokens"), F.lit(1)).cast("double")
    return scored.select("doc_id", "n_tokens", "n_backoff", F.when(F.col("n_tokens") > 0, F.col("part") - F.col("n_base") * F.log(others)).otherwise(0.0).alias("log_score"))
