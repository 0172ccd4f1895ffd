"""Arrow text columns as flat byte blocks, their words as vectors, and 64-bit hashes of words.

Everything here works on one block of bounded size at a time, so a task's memory does not depend on how many rows it
reads (a single text is one row and is held whole).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_C = ctypes.CDLL(None)
#: Bytes of text handled at once.
BLOCK_BYTES = 4 << 20
#: Words up to this many bytes are hashed from three 8-byte lanes; longer ones go through xxhash.
LANE_BYTES = 24
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)


class Block(NamedTuple):
    """Rows of one piece of an Arrow batch: ids (any type), and their texts' UTF-8 bytes end to end."""

    ids: pa.Array
    data: bytes
    offsets: np.ndarray  # of rows + 1 positions in data


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, as doc_id and text; a null text is empty. Other columns cannot clash with results."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def flat(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """A string or binary array's bytes and its rows' offsets, without a Python object per row."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    return memoryview(data or b""), at


def given_back() -> None:
    """Returns freed memory to the system: a worker that has done with a large batch is kept for later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about limit bytes (a longer text makes a block of its own) from batches of (doc_id, text)."""
    for batch in batches:
        text = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
        data, at = flat(text)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield Block(batch.column(0).slice(first, last - first), bytes(data[at[first] : at[last]]), at[first : last + 1] - at[first])
            first = last
        given_back()


class Words(NamedTuple):
    """Space-separated lower-cased words of a block: where each starts and ends in data, and of which row it is."""

    data: bytes  # lower-cased A-Z, padded with LANE_BYTES zero bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1 positions in start: the words of row r are first[r]:first[r + 1]


#: Bytes between words of letters and digits; bytes beyond ASCII belong to words.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(block: Block, between: np.ndarray = IS_SPACE) -> Words:
    """Words are the longest runs without bytes of between (\\x20 and \\x09-\\x0D); no word crosses from one row to the next."""
    data = block.data.lower() + bytes(LANE_BYTES)  # bytes.lower() changes A-Z alone
    n = len(block.data)
    inside = ~between[np.frombuffer(data, dtype=np.uint8, count=n)]
    before = np.empty(n, dtype=bool)
    before[:1], before[1:] = False, inside[:-1]
    cut = block.offsets[:-1][block.offsets[:-1] < n]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, block.offsets))


def lanes(data: bytes, start: np.ndarray, length: np.ndarray, count: int) -> list[np.ndarray]:
    """The first 8 * count bytes of each span as little-endian integers, zero beyond its end."""
    view = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    out = []
    for i in range(count):
        have = np.clip(length - 8 * i, 0, 8)
        out.append(view[np.minimum(start + 8 * i, len(data) - 8)] & _KEEP[have])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits (the finaliser of a multiply-xorshift hash)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def span_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes. data must end in LANE_BYTES bytes of padding."""
    length = end - start
    h = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    for lane in lanes(data, start, length, LANE_BYTES // 8):
        h = mix(h ^ lane) + U64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(length > LANE_BYTES):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], 7)
    return h


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words inside a row, and rows + 1 positions in them.

    A row of fewer words has one shingle of them all; a row without words has none.
    """
    count = np.diff(first)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(each)))
    begin = np.repeat(first[:-1], each) + ragged(each)
    have = np.repeat(np.minimum(count, n), each)
    h = mix(have.astype(U64))
    for i in range(n):
        more = i < have
        h = np.where(more, mix(h ^ hashes[np.minimum(begin + i, max(len(hashes) - 1, 0))]) + U64(0x9E3779B97F4A7C15), h) if len(hashes) else h
    return mix(h), at


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, end to end."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir; where it is unset a new local one, which only a session on one machine may use."""
    context = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if (set_ := context._jsc.sc().getCheckpointDir()).isDefined():
        return set_.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and written as a table to the shared folder, so lost executors cost nothing before it.

    A table is read with its true size. What checkpoint() returns keeps the planner's estimate instead, and a join's is
    the product of both sides': over a loop's rounds it grows to numbers that take the driver minutes to multiply.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the table of a checkpointed df that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
