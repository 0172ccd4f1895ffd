"""Sum-of-squares online packing of tokenised documents into windows.

A document's whole windows go out as they are. Its rest is placed, as it comes, into the fill level that keeps the sum
of squared counts of partially filled windows least; level 0 opens a window, and a level array holds the counts. This
needs no look at later documents, so every task packs what it reads, in its order, without any shuffle. When a task
ends (or holds MAX_OPEN open windows, which bounds its memory), the emptiest open windows are cut up to fill the
fullest ones, and the last one is cut into lengths that are powers of two, which need no padding.

Cases: a null text is empty; an empty document has the end token alone; repeated rows are packed each by itself; a table
without rows gives none; other columns are ignored. sequence_id holds the task's number in its upper bits, so it is
unique and the same when a task is run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from morpholake.llm.blocks import id_and_text, text_blocks
from morpholake.llm.bpe import TEXT_BYTES, json_encoder

#: Open windows of a task, at most.
MAX_OPEN = 4096
Piece = tuple[object, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


class Packer:
    """Windows of one task. out: finished pieces as (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first: int, max_open: int = MAX_OPEN):
        self.window, self.next, self.max_open = window, first, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)  # open windows at each fill level
        self.open: dict[int, list[list[Piece]]] = {}
        self.total = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.out.append((doc, start, ids, tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def level(self, size: int) -> int:
        """The fill level into which a piece of this size goes; 0 is a new window. On ties the fullest."""
        fills = np.flatnonzero(self.count[: self.window - size + 1])
        fills = np.concatenate((np.zeros(1, dtype=np.int64), fills[fills > 0]))
        grown = np.where(fills + size < self.window, 2 * self.count[np.minimum(fills + size, self.window)] + 1, 0)
        change = grown + np.where(fills > 0, 1 - 2 * self.count[fills], 0)
        return int(fills[len(fills) - 1 - np.argmin(change[::-1])])

    def add(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self._close([(doc, start, ids[start : start + self.window], len(ids))])
        if rest := len(ids) - whole:
            at = self.level(rest)
            pieces: list[Piece] = []
            if at:
                pieces = self.open[at].pop()
                self.count[at] -= 1
                self.total -= 1
            pieces.append((doc, whole, ids[whole:], len(ids)))
            if at + rest == self.window:
                self._close(pieces)
            else:
                self.open.setdefault(at + rest, []).append(pieces)
                self.count[at + rest] += 1
                self.total += 1
        if self.total >= self.max_open:
            self.finish()

    def finish(self) -> None:
        """Closes every open window: no padding is left."""
        left = [(fill, pieces) for fill in sorted(self.open) for pieces in self.open[fill]]
        i, j = 0, len(left) - 1
        while i < j:
            fill, pieces = left[j]
            small, giver = left[i]
            doc, start, ids, tokens = giver.pop()
            take = min(self.window - fill, len(ids))
            pieces.append((doc, start + len(ids) - take, ids[len(ids) - take :], tokens))
            if take < len(ids):
                giver.append((doc, start, ids[: len(ids) - take], tokens))
            left[i], left[j] = (small - take, giver), (fill + take, pieces)
            if not giver:
                i += 1
            if fill + take == self.window:
                self._close(pieces)
                j -= 1
        if i == j and left[i][1]:
            fill, pieces = left[i]
            pieces = pieces[::-1]
            for bit in range(fill.bit_length() - 1, -1, -1):
                if need := fill & (1 << bit):
                    own: list[Piece] = []
                    while need:
                        doc, start, ids, tokens = pieces.pop()
                        take = min(need, len(ids))
                        own.append((doc, start, ids[:take], tokens))
                        if take < len(ids):
                            pieces.append((doc, start + take, ids[take:], tokens))
                        need -= take
                    self._close(own)
        self.open, self.total = {}, 0
        self.count[:] = 0


def pack_texts(df: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of each row's ids and end_id.

    path: a byte-level BPE tokenizer as JSON that every executor can read. window: a power of two.
    """
    texts = id_and_text(df, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
        ids = [np.ascontiguousarray(r[2]) for r in rows]
        columns = {
            "doc_id": pa.array([r[0] for r in rows], like),
            "start": pa.array([r[1] for r in rows], pa.int64()),
            "length": pa.array([len(x) for x in ids], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            "doc_tokens": pa.array([r[3] for r in rows], pa.int64()),
            "sequence_id": pa.array([r[4] for r in rows], pa.int64()),
            "offset": pa.array([r[5] for r in rows], pa.int64()),
        }
        if keep_ids:
            columns["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = json_encoder(path, pattern)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        like = None
        for block in text_blocks(batches, TEXT_BYTES):
            ids, at = encoder(block)
            like = block.ids.type
            for doc, i, j in zip(block.ids.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packer.add(doc, np.append(ids[i:j], np.uint32(end_id)).astype("<u4", copy=False))
            yield batch(packer.out, like)
            packer.out = []
        if like is not None:
            packer.finish()
            yield batch(packer.out, like)

    return texts.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * keep_ids)
