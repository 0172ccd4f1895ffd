"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once. Its tokens' spans and its sections' spans, both sorted, are joined as intervals by binary
search. A token that crosses a boundary is allocated by an explicit rule: "start" gives it to the section that holds its
first byte; "majority" to the section that holds most of its bytes, on ties the earlier one.

Sections are the document's lines unless a column of (start, end) character spans is named; a line feed belongs to the
line that it ends. Tokens of no section count to section -1. Cases: a null text is empty; an empty text has one empty
line, with no tokens; null sections are no sections; a null section, or one with a null bound, is an empty one where the section before it
ends; sections must be sorted and must not overlap (an error otherwise);
repeated rows give repeated results; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import Block, ragged, text_blocks
from morpholake.llm.bpe import TEXT_BYTES, rank_encoder

RULES = ("start", "majority")


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all lines in the block, and the row of each."""
    raw = np.frombuffer(block.data, dtype=np.uint8)
    after = np.flatnonzero(raw == 10) + 1
    size = np.diff(block.offsets)
    ends_own = np.isin(block.offsets[1:], after) & (size > 0)  # a final line feed ends the last line
    row = np.searchsorted(block.offsets, after - 1, side="right") - 1
    begin = np.concatenate((block.offsets[:-1], after[~np.isin(after, block.offsets[1:][ends_own])]))
    owner = np.concatenate((np.arange(len(size)), row[~np.isin(after, block.offsets[1:][ends_own])]))
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.append(begin[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, dtype=bool)
    end[last] = block.offsets[1:][owner[last]]
    return begin, end, owner


def _given(block: Block, sections: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of given character spans, and the row of each."""
    raw = np.frombuffer(block.data, dtype=np.uint8)
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first = np.searchsorted(chars, block.offsets)
    rows = []
    for x in sections.to_pylist():
        spans, end = [], 0
        for s in x or []:
            whole = s is not None and s["start"] is not None and s["end"] is not None
            start, end = (s["start"], s["end"]) if whole else (end, end)
            spans.append((start, end))
        rows.append(spans)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    spans = np.array([s for x in rows for s in x], dtype=np.int64).reshape(-1, 2)
    limit = np.diff(first)[owner]
    spans = np.clip(spans, 0, limit[:, None])
    same = owner[1:] == owner[:-1]
    if (spans[:, 0] > spans[:, 1]).any() or (same & (spans[1:, 0] < spans[:-1, 1])).any():
        raise ValueError("sections must be sorted and must not overlap")
    begin, end = chars[first[owner] + spans[:, 0]], chars[first[owner] + spans[:, 1]]
    return begin, end, owner


def section_tokens(block: Block, ids: np.ndarray, at: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, rule: str) -> tuple[np.ndarray, ...]:
    """Sections' tokens and crossing tokens, and each row's tokens outside of all sections.

    begin, end, owner: sections in order; ids, at: tokens of the block; size: bytes of each id.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    stop = np.cumsum(size[ids])
    start = stop - size[ids]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not len(begin):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.diff(at)
    # Empty sections hold no token; among the others, starts and ends both increase.
    full = np.flatnonzero(end > begin)
    b, e = begin[full], end[full]
    first = np.searchsorted(e, start, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(b, stop, side="left") - 1  # the last that begins before its end
    touched = np.maximum(last - first + 1, 0)
    token = np.repeat(np.arange(len(ids)), touched)
    section = first[token] + ragged(touched)
    overlap = np.minimum(e[section], stop[token]) - np.maximum(b[section], start[token])
    if rule == "majority":
        order = np.lexsort((section, -overlap, token))
    else:
        order = np.lexsort((section, token))
        order = order[b[section[order]] <= start[token[order]]]
    chosen = order[np.concatenate(([True], token[order][1:] != token[order][:-1]))] if len(order) else order
    tokens = np.zeros(len(begin), dtype=np.int64)
    np.add.at(tokens, full[section[chosen]], 1)
    inside = np.bincount(token, weights=overlap, minlength=len(ids)).astype(np.int64)
    crossing = np.zeros(len(begin), dtype=np.int64)
    cross = chosen[(touched[token[chosen]] > 1) | (inside[token[chosen]] < size[ids][token[chosen]])]
    np.add.at(crossing, full[section[cross]], 1)
    outside = np.ones(len(ids), dtype=bool)
    outside[token[chosen]] = False
    return tokens, crossing, np.bincount(row[outside], minlength=len(at) - 1)


def attribute_tokens(df: DataFrame, path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing), one row per section; no shuffle.

    n_crossing: those of n_tokens that reach beyond the section. Section -1 appears where a row has tokens outside all.
    """
    kept = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    if sections_col:
        kept.append(F.col(sections_col).cast("array<struct<start:bigint,end:bigint>>").alias("sections"))
    rows = df.select(*kept)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = rank_encoder(path, pattern)
        for batch in batches:
            done = 0
            for block in text_blocks(iter([batch]), TEXT_BYTES):
                ids, at = encoder(block)
                n = len(block.ids)
                begin, end, owner = _given(block, batch.column(2).slice(done, n)) if sections_col else _lines(block)
                done += n
                tokens, crossing, outside = section_tokens(block, ids, at, decoder.size, begin, end, owner, rule)
                raw = np.frombuffer(block.data, dtype=np.uint8)
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                number = ragged(np.bincount(owner, minlength=n))
                rest = np.flatnonzero(outside)
                base = chars[block.offsets[:-1]]
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.concat_arrays([block.ids.take(pa.array(owner)), block.ids.take(pa.array(rest))]),
                    "section": pa.array(np.concatenate((number, np.full(len(rest), -1)))),
                    "start_char": pa.concat_arrays([pa.array(chars[begin] - base[owner]), none]),
                    "end_char": pa.concat_arrays([pa.array(chars[end] - base[owner]), none]),
                    "n_tokens": pa.array(np.concatenate((tokens, outside[rest])).astype(np.int64)),
                    "n_crossing": pa.array(np.concatenate((crossing, np.zeros(len(rest), dtype=np.int64)))),
                })

    return rows.mapInArrow(run, f"doc_id {kind}, section bigint, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint")
