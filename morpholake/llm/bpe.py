"""Byte-level BPE encoding by overlapping chunks, and decoding.

Long texts are cut into overlapping chunks. All chunks of a block are pre-tokenised side by side in one vectorised pass;
each chunk knows nothing of the others. Two neighbours are stitched at the first boundary inside their overlap that
both found: from there on they agree. A pair without such a boundary is pre-tokenised again as one longer chunk. The
pieces between boundaries are then encoded by the tokenizer library, each distinct piece of a block once.

Pieces: a boundary lies before every run of white space that follows something else, and before the last character of
such a run when text follows. Both are boundaries of the pattern's matches whatever the context, since no match holds
anything but white space before white space, and `\\s+(?!\\S)` gives back exactly one character before text. A piece by
itself is split by the pattern as it is in its text. White space outside ASCII could join such a run, so a text that
holds any is one piece.

Cases: a null text is empty; an empty text has no ids; repeated rows give repeated results; a table without rows gives
none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from morpholake.llm.blocks import IS_SPACE, LANE_BYTES, Block, id_and_text, lanes, mix, ragged, text_blocks

CHUNK_BYTES, OVERLAP_BYTES = 1 << 15, 1 << 10
#: Bytes of text encoded at once: more texts share more pieces, and take about 25 times as much memory.
TEXT_BYTES = 2 << 20
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_WIDE_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")


def boundaries(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sorted starts of pieces in texts that lie end to end and begin at begins (increasing)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    space = IS_SPACE[data]
    head = np.zeros(n + 1, dtype=bool)
    head[begins] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, space[:-1]
    text_next = np.zeros(n, dtype=bool)
    text_next[:-1] = ~space[1:] & ~head[1:n]
    return np.flatnonzero(head[:n] | (space & (~before | text_next)))


def stitched(data: bytes, begin: int, end: int, chunk: int, overlap: int) -> np.ndarray:
    """Boundaries of data[begin:end] from its chunks, each pre-tokenised alone."""
    if end - begin <= chunk:
        return boundaries(np.frombuffer(data, dtype=np.uint8)[begin:end], np.zeros(1, dtype=np.int64)) + begin
    step = chunk - overlap
    cuts = list(range(begin, max(end - overlap, begin + 1), step))
    spans = [(a, min(a + chunk, end)) for a in cuts]
    side_by_side = b"".join(data[a:b] for a, b in spans)
    heads = np.concatenate(([0], np.cumsum([b - a for a, b in spans])[:-1]))
    found = boundaries(np.frombuffer(side_by_side, dtype=np.uint8), heads)
    parts = np.split(found, np.searchsorted(found, heads[1:]))
    parts = [p - h + a for p, h, (a, _) in zip(parts, heads, spans, strict=True)]
    out, (_, last_end), kept = [], spans[0], parts[0]
    for (a, b), own in zip(spans[1:], parts[1:], strict=True):
        # A chunk's own first position is no evidence, nor is what it says of its last byte, whose follower it lacks.
        both = np.intersect1d(kept[(kept > a) & (kept < last_end - 1)], own[(own > a) & (own < last_end - 1)], assume_unique=True)
        if len(both):
            out.append(kept[kept < both[0]])
            kept = own[own >= both[0]]
        else:
            again = int(kept[kept <= a][-1]) if len(kept[kept <= a]) else begin
            out.append(kept[kept < again])
            kept = boundaries(np.frombuffer(data, dtype=np.uint8)[again:b], np.zeros(1, dtype=np.int64)) + again
        last_end = b
    return np.concatenate([*out, kept])


class Encoder:
    """ids of many texts at once.

    encode is the tokenizer library's own function from a text to its ids, and size the byte length of each id. A
    block's distinct pieces are encoded in one call, as one text: no match of the pattern reaches over from one piece
    to the next. rare, if given, encodes pieces with characters from U+0380 on, one at a time, and texts that hold one
    of marks (special tokens' strings), each as a whole.
    """

    def __init__(self, encode: Callable[[str], list[int]], size: np.ndarray, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, rare: Callable[[str], list[int]] | None = None, marks: tuple[bytes, ...] = ()):
        self.encode, self.size, self.chunk, self.overlap, self.rare, self.marks = encode, size, chunk, overlap, rare, marks
        self.newline = len(encode("\n"))

    def _starts(self, block: Block) -> np.ndarray:
        data, at = block.data, block.offsets
        size = np.diff(at)
        raw = np.frombuffer(data, dtype=np.uint8)
        whole = np.zeros(len(size), dtype=bool)
        if any(lead in data for lead in _WIDE_LEADS) and _WIDE_SPACE.search(data.decode("utf-8", "surrogatepass")):
            whole = np.array([bool(_WIDE_SPACE.search(data[a:b].decode("utf-8", "surrogatepass"))) for a, b in zip(at[:-1], at[1:], strict=True)])
        if any(mark in data for mark in self.marks):
            whole |= np.array([any(mark in data[a:b] for mark in self.marks) for a, b in zip(at[:-1], at[1:], strict=True)])
        long = (size > self.chunk) & ~whole
        if not (whole.any() or long.any()):
            return boundaries(raw, at[:-1][size > 0])
        rows = np.flatnonzero(size > 0)
        out, i = [], 0
        while i < len(rows):  # runs of short texts in one pass each, long ones by chunks
            r = rows[i]
            if whole[r]:
                out.append(at[r : r + 1])
            elif long[r]:
                out.append(stitched(data, int(at[r]), int(at[r + 1]), self.chunk, self.overlap))
            else:
                j = i
                while j + 1 < len(rows) and not (whole[rows[j + 1]] or long[rows[j + 1]]):
                    j += 1
                a, b = int(at[r]), int(at[rows[j] + 1])
                out.append(boundaries(raw[a:b], at[rows[i : j + 1]] - a) + a)
                i = j
            i += 1
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def _pieces(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of these pieces end to end, and pieces + 1 positions in them."""
        raw = np.frombuffer(data, dtype=np.uint8)
        length = end - start
        leads = IS_SPACE[raw[start]]
        counted = np.concatenate(([0], np.cumsum(IS_SPACE[raw])))
        joined = (counted[end] - counted[start] == leads) & (length > leads)  # white space at most as the first character
        if self.rare is not None or any(lead in data for lead in _WIDE_LEADS):
            high = np.concatenate(([0], np.cumsum(raw >= (0xCE if self.rare else 0xC2))))
            high = high[end] > high[start]
            if self.rare is None:  # wide white space at a piece's end would join with what follows
                high &= np.fromiter((bool(_WIDE_SPACE.search(data[a:b].decode("utf-8", "surrogatepass"))) if h else False for a, b, h in zip(start.tolist(), end.tolist(), high.tolist(), strict=True)), dtype=bool, count=len(start))
            joined &= ~high
        if any(mark in data for mark in self.marks):
            joined &= ~np.array([any(mark in data[a:b] for mark in self.marks) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=bool)
        count = np.zeros(len(start), dtype=np.int64)
        alone: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~joined).tolist():
            text = data[start[i] : end[i]].decode("utf-8", "surrogatepass")
            alone[i] = np.array((self.rare or self.encode)(text), dtype="<u4")
            count[i] = len(alone[i])
        # A piece that begins without white space gets a line feed, which is a match of its own, in front.
        many = np.flatnonzero(joined)
        bare = ~leads[many]
        put = np.cumsum(length[many] + bare)
        text = np.full(put[-1] if len(many) else 0, 10, dtype=np.uint8)
        within = ragged(length[many])
        text[np.repeat(put - length[many], length[many]) + within] = raw[np.repeat(start[many], length[many]) + within]
        got = np.array(self.encode(text.tobytes().decode("utf-8")), dtype="<u4")
        piece_end = np.searchsorted(np.cumsum(self.size[got]), put, side="left") + 1
        piece_begin = np.concatenate(([0], piece_end))[:-1] + self.newline * bare
        count[many] = piece_end - piece_begin
        at = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(at[-1], dtype="<u4")
        each = count[many]
        ids[np.repeat(at[many], each) + ragged(each)] = got[np.repeat(piece_begin, each) + ragged(each)]
        for i, x in alone.items():
            ids[at[i] : at[i + 1]] = x
        return ids, at

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and rows + 1 positions in them."""
        data = block.data + bytes(LANE_BYTES)
        start = self._starts(block)
        if not len(start):
            return np.zeros(0, dtype="<u4"), np.zeros(len(block.offsets), dtype=np.int64)
        end = np.append(start[1:], len(block.data))
        length = end - start
        k = lanes(data, start, length, LANE_BYTES // 8)
        key = mix(mix(mix(k[0]) ^ k[1]) ^ k[2]) + length.astype(np.uint64)
        order = np.argsort(key)
        new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        one, group = order[new], np.empty(len(key), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        # Long pieces, and any that share only the hash with the first of their group, are groups of their own.
        odd = np.flatnonzero(np.logical_or.reduce([x != x[one][group] for x in (*k, length)]) | (length > LANE_BYTES))
        group[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate((one, odd))
        ids, at = self._pieces(data, start[one], end[one])
        each = np.diff(at)[group]
        before = np.concatenate(([0], np.cumsum(each)))
        return ids[np.repeat(at[:-1][group], each) + ragged(each)], before[np.searchsorted(start, block.offsets)]


class Decoder:
    """Bytes of ids: each id's raw bytes, end to end."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens, default=-1) + 1
        self.size = np.array([len(tokens.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.store = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), dtype=np.uint8)

    def __call__(self, ids: np.ndarray, piece: int = 1 << 20) -> bytes:
        out = []
        for i in range(0, len(ids), piece):
            part = ids[i : i + piece]
            each = self.size[part]
            out.append(self.store[np.repeat(self.begin[part], each) + ragged(each)].tobytes())
        return b"".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[Encoder, Decoder]:
    """Encoder and decoder for a tiktoken rank file; one of each per worker."""
    import tiktoken

    ranks = read_ranks(path)
    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    decoder = Decoder({b: a for a, b in ranks.items()})
    return Encoder(library.encode_ordinary, decoder.size, chunk, overlap), decoder


def _raw_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def json_encoder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder that give the ids of the tokenizer in a JSON file (byte-level BPE, special tokens' strings read as special tokens)."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    byte = _raw_bytes()
    ranks = {bytes(byte[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    library = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer.from_file(path)
    decoder = Decoder({i: b for b, i in ranks.items()} | {i: x.encode() for x, i in special.items()})
    return Encoder(library.encode_ordinary, decoder.size, rare=lambda text: own.encode(text, add_special_tokens=False).ids, marks=tuple(x.encode() for x in special)), decoder


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """(doc_id, ids array<long> if keep_ids, n_tokens, ids_sha256, decoded_sha256) for each row of df; no shuffle.

    path: a rank file that every executor can read. The digests are of the ids as little-endian unsigned 32-bit
    integers, and of the bytes that decoding them gives.
    """
    texts = id_and_text(df, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = rank_encoder(path, pattern, chunk, overlap)
        for block in text_blocks(batches, TEXT_BYTES):
            ids, at = encoder(block)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            view, back = memoryview(np.ascontiguousarray(ids)).cast("B"), memoryview(decoder(ids))
            ends = np.concatenate(([0], np.cumsum(decoder.size[ids])))[at] if len(ids) else np.zeros(len(at), dtype=np.int64)
            columns = {
                "doc_id": block.ids,
                "n_tokens": pa.array(np.diff(at)),
                "ids_sha256": pa.array([hashlib.sha256(view[4 * i : 4 * j]).hexdigest() for i, j in spans]),
                "decoded_sha256": pa.array([hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
            }
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * keep_ids)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) from rows of ids; null ids decode to no bytes."""
    from pyspark.sql import functions as F

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<bigint>"), F.array().cast("array<bigint>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({b: a for a, b in read_ranks(path).items()})
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array([decoder(np.array(x.as_py(), dtype=np.int64)) for x in batch.column(1)], pa.binary())})

    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary")
