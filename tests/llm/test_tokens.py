"""Encoding, attribution and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from morpholake.llm import attribution, bpe, packing

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "'s", "'", "12", "\xa0", "　", "日本", "!", "\r\n", "🙂", "\x1c", "\x0b", "<|endoftext|>", " word", "Ω"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encoder_is_the_library(library, block):
    _, decoder = bpe.rank_encoder(RANKS, P.PATTERN)
    short = bpe.Encoder(library.encode_ordinary, decoder.size, chunk=40, overlap=12)  # many chunks, and overlaps without a common boundary
    rnd = random.Random(1)
    for n in range(400):
        texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(120))) for _ in range(4)]
        texts[1] = "x" * rnd.randrange(200) * (n % 5 == 0) + texts[1]
        ids, at = short(block(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t)
            assert decoder(ids[at[i] : at[i + 1]]) == t.encode()


def test_json_encoder_is_the_library(block):
    own, (encoder, _) = Tokenizer.from_file(JSON), bpe.json_encoder(JSON, P.PATTERN)
    rnd = random.Random(2)
    for _ in range(200):
        texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(60))) for _ in range(4)]
        ids, at = encoder(block(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids


def test_encode_texts(docs, no_docs, library):
    rows = bpe.encode_texts(docs, RANKS, P.PATTERN)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    expected = sorted(((str(i), len(x := library.encode_ordinary(t)), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows.collect()) == expected
    back = bpe.decode_ids(rows, RANKS)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(t for _, t in texts)
    assert bpe.encode_texts(no_docs, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(docs, no_docs, library, rule, spark):
    def brute(text, spans):
        at, out = 0, [0] * len(spans)
        outside = 0
        for size in [len(b) for b in library.decode_tokens_bytes(library.encode_ordinary(text))]:
            over = [max(0, min(at + size, e) - max(at, s)) for s, e in spans]
            hit = [i for i, (s, e) in enumerate(spans) if s <= at < e] if rule == "start" else [over.index(max(over))] if spans and max(over) else []
            if hit:
                out[hit[0]] += 1
            else:
                outside += 1
            at += size
        return out, outside

    def lines(text):
        data, spans, start = text.encode(), [], 0
        for i, c in enumerate(data):
            if c == 10:
                spans.append((start, i + 1))
                start = i + 1
        return [*spans, (start, len(data))] if start < len(data) or not spans else spans

    got = {}
    for r in attribution.attribute_tokens(docs.where("doc_id <> 7"), RANKS, P.PATTERN, rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
    for r in docs.where("doc_id <> 7").collect():
        counts, _ = brute(r["text"] or "", lines(r["text"] or ""))
        assert [got[r["doc_id"]][i] for i in range(len(counts))] == counts
    assert attribution.attribute_tokens(no_docs, RANKS, P.PATTERN).count() == 0
    given = spark.createDataFrame([(1, "hello wörld again", [(0, 3), (7, 9), (9, 12)]), (2, "abc", None), (3, "héé", [])], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in attribution.attribute_tokens(given, RANKS, P.PATTERN, rule, sections_col="s").collect()}
    for i, text, spans in ((1, "hello wörld again", [(0, 3), (7, 9), (9, 12)]), (2, "abc", []), (3, "héé", [])):
        to_bytes = lambda k: len(text[:k].encode())  # noqa: B023, E731
        counts, outside = brute(text, [(to_bytes(a), to_bytes(b)) for a, b in spans])
        assert [got[i, k] for k in range(len(spans))] == counts and got.get((i, -1), 0) == outside


def test_null_sections(spark):
    """A null section, or one with a null bound, keeps its number and holds nothing."""
    kind = "doc_id long, text string, s array<struct<start:long,end:long>>"
    given = spark.createDataFrame([(1, "one two three", [None, (0, 4), (None, 9), (4, None), (4, 13)]), (None, None, [None, (0, 5)])], kind)
    got = {(r["doc_id"], r["section"]): (r["start_char"], r["end_char"], r["n_tokens"]) for r in attribution.attribute_tokens(given, RANKS, P.PATTERN, sections_col="s").collect()}
    assert [got[1, k][:2] for k in range(5)] == [(0, 0), (0, 4), (4, 4), (4, 4), (4, 13)]
    assert got[1, 0][2] == got[1, 2][2] == got[1, 3][2] == 0 < got[1, 1][2] and (got[None, 0], got[None, 1]) == ((0, 0, 0), (0, 0, 0))


def check_pieces(rows, tokens, window):
    seen, at = {}, {}
    for r in rows:
        ids = tokens[r["doc_id"], r["doc_tokens"]]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    return seen, padding


def test_packing(docs, no_docs):
    own = Tokenizer.from_file(JSON)
    for window in (2048, 16):
        rows = packing.pack_texts(docs, JSON, P.PATTERN, window).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        tokens = {(i, len(x)): np.array(x, dtype="<u4") for i, t in texts for x in [own.encode(t, add_special_tokens=False).ids + [1]]}
        seen, padding = check_pieces(rows, tokens, window)
        assert padding == 0 and set(seen) == set(tokens)
        for (i, n), pieces in seen.items():
            times = sum(1 for j, t in texts if j == i)
            assert sum(length for _, length in pieces) == n * times
    assert packing.pack_texts(no_docs, JSON, P.PATTERN).count() == 0


def test_level_keeps_the_sum_of_squares_least():
    p, rnd = packing.Packer(64, 0), random.Random(3)
    for i in range(500):
        size = rnd.randrange(1, 64)
        counts = p.count[1:64].copy()
        options = {}
        for h in [0, *(np.flatnonzero(p.count[:64]).tolist())]:
            if h + size <= 64:
                after = counts.copy()
                if h:
                    after[h - 1] -= 1
                if h + size < 64:
                    after[h + size - 1] += 1
                options[h] = int((after**2).sum())
        assert options[p.level(size)] == min(options.values())
        p.add(i, np.arange(size, dtype="<u4"))
    p.finish()
    assert not p.open and sum(len(r[2]) for r in p.out) == sum(max(r[1] + len(r[2]) for r in p.out if r[0] == i) for i in range(500))
