"""The queries' own columns over a whole table against brute force, and odd rows through the pipeline's stages."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_near import fingerprint, shingles, united
from test_texts import base_spans
from test_tokens import JSON, RANKS, check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from morpholake.llm import bpe, pii
from morpholake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet' order by doc_id").fetchall())


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, DATA).collect()}


def digest(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_op1(spark, texts, library):
    got = rows(spark, "op1_byte_bpe")
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(t.encode()))
    assert got.keys() == texts.keys()


def test_op2(spark, texts):
    for i, r in rows(spark, "op2_toxicity").items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op3(spark, texts, library):
    """Every token is of one section; sections are the lines."""
    got = {}
    for r in QUERIES["op3_token_counts"](spark, DATA).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert sum(r["n_tokens"] for r in got[i]) == len(library.encode_ordinary(t))
        assert "".join(t[r["start_char"] : r["end_char"]] for r in sorted(got[i], key=lambda r: r["section"])) == t


def test_op6(spark, texts):
    """The edited texts exactly; likenesses by brute force, exact up to 256 shingles and close beyond."""
    got, ids = rows(spark, "op6_fingerprints"), list(texts)
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, following, r = texts[i], texts[j], got[i]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == digest(edited.encode())
        a, b, c = (set(shingles(x, 5)) for x in (t, edited, following))
        for value, other in ((r["near_edited"], b), (r["near_next"], c)):
            assert value == pytest.approx(share(a, other), abs=1e-9 if len(a | other) <= 256 else 0.15)
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert got.keys() == texts.keys()


def test_op7(spark, texts):
    got, ids = rows(spark, "op7_simhash"), list(texts)
    prints = [fingerprint(t) for t in texts.values()]
    root = united(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    for k, i in enumerate(ids):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[k]:016x}", ids[root[k]])
    assert got.keys() == texts.keys()


def test_op8(spark, texts):
    own = Tokenizer.from_file(JSON)
    tokens = {(i, len(x)): np.array(x, dtype="<u4") for i, t in texts.items() for x in [own.encode(t, add_special_tokens=False).ids + [1]]}
    found = QUERIES["op8_packing"](spark, DATA).collect()
    seen, padding = check_pieces(found, tokens, 2048)
    assert seen.keys() == tokens.keys() and padding <= 0.02 * sum(n for _, n in tokens)
    for (_, n), pieces in seen.items():
        end = 0
        for start, length in sorted(pieces):
            assert start == end and length > 0
            end += length
        assert end == n


def test_op9(spark, texts):
    got = rows(spark, "op9_pii")
    for i, t in texts.items():
        base, r = base_spans(t), got[i]
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in base)
        told = [f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (pii.BASE.index(s[0]), s[1]))]
        assert r["base_sha256"] == digest(",".join(told).encode())
        assert set(told) <= set(r["spans"].split(","))
    assert got.keys() == texts.keys()


def test_op4_and_op10_have_no_other_rows(spark):
    vectors = duckdb.sql(f"select count(*), count(distinct vec_id) from '{DATA}/embeddings.parquet'").fetchall()[0]
    assert len(rows(spark, "op4_embedding_dedup", "vec_id")) == vectors[1] == vectors[0]
    assert all(math.isfinite(r["log_score"]) for r in rows(spark, "op10_lm_scores").values())


def test_stages_of_odd_rows(spark, docs, no_docs):
    """Nulls, empty and long texts, ties, repeated rows and clashing names pass through every stage; so does an empty table."""
    for start in (docs, no_docs):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            before, frame = frame, stage(spark, frame, DATA)
            if name != "packing":
                assert frame.columns == docs.columns
            else:
                assert {r["doc_id"] for r in frame.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.dedup_stage(spark, docs, DATA).collect())
    assert kept == sorted(["1", "2", "4", "5", "7", "None"])
