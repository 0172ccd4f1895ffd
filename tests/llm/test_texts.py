"""Personal data, toxicity, tool calls, language-model scores and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from morpholake.llm import chat, lm, pii, toxicity
from morpholake.llm.queries import ORACLE_SQL, QUERIES
from test_whole_near import survivors

DATA = "/root/testdata/sf0.001"


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rnd = random.Random(0)
    parts = ["a", "b.c", "@", ".", "1", "22", "300", "4111111111111111", " ", "-", "+", "(5)", "x@y.z", "é", "10.0.0.1", "00000.1.2.3", "\n", "378282246310005", "+1 (555) 010-9999"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE] == base_spans(text), text
    for long in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000):
        pii.find_spans(long)


def test_added_spans_and_redaction():
    far = " " + "word " * 20
    text = far.join(["Bank transfer to IBAN GB82 WEST 1234 5698 7654 32.", "Call 555-010-9999.", "Order 555-010-9998.", "SSN 219-09-9999", "x@y.zz"])
    kinds = Counter(s.kind for s in pii.find_spans(text))
    assert kinds == {"email": 1, "iban": 1, "phone_local": 1, "ssn": 1}
    assert "GB82" not in (red := pii.redact(text, pii.find_spans(text))) and "<iban>" in red and "555-010-9998" in red
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    near = [s.score for t in ("card 4111111111111111", "order 4111111111111111") for s in pii.find_spans(t)]
    assert near[0] > near[1]


def test_pii_over_rows(docs, no_docs):
    got = pii.find_pii(docs).collect()
    assert sorted(r["redacted"] for r in got) == sorted(pii.redact(t, pii.find_spans(t)) for t in ((r["text"] or "") for r in docs.collect()))
    red = pii.redacted(docs)
    assert red.schema == docs.schema and {r["doc_id"]: r["n_chars"] for r in red.collect()}[2] is None
    assert pii.find_pii(no_docs).count() == 0 and pii.redacted(no_docs).count() == 0


def test_toxicity_holds_out_and_learns(spark, docs, no_docs):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(1200):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 60))]
        toxic = rnd.random() < 0.2
        if toxic:
            words += [rnd.choice(["idiot", "scum", "quxlo" + rnd.choice(vocabulary)]) for _ in range(2)]
        if rnd.random() < (0.6 if toxic else 0.1):
            words.append(rnd.choice(["muslims", "women", "immigrants"]))
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (5000, ""), (5001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model, plain = toxicity.train(df, labels), toxicity.train(df, labels, weight=0.0)
    truth = dict(marks)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    found = [out[i] >= toxicity.THRESHOLD for i in held]
    assert np.mean([f == truth[i] for f, i in zip(found, held, strict=True)]) > 0.97
    assert out[5000] == out[5001] < toxicity.THRESHOLD
    logit = lambda m, t: (lambda s: math.log(s / (1 - s)))(float(toxicity.block_scores(toxicity._block([t]), m)[0]))
    shift = lambda m: abs(logit(m, "w1 w2 women w3") - logit(m, "w1 w2 girls w3")) + abs(logit(m, "w1 w2 muslims w3") - logit(m, "w1 w2 sikhs w3"))
    assert shift(model) < 0.5 * shift(plain)
    again = {r["doc_id"]: r[1] for r in df.select("doc_id", toxicity.held_out(df["doc_id"])).collect()}
    assert all(again[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(no_docs, model).count() == 0
    kept = toxicity.kept(df, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in out.items() if s < toxicity.THRESHOLD} and toxicity.kept(docs, model).schema == docs.schema
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["score"] < 0.01 for r in toxicity.score(df, toxicity.train(df, few)).collect()} == {True}


def shifts(model, texts):
    """Mean change of the logit when a group's name in a text is swapped, over all names of all lines."""
    names = toxicity.Names()
    one = [f"{t} {n}" for t in texts for n in names.every]
    logit = lambda x: (lambda s: np.log(s / (1 - s)))(toxicity.block_scores(toxicity._block(x), model))
    return float(np.mean(np.abs(logit(one) - logit([names.swapped(t, 1) for t in one]))))


def test_penalty_acts_on_documents(spark):
    """The driver's documents name no group; fitted with names added, the penalty changes the model and swaps change scores less."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, weight=0.0)
    names = {int(toxicity.features(toxicity._block([n]))[0][0]) for n in ("muslim", "women", "refugees", "young")}
    assert names & set(model.features.tolist()) and shifts(plain, ["the", "idiot"]) > 0
    assert shifts(model, ["the", "idiot"]) < 0.5 * shifts(plain, ["the", "idiot"])
    out = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    hits = sum(out[i] for i, y in truth.items() if y)
    assert hits >= 0.75 * sum(truth.values()) and hits >= 0.9 * sum(out[i] for i in truth)


def test_toxicity_sample_is_bounded(spark):
    """Repeated ids are fitted once, with the shortest text; very long texts beyond the bytes are left out of the fit, not of the scores."""
    rows = [(i, ("idiot scum " if i % 4 == 0 else "good day ") + f"w{i % 7}") for i in range(400)]
    more = [(i, t + " and more") for i, t in rows[:40]] + [(4, "idiot " * 100_000)] * 3 + [(1000, "good " * 500_000)]
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1000, 1)], "doc_id long, toxic int")
    model, same = toxicity.train(df, labels, size=1 << 20), toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert (model.features == same.features).all() and np.allclose(model.weights, same.weights)
    assert toxicity.score(df, model).count() == len(rows) + len(more)
    assert len(toxicity.train(df, labels, rows=5, size=0).features) == 0


SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False), "c": ("array", False), "d": ("number", False), "e": ("boolean", False), "o": ("object", False)}}


def test_tool_calls(spark):
    rows = [
        ("k", 1, "x", "f", '{"b": "t", "a": 1}', ["z"]), ("k", 2, "y", "f", '{"a": 1.5, "q": 0}', ["x", "nowhere"]), ("k", 3, "z", "g", "{}", None), ("k", 9, "x", "f", '{"a": 2}', None),
        ("k", 4, "p", "f", None, ["q"]), ("k", 5, "q", "f", "[1]", ["p"]), ("k", 6, "r", "f", '{"a": null}', ["q"]), (None, 1, "x", "f", '{"a": 1}', None), ("m", 1, None, "f", '{"a": 1}', None),
        ("m", 2, "n", "f", '{"a": 1, "c": [1], "d": 2, "e": true, "o": {}}', ["n0"]), ("m", 1, "n0", "f", '{"a": 1, "c": {}, "d": "2", "e": 1, "o": []}', None),
    ]
    calls = spark.createDataFrame(rows, "conv_id string, turn int, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("k", 2, "x", "two"), ("k", 1, "x", "one"), ("k", 7, "w", "lost"), ("k", 8, None, "none")], "conv_id string, turn int, call_id string, content string")
    got = {(r["conv_id"], r["call_id"], r["name"]): r for r in chat.link_tool_calls(calls, results, SCHEMAS).collect()}
    assert len(got) == 12
    x = got["k", "x", "f"]
    assert (x["n_calls"], x["n_results"], x["result_turn"], x["level"], x["valid"]) == (2, 2, 1, 1, True)
    assert x["json"] == '{"arguments":{"a":1,"b":"t"},"call_id":"x","level":1,"name":"f","result":"one","turn":1}'
    errors = {k[:2]: r["errors"] for k, r in got.items()}
    assert errors["k", "y"] == ["type:a", "unknown:q"] and got["k", "y", "f"]["level"] == 2 and errors["k", "z"] == ["tool"]
    assert errors["k", "p"] == ["circle", "json"] == errors["k", "q"] and errors["k", "r"] == ["circle", "missing:a"]
    assert errors[None, "x"] == ["id"] == errors["m", None] and errors["k", "w"] == ["orphan"] and errors["k", None] == ["id", "orphan"]
    assert errors["m", "n"] == [] and errors["m", "n0"] == ["type:c", "type:d", "type:e", "type:o"] and got["m", "n", "f"]["level"] == 1
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0
    plan = chat.link_tool_calls(calls, results, SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_scores(rows, order, alpha=lm.ALPHA):
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    grams = lambda t: Counter(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    every, out = sum((grams(t) for _, t in texts), Counter()), []
    total = sum(len(t) for _, t in texts)
    for i, t in texts:
        own, score, back = grams(t), 0.0, 0
        c = lambda g: every[g] - own[g]  # noqa: B023, E731
        for k in range(len(t)):
            h = tuple(t[max(0, k - order + 1) : k])
            while h and not c((*h, t[k])):
                h, back, score = h[1:], back + 1, score + math.log(alpha)
            score += math.log(c((*h, t[k])) / c(h) if h else max(c((t[k],)), 0.5) / max(total - len(t), 1))
        out.append((str(i), len(t), back, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("order", "unit", "chars"), [(1, lm.UNIT, lm.BUCKET_CHARS), (2, 200, 200), (3, lm.UNIT, lm.BUCKET_CHARS), (3, 200, 40), (5, 3000, 2000)])
def test_lm_scores(spark, docs, no_docs, monkeypatch, order, unit, chars):
    """Of one unit and of many, of few buckets and of more than a unit has entries."""
    monkeypatch.setattr(lm, "UNIT", unit)
    monkeypatch.setattr(lm, "BUCKET_CHARS", chars)
    rnd = random.Random(2)
    more = [(50 + i, " ".join(rnd.choice(["a", "b", "C", "d" * 40, "é"]) for _ in range(rnd.randrange(700)))) for i in range(25)]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_backoff"], round(r["log_score"], 6)) for r in lm.score_documents(df, order=order).collect())
    for a, b in zip(got, brute_scores([(r["doc_id"], r["text"]) for r in df.collect()], order), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-5)
    if order == 3:
        assert lm.score_documents(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    plain = lambda df: sorted(df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None), key=str)
    assert [tuple(map(str, r)) for r in plain(ours.astype(theirs.dtypes.to_dict()))] == [tuple(map(str, r)) for r in plain(theirs)]


def test_pipeline(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], DATA).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i, t in rows.items() if toxicity.block_scores(toxicity._block([t]), model)[0] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in frames[1].collect()} == clean and frames[1].columns == docs.columns
    ordered = sorted(clean)
    single = {ordered[i] for i in survivors([rows[i] for i in ordered])}
    assert {r["doc_id"] for r in frames[2].collect()} == single and len(single) < len(clean) and frames[2].columns == docs.columns
    for r in frames[3].collect():
        expected = pii.redact(rows[r["doc_id"]], pii.find_spans(rows[r["doc_id"]]))
        assert r["text"] == expected and r["n_chars"] == len(expected) and not base_spans(r["text"])
    assert frames[3].columns == docs.columns
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    length = {r["doc_id"]: len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in frames[3].collect()}
    got = Counter()
    for r in frames[4].collect():
        got[r["doc_id"]] += r["length"]
    assert got == length
    assert corpus_pipeline.run(spark, DATA).count() == frames[4].count()
