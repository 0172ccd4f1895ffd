"""SimHash, sketches, vectors and components against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from morpholake.llm import graph, hnsw, simhash, sketch


def united(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text, n):
    w = text.encode().lower().split()
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(300, i) for i in range(301, 420)]
    some = [(int(a), int(b)) for a, b in rng.integers(0, 90, (40, 2))]
    pairs = [*chain, *star, *some, *some]
    expected = united(500, pairs)
    df = spark.createDataFrame([*pairs, (7, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: expected[x] for x in linked}
    assert graph.components(df.limit(0)).count() == 0


def fingerprint(text):
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if len(h) else 0


def test_simhash(spark, docs, no_docs):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bbb", "cçc", "A" * 40, "ddddddddd"], size=k)) for k in rng.integers(1, 600, 60)]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = df.collect()
    prints = [fingerprint(r["text"] or "") for r in rows]
    order = {i: n for n, i in enumerate(sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}))}
    known = [(order[r["doc_id"]], p) for r, p in zip(rows, prints, strict=True) if r["doc_id"] is not None]
    root = united(len(order), [(a, b) for a, p in known for b, q in known if bin(p ^ q).count("1") <= 2])
    ids = sorted(order)
    expected = sorted((str(r["doc_id"]), p if p < 1 << 63 else p - (1 << 64), "None" if r["doc_id"] is None else str(ids[root[order[r["doc_id"]]]])) for r, p in zip(rows, prints, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_dense_group_of_fingerprints(spark):
    """More fingerprints than a bucket holds, all near one another, and a few far away."""
    rng = np.random.default_rng(2)
    prints = {0}
    while len(prints) < 150:
        base = list(prints)[int(rng.integers(len(prints)))]
        prints.add(base ^ (1 << int(rng.integers(20))))
    prints = [*prints, *(int(x) for x in rng.integers(1 << 40, 1 << 62, 30))]
    pairs = [(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints[:i]) if bin(p ^ q).count("1") <= 2]
    expected = united(len(prints), pairs)
    distinct = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, node long")
    links = simhash.fingerprint_links(distinct)
    for r in links.collect():
        assert bin(prints[r["a"]] ^ prints[r["b"]]).count("1") <= 2
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == expected


def test_sketches(docs, no_docs, block):
    rows = sorted({(r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()})
    got = {r["doc_id"]: r for r in sketch.edit_likeness(docs.where("doc_id is not null").distinct()).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (set(shingles(x, 5)) for x in (t, edited, following))
        share = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(share(a, b)) and got[i]["near_next"] == pytest.approx(share(a, c))
        assert got[i]["n_shingles"] == len(a)
    assert sketch.edit_likeness(no_docs).count() == 0 and sketch.fingerprint_texts(docs).count() == docs.count()
    rng = np.random.default_rng(3)
    words = rng.integers(0, 10**6, 9000).astype(str)
    x, y = sketch.sketches(block([" ".join(words[:6000]), " ".join(words[3000:])]))
    whole = sketch.sketches(block([" ".join(words)]))[0]
    assert sketch.resemblance(x, y) == pytest.approx(1 / 3, abs=0.1) and sketch.containment(x, y) == pytest.approx(0.5, abs=0.15)
    assert sketch.distinct_shingles(whole) == pytest.approx(9000, rel=0.2) and (sketch.read(sketch.written(x)) == x).all()
    assert sketch.resemblance(sketch.merge(x, y), whole) > 0.98


def test_parts_in_order(spark, monkeypatch, tmp_path):
    """Many parts, within quantiles too: the rows of all parts are the table in order, each followed by the next part's first."""
    monkeypatch.setattr(sketch, "CUTS", 8)
    rng = np.random.default_rng(7)
    ids = sorted({*map(int, rng.integers(-50, 5000, 900)), 10**12, -(10**15), *range(40)})
    df = spark.createDataFrame([(i, f"text {i}") for i in rng.permutation(ids).tolist()], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    got = sketch.in_order(spark.read.parquet(str(tmp_path / "in")), part_bytes=200).collect()
    assert len({r["part"] for r in got}) > 16
    own = sorted((r["part"], r["doc_id"]) for r in got if not r["guest"])
    assert [i for _, i in own] == ids
    first = {}
    for p, i in own:
        first.setdefault(p, i)
    order = sorted(first)
    assert {r["part"]: r["doc_id"] for r in got if r["guest"]} == {p: first[q] for p, q in zip(order, order[1:] + order[:1], strict=True)}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    v = [*(centre[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.4]) for i in range(300)), *rng.normal(size=(100, 16))]
    rows = [(i, [float(x) for x in a], i % 2) for i, a in enumerate(v)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 0), (404, [0.0] * 16, 0), (405, [float("nan")] * 16, 0), (406, [None] * 16, 0), (407, [1.0], 0), (407, [1.0], 0), (408, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    good = [(i, np.array(a), y) for i, a, y in rows[:402]]
    unit = {i: a / np.linalg.norm(a) for i, a, _ in good}
    pairs = [(i, j) for i, _, y in good for j, _, z in good if j < i and y == z and unit[i] @ unit[j] >= 0.93]
    root = united(410, pairs)
    links = np.bincount([x for p in pairs for x in p], minlength=410)
    for shard_rows in (hnsw.SHARD_ROWS, 60):
        every = hnsw.near_duplicates(df, shard_rows=shard_rows).collect()
        got = [tuple(r)[:4] for r in every]
        assert len(got) == len(rows) and {r["recall"] for r in every} <= {every[0]["recall"]} and hnsw.TARGET <= every[0]["recall"] <= 1
        for i, n, c, kept in got:
            if i == 407:
                assert (n, c, kept) == (1, 407, True)
            else:
                assert (n, c, kept) == (links[i], root[i], root[i] == i), i
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_audit_widens_the_beam(monkeypatch):
    """A sample spread over the shard, without matches of a vector with itself, whose first rows have no links."""
    rng = np.random.default_rng(6)
    alone, dense = rng.normal(size=(200, 32)), rng.normal(size=(1, 32)) + 0.25 * rng.normal(size=(1500, 32))
    v = np.concatenate((alone, dense))
    monkeypatch.setattr(hnsw, "FIRST_WIDTH", 1)
    shard = hnsw.Shard(np.arange(len(v)), np.ones(len(v), dtype=np.int64), v, 0.93)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    true = (unit @ unit.T >= 0.93).sum() - len(v)
    found = sum(n for _, n, _ in shard.query(np.arange(len(v)), v))
    assert shard.true >= hnsw.AUDIT and shard.found >= hnsw.TARGET * shard.true and 0.99 * true <= found <= true


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)) + 3 * rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    row, point = hnsw.Graph(x).within(x[:200], 0.9, 64)
    true = {(a, b) for a, b in zip(*np.nonzero(x[:200] @ x.T >= 0.9), strict=True)}
    found = set(zip(row.tolist(), point.tolist(), strict=True))
    assert len(found & true) >= 0.98 * len(true) and found <= {(a, b) for a, b in zip(*np.nonzero(x[:200] @ x.T >= 0.8999), strict=True)}
