"""The pipeline's near-duplicate stage against brute-force shares of five-word shingles, on planted near copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from morpholake.llm import graph, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(texts):
    """Numbers of the texts that have no near copy before them in their component."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            n = len(sets[i] & sets[j])
            if root[i] != root[j] and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return [i for i, x in enumerate(root) if i == x]


def test_dedup_stage(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    notice = word(60)  # shared by many that are otherwise unlike
    texts = ["", " \n", None, "one two", "One  two", "one two three"]
    for n in range(60):
        base = word(int(rng.integers(8, 400))) + (notice if n % 3 == 0 else [])
        texts.append(" ".join(base))
        for edits in (1, 2, len(base) // 40, len(base) // 25):
            copy = list(base)
            for i in rng.integers(0, len(copy), edits):
                copy[i] = "edited"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    expected = survivors(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, df, "").collect())
    assert got == expected and 60 < len(expected) < len(texts) - 60
    assert corpus_pipeline.dedup_stage(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("meet", [simhash.MEET, 3])
def test_many_near_copies_of_one_text(spark, monkeypatch, meet):
    """More of them than a block's fingerprints are compared with each other, beside a group that is a little too unlike."""
    monkeypatch.setattr(simhash, "MEET", meet)
    rng = np.random.default_rng(9)
    base, texts = [f"w{x}" for x in rng.integers(0, 3000, 200)], []
    for group in (0, 1):
        own = [*base[: 200 - 30 * group], *(f"g{group}{x}" for x in range(30 * group))]
        for _ in range(90):
            copy = list(own)
            for i in rng.integers(0, 200, 3):
                copy[i] = "edited"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == survivors(texts)


def most_joined(spark, since):
    """The most rows that a join of the queries from number since on made."""
    store, listed = spark._jsparkSession.sharedState().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    most = 0
    for query in listed(store.executionsList()):
        if query.executionId() >= since:
            values = store.executionMetrics(query.executionId())
            for node in listed(store.planGraph(query.executionId()).allNodes()):
                rows = [values.get(m.accumulatorId()) for m in listed(node.metrics()) if "Join" in node.name() and m.name() == "number of output rows"]
                most = max(most, *(int(v.get().replace(",", "")) for v in rows if v.isDefined()), 0)
    return most


def test_no_join_of_all_shingles(spark):
    """Near copies of one text: no join makes as many rows as their shingles, and not more than in proportion to the group."""
    rng = np.random.default_rng(10)
    base, made = [f"w{x}" for x in range(200)], []
    for group in (60, 120):
        texts = [" ".join(base)]
        for n in range(group):
            copy = list(base)
            for i in rng.integers(0, 200, 2):
                copy[i] = f"edited{n}"
            texts.append(" ".join(copy))
        df = spark.createDataFrame(list(enumerate(texts)), "same long, text string")
        each = df.select("same", F.transform(F.sequence(F.lit(0), F.lit(195)), lambda i: F.xxhash64(F.slice(F.split("text", " "), i + 1, F.lit(5)))).alias("shingles")).localCheckpoint()
        since = spark._jsparkSession.sharedState().statusStore().executionsCount()
        found = graph.components(simhash.dense_links(each, 0.8))
        assert {r["component"] for r in found.collect()} == {0} and found.count() == group + 1
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        made.append(most_joined(spark, since))
        assert 0 < made[-1] < (group + 1) * 196 / 4
    assert made[1] < 3 * made[0]


def test_no_join_of_texts_too_unlike(spark):
    """A group whose texts share two thirds with each other: the join of different components makes few of all pairs, and the links are those of brute force."""
    rng, texts = np.random.default_rng(12), []
    base = [f"w{x}" for x in range(150)]
    for n in range(160):
        copy = list(base)
        for i in rng.integers(0, 150, 3):
            copy[i] = f"edited{n}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "same long, text string")
    each = df.select("same", F.transform(F.sequence(F.lit(0), F.lit(145)), lambda i: F.xxhash64(F.slice(F.split("text", " "), i + 1, F.lit(5)))).alias("shingles")).localCheckpoint()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {r["node"]: r["component"] for r in graph.components(simhash.dense_links(each, 0.8)).collect()}
    assert [i for i in range(160) if found.get(i, i) == i] == survivors(texts)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert most_joined(spark, since) < 160 * 159 / 2 / 4


@pytest.mark.parametrize("bits", [1, simhash.SLOT_BITS])
def test_any_order_of_shingles(spark, monkeypatch, bits):
    """Counts of few slots, which hardly tell rare shingles from others, lead to the same survivors."""
    monkeypatch.setattr(simhash, "SLOT_BITS", bits)
    monkeypatch.setattr(simhash, "MEET", 2)
    rng = np.random.default_rng(11)
    line, texts = [f"line{x}" for x in range(12)], []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 60)] + line
        for edits in (0, 1, 1, 2, 3):
            copy = list(base)
            for i in rng.integers(0, len(copy), edits):
                copy[i] = "edited"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == survivors(texts)


def test_rows_of_one_id(spark, docs, no_docs):
    """Survivors are chosen by row: an id's other text stays, a row that is there twice stays once, rows without an id stay."""
    a, b = "one two three four five six seven", "quite another text than that of the first row"
    names = "doc_id long, text string, tie string, component string, _id string"
    rows = [(1, a), (5, a), (5, b), (7, "x"), (7, "x"), (8, "x"), (None, "x"), (None, "x"), (9, None), (3, ""), (1, "unlike")]
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], names)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, "x"), (None, "x"), (None, "x"), (3, ""), (1, "unlike")], key=str)
    assert simhash.one_of_each(no_docs).count() == 0 and simhash.one_of_each(docs).columns == docs.columns


def test_splits():
    """Few and many fingerprints: pairs at NEAR bits are missed as rarely as stated."""
    for count in (0, 10, 1 << 16, 1 << 30):
        width, splits = simhash.block_splits(count)
        blocks = 64 * simhash.LANES // width
        assert 16 <= width <= 32 and (1 - (1 - simhash.NEAR / (64 * simhash.LANES)) ** width) ** (blocks * splits) <= simhash.MISSED
