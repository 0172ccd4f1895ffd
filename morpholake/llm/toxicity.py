"""A counterfactually regularised toxicity classifier.

Features are a text's words and word beginnings, and which of them it has more than once. A logistic model over the most
telling ones is fitted on a bounded, documented sample of labelled rows. Labelled texts that name a group are also
written with other groups' names of the same line, and the squared change of the score's logit is penalised, so that
naming a group does not by itself change the score. So that there are such texts in any corpus, every second labelled
text that names no group is fitted with a group's name added, and its change from the text without it is penalised too.
Words that such a change touches always are features. Scoring is one narrow pass over whole texts; only the words are
looked at.

Cases: a null text is empty; an empty text gets the score of no features; a null label, or a label whose document is
missing, is left out; a document labelled twice is toxic if one label says so; an id that several documents have is
fitted with the shortest of its texts; without both classes every score is the share of toxic labels (0 without labels);
repeated rows get equal scores; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import IS_MARK, U64, Block, checkpointed, id_and_text, lanes, mix, span_hashes, text_blocks, words

#: Labelled rows that the model is fitted on, and bytes of their texts, at most: of those whose ids have the smallest
#: hashes, the shortest texts.
FIT_ROWS, FIT_BYTES = 4000, 32 << 20
#: Numbers of features among which cross-validation chooses.
SIZES = (100, 400, 1024)
FOLDS, ROUNDS, RIDGE, LAMBDA = 3, 150, 1e-4, 1.0
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
THRESHOLD = 0.7
#: Logits between which cross-validation may place the threshold.
CUTS = (-1.0, 3.0)
#: Names of groups, by default; within a line they are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender people", "nonbinary people"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "queer", "straight"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)


class Names:
    """Lines of groups' names."""

    def __init__(self, lines: Iterable[Iterable[str]] = IDENTITY):
        self.line = {name.lower(): tuple(names) for names in map(tuple, lines) for name in names}
        self.every = sorted(self.line)
        self.pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(self.line, key=len, reverse=True))) + r")\b", re.IGNORECASE)

    def swapped(self, text: str, turn: int) -> str:
        """text with every group's name replaced by the one turn places further in its line."""

        def other(m: re.Match) -> str:
            names = self.line[m[0].lower()]
            return names[([n.lower() for n in names].index(m[0].lower()) + turn) % len(names)]

        return self.pattern.sub(other, text)

    def versions(self, key: str, text: str) -> list[str]:
        """The text to fit, and its other versions, if any: with names swapped, and without a name that was added."""
        if self.pattern.search(text):
            return [text, self.swapped(text, 1), self.swapped(text, 2)]
        number = zlib.crc32(key.encode())
        if number % 2:
            return [text]
        named = f"{text}\n{self.every[number // 2 % len(self.every)]}"
        return [named, self.swapped(named, 1), self.swapped(named, 2), text]


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes; odd: of what a text has more than once
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash (even) and row of every word and word beginning, repeats included."""
    w = words(block, IS_MARK)
    row = np.repeat(np.arange(len(block.offsets) - 1), np.diff(w.first))
    size = w.end - w.start
    first = lanes(w.data, w.start, size, 1)[0]
    hashes, rows = [span_hashes(w.data, w.start, w.end)], [row]
    for n in BEGINNINGS:
        long = size > n
        hashes.append(mix(mix(first[long] & U64((1 << (8 * n)) - 1)) + U64(n)))
        rows.append(row[long])
    return np.concatenate(hashes) & ~U64(1), np.concatenate(rows)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """One text's features: each hash once, and its odd neighbour where it occurs again."""
    once, count = np.unique(hashes, return_counts=True)
    return np.sort(np.concatenate((once, once[count > 1] | U64(1))))


def _block(texts: list[str]) -> Block:
    data = [t.encode() for t in texts]
    return Block(None, b"".join(data), np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64))


def _lookup(names: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
    """A row of zeros and ones for each text: which of the sorted names are among its features."""
    x = np.zeros((len(of), len(names)), dtype=np.float32)
    for i, f in enumerate(of) if len(names) else ():
        at = np.minimum(np.searchsorted(names, f), len(names) - 1)
        x[i, at[names[at] == f]] = 1
    return x


def _telling(found: list[np.ndarray], toxic: np.ndarray, most: int) -> np.ndarray:
    """The features whose share among toxic texts differs most surely from that among the others, best first."""
    names, group, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    in_toxic = np.bincount(group, weights=np.repeat(toxic, [len(f) for f in found]), minlength=len(names))
    often = counts >= 4
    names, counts, in_toxic = names[often], counts[often], in_toxic[often]
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    p = counts / len(toxic)
    sure = np.abs(in_toxic / n1 - (counts - in_toxic) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return names[np.argsort(-sure, kind="stable")[:most]]


def _descend(x: np.ndarray, toxic: np.ndarray, change: np.ndarray, weight: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model, all rows at once. change: differences of features that a swap makes."""
    share = float(toxic.mean())
    w, b = np.zeros(x.shape[1], dtype=np.float32), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, ROUNDS + 1):
        wrong = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - toxic).astype(np.float32)
        g = x.T @ wrong / len(toxic) + RIDGE * w
        if len(change):
            g += weight * 2 * change.T @ (change @ w) / len(change)
        g = np.append(g, wrong.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        b -= float(move[-1])
    return w, b


def _best_cut(logit: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The cut between two scores with the best F0.5 (precision counts more), and that figure. The cut stays in CUTS: a few labels must not condemn everything."""
    order = np.argsort(-logit, kind="stable")
    f = 1.25 * np.cumsum(toxic[order]) / (np.arange(1, len(toxic) + 1) + 0.25 * toxic.sum())
    k = int(np.argmax(f))
    return float(np.clip((logit[order[k]] + logit[order[min(k + 1, len(order) - 1)]]) / 2, *CUTS)), float(f[k])


def fit(found: list[np.ndarray], changed: list[tuple[int, np.ndarray]], toxic: np.ndarray, weight: float = LAMBDA) -> Model:
    """A model from each text's distinct features; changed: text number and its features after a swap.

    Cross-validation chooses how many features count, and the logit from which on a text is held to be toxic; the bias
    is moved so that this logit has the score THRESHOLD.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), -40.0 if share == 0 else 40.0)
    owner = np.array([i for i, _ in changed], dtype=np.int64)
    after = [f for _, f in changed]
    touched = np.unique(np.concatenate([*(np.setxor1d(f, found[i]) for i, f in changed), np.zeros(0, dtype=found[0].dtype)]))

    def model(rows: np.ndarray, sizes: tuple[int, ...], test: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
        best = _telling([found[i] for i in rows], toxic[rows], max(sizes))
        every = np.union1d(best, touched)
        x, z = _lookup(every, [found[i] for i in rows]), _lookup(every, [found[i] for i in test])
        use = np.flatnonzero(np.isin(owner, rows))
        change = _lookup(every, [after[i] for i in use]) - _lookup(every, [found[i] for i in owner[use]])
        out = []
        for size in sizes:
            own = np.isin(every, best[:size]) | np.isin(every, touched)
            w, b = _descend(x[:, own], toxic[rows].astype(np.float32), change[:, own], weight)
            out.append((every[own], w, b, z[:, own] @ w + b))
        return out

    every = np.arange(len(toxic))
    size, cut = SIZES[0], 0.0
    if min(toxic.sum(), len(toxic) - toxic.sum()) >= 2 * FOLDS:
        fold = np.empty(len(toxic), dtype=np.int64)
        for y in (0, 1):
            fold[toxic == y] = np.arange(int((toxic == y).sum())) % FOLDS
        logit = np.zeros((len(SIZES), len(toxic)))
        for k in range(FOLDS):
            for n, (_, _, _, z) in enumerate(model(every[fold != k], SIZES, every[fold == k])):
                logit[n, fold == k] = z
        size, cut = max(((_best_cut(z, toxic), n) for z, n in zip(logit, SIZES, strict=True)), key=lambda x: x[0][1])[::-1]
        cut = cut[0]
    (names, w, b, _), = model(every, (size,), every[:0])
    return Model(names, w.astype(np.float64), b - cut + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = FIT_ROWS, size: int = FIT_BYTES, weight: float = LAMBDA, groups: Iterable[Iterable[str]] = IDENTITY,
) -> Model:
    """Fits on at most rows labelled documents that are not held out, of size bytes together at most.

    Their ids are broadcast (that bound), their texts are written once, and their distinct features come to the driver.
    """
    names = Names(groups)
    wanted = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    few = docs.sparkSession.createDataFrame(wanted.toArrow()) if not wanted.isEmpty() else wanted
    met = id_and_text(docs, id_col, text_col).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("least"))
    sample = checkpointed(met.select("doc_id", F.col("least.text").alias("text"), "toxic", F.col("least.size").alias("size")))
    order = sample.select("doc_id", "size").orderBy("size", F.xxhash64("doc_id")).toArrow()
    fits = int((np.cumsum(order["size"].to_numpy()) <= size).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                keys = part.column(0).cast(pa.string())
                made = [names.versions(key, text) for key, text in zip(keys.to_pylist(), part.column(1).to_pylist(), strict=True)]
                owner = [r for r, m in enumerate(made) for _ in m]
                h, row = features(_block([text for m in made for text in m]))
                cut = np.argsort(row, kind="stable")
                each = [distinct(x) for x in np.split(h[cut], np.searchsorted(row[cut], np.arange(1, len(owner))))]
                turn = [k for m in made for k in range(len(m))]
                # Of other versions only what differs from the first is sent.
                sent = [np.setxor1d(x, each[n - k]) if k else x for n, (x, k) in enumerate(zip(each, turn, strict=True))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": keys.take(pa.array(owner)),
                    "toxic": part.column(2).take(pa.array(owner)),
                    "turn": pa.array(turn, pa.int32()),
                    "found": pa.array([x.view(np.int64) for x in sent], pa.list_(pa.int64())),
                })

    chosen = sample
    if fits < len(order):
        fit_ids = docs.sparkSession.createDataFrame(order.select(["doc_id"]).slice(0, fits), sample.select("doc_id").schema)
        chosen = sample.join(F.broadcast(fit_ids), "doc_id")
    chosen = chosen.select("doc_id", "text", "toxic")
    got = chosen.mapInArrow(run, "doc_id string, toxic int, turn int, found array<bigint>").toArrow().sort_by([("doc_id", "ascending"), ("turn", "ascending")])
    turns, toxic = got["turn"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    ids = got["doc_id"].to_pylist()
    known, found = _shared([chunk[i].values.to_numpy().view(U64) for chunk in got["found"].chunks for i in range(len(chunk))], turns == 0)
    del got
    own = np.flatnonzero(turns == 0)
    number = {ids[i]: n for n, i in enumerate(own)}
    changed = [(n, np.setxor1d(found[own[n]], found[i])) for i in np.flatnonzero(turns) for n in (number[ids[i]],)]
    model = fit([found[i] for i in own], changed, toxic[own], weight=weight)
    return model._replace(features=known[model.features])


def _shared(found: list[np.ndarray], counted: np.ndarray, least: int = 4) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted hashes that at least least of the counted texts have, and each text's as places among them.

    A table of small counters, by the hashes' upper bits, first sets most of the rare ones aside, so that little more
    than what is kept is ever held.
    """
    table, shift = np.zeros(1 << 22, dtype=np.uint16), U64(42)
    for f, c in zip(found, counted, strict=True):
        if c:
            at = np.unique(f >> shift)
            table[at] += table[at] < 60000
    found = [f[table[f >> shift] >= least] for f in found]
    names, count = np.unique(np.concatenate([f for f, c in zip(found, counted, strict=True) if c] or [np.zeros(0, dtype=U64)]), return_counts=True)
    names = names[count >= least]
    out = []
    for f in found:
        at = np.minimum(np.searchsorted(names, f), max(len(names) - 1, 0))
        out.append(at[names[at] == f].astype(np.int32) if len(names) else np.zeros(0, dtype=np.int32))
    return names, out


def block_scores(block: Block, model: Model) -> np.ndarray:
    """A score from 0 to 1 for each row."""
    logit = np.full(len(block.offsets) - 1, model.bias)
    if len(model.features):
        names, place = np.unique(model.features & ~U64(1), return_inverse=True)
        once, again = np.zeros(len(names)), np.zeros(len(names))
        odd = (model.features & U64(1)).astype(bool)
        once[place[~odd]], again[place[odd]] = model.weights[~odd], model.weights[odd]
        h, row = features(block)
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        hit = names[at] == h
        pair, count = np.unique(row[hit] * len(names) + at[hit], return_counts=True)
        at = pair % len(names)
        np.add.at(logit, pair // len(names), once[at] + again[at] * (count > 1))
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double) for each row; no shuffle."""
    texts = id_and_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": block.ids, "score": pa.array(block_scores(block, model))})

    return texts.mapInArrow(run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with docs' own columns; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(at)], ["doc_id", "text"])
            scores = [block_scores(block, model) for block in text_blocks(iter([texts]))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
