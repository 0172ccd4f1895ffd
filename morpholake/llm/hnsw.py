"""Near-duplicate vectors through hierarchical navigable small-world graphs, one for each shard.

Vectors are compared only within a label (and a length). Copies count once. A label's distinct vectors are dealt to
shards of bounded size; every shard builds a graph over its own and is queried with all of the label. A query's beam is
widened until its worst entry lies below the threshold, and the first beam's width until an audit against brute force
reaches TARGET. The audit's queries are vectors of the shard with the smallest hashes of their ids, as many as it takes
to have AUDIT links to others (AUDIT_ROWS at most); the shard's links found and there are returned as the recall. What a
beam finds is verified by the cosine in double precision.

Links are counted, not listed: of a group of near copies a shard hands on a count for each query and the edges of a
spanning forest, whose components are then united over all shards.

Cases: rows whose label or id is null, and vectors that are null, zero, or hold null or non-finite components, link with
nothing; vectors of different lengths do not link; equal vectors link with each other; repeated ids keep a row each and
count as copies; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import U64, checkpointed, mix
from morpholake.llm.graph import components, loose

DEGREE, BUILD_WIDTH, FIRST_WIDTH, AUDIT, AUDIT_ROWS, TARGET = 16, 64, 32, 256, 1024, 0.995
SHARD_ROWS, QUERY_ROWS, STEP = 16384, 256, 4


class Layer:
    """One level: members' numbers in the shard, and their neighbours' places among them (-1: none)."""

    def __init__(self, members: np.ndarray, degree: int):
        self.members, self.near, self.size = members, np.full((len(members), degree), -1, dtype=np.int32), 0


class Graph:
    """A navigable small-world graph over unit vectors. Points are inserted in growing batches, each batch at once."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, seed: int = 1):
        self.unit, self.degree, self.width = unit, degree, width
        rng = np.random.default_rng(seed)
        n = len(unit)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(np.int64), 8)
        order = np.lexsort((rng.random(n), -level))  # higher points first, so that an upper level's are always there
        self.layers: list[Layer] = []
        self.place: list[np.ndarray] = []  # of each point in each layer
        for at in range(int(level.max(initial=0)), -1, -1):
            layer = Layer(order[level[order] >= at], degree if at else 2 * degree)
            place = np.full(n, -1, dtype=np.int64)
            place[layer.members] = np.arange(len(layer.members))
            self.layers.append(layer)
            self.place.append(place)
            while layer.size < len(layer.members):
                self._insert(layer, min(len(layer.members) - layer.size, max(32, min(layer.size, 512))))

    def _insert(self, layer: Layer, count: int) -> None:
        new = np.arange(layer.size, layer.size + count)
        x = self.unit[layer.members[new]]
        found, score = self._descend(x, self.width, layer) if layer.size else (np.full((count, 0), -1), np.zeros((count, 0), dtype=np.float32))
        mates = x @ x.T
        np.fill_diagonal(mates, -np.inf)
        few = min(count - 1, self.width // 2)
        if few:
            best = np.argpartition(-mates, few - 1, axis=1)[:, :few]
            found = np.concatenate((found, new[best]), axis=1)
            score = np.concatenate((score, np.take_along_axis(mates, best, axis=1)), axis=1)
        layer.size += count
        if not found.shape[1]:
            return
        layer.near[new, : self.degree] = self._spread(layer, x, found, score, self.degree)
        source = np.repeat(new, self.degree)
        target = layer.near[new, : self.degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        closeness = np.einsum("ij,ij->i", self.unit[layer.members[source]], self.unit[layer.members[target]])
        order = np.lexsort((-closeness, target))
        source, target = source[order], target[order]
        hub, first, each = np.unique(target, return_index=True, return_counts=True)
        most = min(int(each.max(initial=0)), 2 * layer.near.shape[1])
        back = np.full((len(hub), most), -1, dtype=np.int64)
        for k in range(most):
            more = each > k
            back[more, k] = source[first[more] + k]
        pool = np.concatenate((layer.near[hub], back), axis=1)
        y = self.unit[layer.members[hub]]
        score = np.where(pool >= 0, np.einsum("ij,ikj->ik", y, self.unit[layer.members[np.maximum(pool, 0)]]), -np.inf)
        layer.near[hub] = self._spread(layer, y, pool, score, layer.near.shape[1])

    def _spread(self, layer: Layer, x: np.ndarray, pool: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
        """Up to keep of each row's pool: first those closer to x than to any chosen before, then the closest others."""
        most = min(pool.shape[1], 3 * keep)
        out = np.full((len(x), keep), -1, dtype=np.int64)
        for a in range(0, len(x), 128):
            s, p = score[a : a + 128], pool[a : a + 128]
            order = np.argsort(-s, axis=1)[:, :most]
            s, p = np.take_along_axis(s, order, axis=1), np.take_along_axis(p, order, axis=1)
            same = np.zeros(p.shape, dtype=bool)
            by_id = np.sort(np.where(p >= 0, p * p.shape[1] + np.arange(p.shape[1]), -1), axis=1)
            twice = (by_id[:, 1:] // p.shape[1] == by_id[:, :-1] // p.shape[1]) & (by_id[:, 1:] >= 0)
            r, c = np.nonzero(twice)
            same[r, by_id[r, c + 1] % p.shape[1]] = True
            good = (p >= 0) & ~same & np.isfinite(s)
            v = self.unit[layer.members[np.maximum(p, 0)]]
            between = v @ v.transpose(0, 2, 1)
            chosen = np.zeros(p.shape, dtype=bool)
            for k in range(p.shape[1]):
                shaded = (chosen & (between[:, :, k] > s[:, k : k + 1])).any(axis=1)
                chosen[:, k] = good[:, k] & ~shaded
            rank = np.argsort(np.where(chosen, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :keep]
            out[a : a + 128, : rank.shape[1]] = np.where(np.take_along_axis(good, rank, axis=1), np.take_along_axis(p, rank, axis=1), -1)
        return out

    def _descend(self, x: np.ndarray, width: int, to: Layer) -> tuple[np.ndarray, np.ndarray]:
        """The best of layer to for each row of x, found from the top level down."""
        entry = np.zeros((len(x), 1), dtype=np.int64)
        for i, layer in enumerate(self.layers):
            if layer is to:
                return self._beam(layer, x, entry, width)
            found, _ = self._beam(layer, x, entry, 2)
            entry = self.place[i + 1][layer.members[np.maximum(found[:, :1], 0)]]
            entry[entry >= self.layers[i + 1].size] = 0  # not inserted there yet
        raise AssertionError

    def _beam(self, layer: Layer, x: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for all rows at once: places (-1: none) and similarities, best first."""
        rows, width = len(x), min(width, max(layer.size, 1))
        ids = np.full((rows, width), -1, dtype=np.int64)
        score = np.full((rows, width), -np.inf, dtype=np.float32)
        open_ = np.zeros((rows, width), dtype=bool)
        seen = np.zeros((rows, layer.size), dtype=bool)
        ids[:, :1], open_[:, :1] = entry, True
        score[:, 0] = np.einsum("ij,ij->i", x, self.unit[layer.members[entry[:, 0]]])
        seen[np.arange(rows), entry[:, 0]] = True
        active, step = np.arange(rows), min(width, max(STEP, width // 8))
        while len(active):
            best = np.argpartition(-np.where(open_[active], score[active], -np.inf), step - 1, axis=1)[:, :step]
            on = np.take_along_axis(open_[active], best, axis=1)
            at = np.where(on, np.take_along_axis(ids[active], best, axis=1), -1)
            open_[active[:, None], best] = False
            near = np.where(at[:, :, None] >= 0, layer.near[np.maximum(at, 0)], -1).reshape(len(active), -1)
            near = -np.sort(-near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            got = near[r, c]
            seen[active[r], got] = True
            s = np.full(near.shape, -np.inf, dtype=np.float32)
            s[r, c] = np.einsum("ij,ij->i", x[active[r]], self.unit[layer.members[got]])
            both = np.concatenate((score[active], s), axis=1)
            top = np.argpartition(-both, width - 1, axis=1)[:, :width]
            score[active] = np.take_along_axis(both, top, axis=1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), top, axis=1)
            open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), axis=1), top, axis=1)
            active = active[open_[active].any(axis=1)]
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)

    def within(self, x: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, point) of what is found with a similarity of least or more; beams that end above it are widened."""
        rows, points, left = [], [], np.arange(len(x))
        base = self.layers[-1]
        while len(left):
            again = []
            for part in np.array_split(left, -(-len(left) * width // (QUERY_ROWS * 64)) or 1):
                ids, score = self._descend(x[part], width, base)
                full = (score[:, -1] >= least) & (width < base.size)
                r, c = np.nonzero((score >= least) & ~full[:, None])
                rows.append(part[r])
                points.append(base.members[ids[r, c]])
                again.append(part[full])
            left, width = np.concatenate(again), 2 * width
        return np.concatenate(rows) if rows else left, np.concatenate(points) if points else left


class Shard:
    """Distinct vectors of one label with their graph."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float):
        self.ids, self.copies, self.least = ids, copies, least
        self.vectors, self.norm = vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.graph = Graph((vectors / self.norm[:, None]).astype(np.float32))
        self.root = np.arange(len(ids))
        self.own = {int(x): i for i, x in enumerate(ids)}
        self.width, self.found, self.true = FIRST_WIDTH, 0, 0
        self._audit()

    def _found(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((v * v).sum(axis=1))
        row, point = self.graph.within((v / norm[:, None]).astype(np.float32), self.least - 1e-5, width)
        sure = np.einsum("ij,ij->i", v[row], self.vectors[point]) / (norm[row] * self.norm[point]) >= self.least
        return row[sure], point[sure]

    def _audit(self) -> None:
        """Sets the first beam's width: doubled until what is found of the sample's links to others reaches TARGET of what brute force finds."""
        order = np.argsort(mix(self.ids.astype(U64)), kind="stable")[:AUDIT_ROWS]
        links, rows = [], 0
        while rows < len(order) and sum(len(x) for x in links) < AUDIT:
            part = order[rows : rows + 64]
            near = (self.vectors[part] @ self.vectors.T) / (self.norm[part, None] * self.norm) >= self.least
            near[np.arange(len(part)), part] = False
            links.append(np.flatnonzero(near) + rows * len(self.ids))
            rows += len(part)
        true, sample = np.concatenate([*links, np.zeros(0, dtype=np.int64)]), order[:rows]
        self.true = len(true)
        while True:
            row, point = self._found(self.vectors[sample], self.width)
            self.found = int(np.isin(true, row * len(self.ids) + point).sum())
            if self.found >= TARGET * self.true or self.width >= len(self.ids):
                break
            self.width *= 2

    def query(self, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """For each query: id, number of links into this shard, and links that unite what was not united yet."""
        row, point = self._found(v, self.width)
        order = np.argsort(row, kind="stable")
        row, point = row[order], point[order]
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        for i, q in enumerate(ids.tolist()):
            hit = point[cut[i] : cut[i + 1]]
            hit = hit[self.ids[hit] != q]
            if not len(hit):
                continue
            roots, first = np.unique(self.root[hit], return_index=True)
            me = self.own.get(q)
            mine = -1 if me is None else int(self.root[me])
            united = roots if me is None else np.union1d(roots, mine)
            if len(united) > 1:
                self.root[np.isin(self.root, united)] = united[0]
            yield q, int(self.copies[hit].sum()), self.ids[hit[first[roots != mine]]].tolist()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], ["node", "other", "n", "there"])


def near_duplicates(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row; ids are integers, labels any type that can be grouped by.

    recall: the share of true links that the audits of all shards found, the same for every row; null without any.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = checkpointed(rows.withColumn("fit", F.coalesce(fit & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))))
    distinct = rows.where("fit").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    distinct = checkpointed(distinct.withColumn("dim", F.size("v")))
    large = checkpointed( distinct.groupBy("label", "dim").count().where(F.col("count") > shard_rows).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("count") / shard_rows).cast("int").alias("shards")))
    few = F.broadcast(large) if large.count() <= 1 << 16 else large
    dealt = distinct.join(few, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    built = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).withColumn("asks", F.lit(False))
    asking = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("asks", F.lit(True))
    names = ["label", "dim", "shard", "asks", "node", "copies", "v"]
    both = built.select(names).unionAll(asking.select(names)).withColumn("place", F.xxhash64("label", "dim", "shard"))
    dealt_out = both.repartition("place").sortWithinPartitions("place", "label", "dim", "shard", "asks", "node").select("place", F.struct("label", "dim", "shard").cast("string").alias("group"), "asks", "node", "copies", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, shard = None, [], None
        for batch in batches:
            names_, asks = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(batch)) if names_[i] != names_[i - 1] or asks[i] != asks[i - 1]), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if names_[a] != group:
                    group, parts, shard = names_[a], [], None
                part = batch.slice(a, b - a)
                values = part.column(5)
                ids, copies = part.column(3).to_numpy(), part.column(4).to_numpy()
                vectors = values.flatten().to_numpy().reshape(len(part), -1)
                if not asks[a]:
                    parts.append((ids, copies, vectors))
                    continue
                if shard is None:
                    shard = Shard(*(np.concatenate([p[k] for p in parts]) for k in range(3)), least)
                    parts = []
                    yield _rows([(None, None, shard.found, shard.true)])
                for i in range(0, len(part), QUERY_ROWS):
                    out: list[tuple] = []
                    for q, n, links in shard.query(ids[i : i + QUERY_ROWS], vectors[i : i + QUERY_ROWS]):
                        out.append((q, None, n, None))
                        out += [(q, x, 0, None) for x in links]
                    if out:
                        yield _rows(out)

    found = checkpointed(dealt_out.mapInArrow(run, "node bigint, other bigint, n bigint, there bigint"))
    audit = found.where("there is not null").agg(F.sum("n"), F.sum("there")).first()
    recall = F.lit(audit[0] / audit[1] if audit[1] else None).cast("double")
    united = components(found.where("other is not null"), "node", "other").withColumnRenamed("node", "u")
    linked = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n")).select(F.col("node").alias("w"), "n")
    known = distinct.join(linked, F.col("node") == F.col("w"), "left").join(united, F.col("node") == F.col("u"), "left")
    known = known.select(F.col("label").alias("l"), F.col("v").alias("x"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = rows.join(known, F.col("fit") & F.col("label").eqNullSafe(F.col("l")) & (F.col("v") == F.col("x")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), recall.alias("recall"))
