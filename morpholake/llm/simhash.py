"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit for each bit of a 64-bit hash: 1 where more than half of the text's shingles have it. Two
fingerprints that differ in at most 2 of 64 bits agree in at least two of four 16-bit blocks, so each distinct
fingerprint is dealt to the six pairs of its blocks; fingerprints that meet there are compared. A pair of blocks that
more than BUCKET fingerprints share is not joined with itself: each of its fingerprints is written down with its 64
neighbours at one bit, and fingerprints that meet at such a value are within 2 bits of each other. At most 65 distinct
ones can meet there, so that way is exact and grows with the number of fingerprints, however dense their group.

Copies share a fingerprint and count once before anything is joined.

near_copies is the same way for a wide radius, verified by the texts: texts that share 0.8 of their five-word shingles
lie about 15 % of the bits apart. Their fingerprints have 256 bits, over distinct shingles, and are split into blocks
several times, each time in another order of bits. Pairs that differ in fewer bits than a split has blocks share one
for certain; the number of splits is such that of pairs at NEAR bits one in 500 is missed. A block is as wide as the
logarithm of the number of fingerprints, so that unlike ones rarely meet. What meets is compared by Hamming distance,
and what is within FAR bits by its shingles. A block that more than MEET fingerprints share is not joined with itself:
all texts of such blocks are compared by a second pigeonhole, which is exact. Of two texts that share 0.8, each has one
of the other's rarest fifth of shingles, by counts of hashes that are sent to all tasks; texts that meet there are compared with the most central one first, and after
that only with those that are not yet in its component.

Cases: a null text is empty; a text without words
has fingerprint 0, which is linked like any other; a text of fewer words than a shingle has one shingle of them all;
repeated ids keep a row each; rows without an id keep their fingerprint, and a null component_id; a table without rows
gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morpholake.llm.blocks import U64, Block, Words, checkpointed, given_back, id_and_text, lanes, mix, ragged, shingle_hashes, span_hashes, text_blocks, words
from morpholake.llm.graph import components, loose

#: Fingerprints that share a pair of blocks and are compared pair by pair, at most.
BUCKET = 32
#: For near copies: words of 64 bits of a fingerprint; bits at which one pair in 500 is missed; bits beyond which texts are
#: not looked at, of all and of the first word; fingerprints that share a block and are compared pair by pair, at most.
LANES, NEAR, FAR, FAR_FIRST, MEET, MISSED = 4, 40, 60, 21, 16, 0.002
SHINGLE, SHARE = 5, 0.8
#: Of dense texts: bits of a shingle's hash that name the slot in which it is counted; words of 64 parities of a text.
SLOT_BITS, PARITIES = 20, 8
# Fixed values of the XXH64 hash.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many spans; those of 32 bytes and more one at a time. data needs 32 bytes of padding."""
    out = np.empty(len(start), dtype=U64)
    long = length >= 32
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]], seed)
    at = np.flatnonzero(~long)
    begin, size = start[at], length[at]
    h = size.astype(U64) + U64(seed) + P5
    eight = lanes(data, begin, size, 3)
    for i in range(3):
        on = np.flatnonzero(size >= 8 * (i + 1))
        h[on] = _turn(h[on] ^ (_turn(eight[i][on] * P2, 31) * P1), 27) * P1 + P4
    done = size // 8 * 8
    rest = lanes(data, begin + done, size - done, 1)[0]
    on = np.flatnonzero(size - done >= 4)
    h[on] = _turn(h[on] ^ ((rest[on] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    rest[on] >>= U64(32)
    ones = (size - done) % 4
    for i in range(3):
        on = np.flatnonzero(ones > i)
        h[on] = _turn(h[on] ^ ((rest[on] >> U64(8 * i) & U64(255)) * P5), 11) * P1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    out[at] = h ^ (h >> U64(32))
    return out


def shingle_spans(w: Words, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows joined by single spaces, the start and length of each n-word shingle in that, and rows + 1 positions in the shingles."""
    length = w.end - w.start
    put = np.cumsum(length + 1) - length - 1
    text = np.full(int((length + 1).sum()), 32, dtype=np.uint8)
    within = ragged(length)
    text[np.repeat(put, length) + within] = np.frombuffer(w.data, dtype=np.uint8)[np.repeat(w.start, length) + within]
    count = np.diff(w.first)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(each)))
    first = np.repeat(w.first[:-1], each) + ragged(each)
    last = first + np.repeat(np.minimum(count, n), each) - 1
    return text.tobytes() + bytes(32), put[first], put[last] + length[last] - put[first], at


def majority_bits(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row a value whose bits are set in more than half of its hashes; 0 for a row without hashes."""
    count = np.diff(at)
    out = np.zeros(len(count), dtype=U64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    groups = -(-count[full] // 255)  # so few that a byte holds their sum
    head = np.repeat(at[:-1][full], groups) + 255 * ragged(groups)
    row = np.cumsum(groups) - groups
    for shift in range(8):
        bits = np.add.reduceat((hashes >> U64(shift)) & U64(0x0101010101010101), head)
        sums = np.add.reduceat(bits.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), row)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte] > count[full]).astype(U64) << U64(8 * byte + shift)
    return out


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) for each row; no shuffle."""
    texts = id_and_text(df, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 2 << 20):
            data, start, length, at = shingle_spans(words(block), shingle)
            yield pa.RecordBatch.from_pydict({"doc_id": block.ids, "fp": pa.array(majority_bits(xxh64(data, start, length, seed), at).view(np.int64))})

    return texts.mapInArrow(run, f"doc_id {kind}, fp bigint")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most 2 bits; distinct: (fp, node), no fp twice."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint")) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[(block[i] * 65536 + block[j]) * 8 + k for k, (i, j) in enumerate(pairs)])
    dealt = distinct.select("fp", "node", F.explode(keys).alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(loose(F.col("key")).alias("shared"), "n")
    near = checkpointed(dealt.join(shared, F.col("key") == F.col("shared")).drop("shared"))
    small, large = near.where(F.col("n") <= BUCKET), near.where(F.col("n") > BUCKET)
    other = small.select(F.col("fp").alias("fp2"), F.col("node").alias("b"), F.col("key").alias("key2"))
    met = small.join(other, (F.col("key") == F.col("key2")) & (F.col("fp") < F.col("fp2")))
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2).select(F.col("node").alias("a"), "b")
    one_bit = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    around = large.select("fp", "node").distinct().select("node", F.explode(one_bit).alias("at"))
    nodes = around.groupBy("at").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)  # 65 at most
    star = nodes.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a < b")
    return met.unionAll(star)


def near_duplicates(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest id reachable by links. Ids are integers."""
    prints = checkpointed(fingerprints(df, shingle, seed, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    distinct = checkpointed(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(fingerprint_links(distinct)).select(loose(F.col("node")).alias("linked"), "component")
    known = distinct.join(found, F.col("node") == F.col("linked"), "left").select(loose(F.col("fp")).alias("print"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(known, F.col("fp") == F.col("print"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_sets(block: Block, shingle: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, in order."""
    w = words(block)
    hashes, at = shingle_hashes(span_hashes(w.data, w.start, w.end), w.first, shingle)
    return [np.unique(hashes[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """LANES words of fingerprint for each set."""
    at, every = np.cumsum([0, *(len(s) for s in sets)]), np.concatenate([*sets, np.zeros(0, dtype=U64)])
    return np.stack([majority_bits(mix(every ^ mix(np.full(1, lane, dtype=U64))), at) for lane in range(1, LANES + 1)], axis=1)


def _same(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 11) - (1 << 63)


_LANES = [f"f{i}" for i in range(LANES)]
_PARITIES = [f"p{i}" for i in range(PARITIES)]


def _described(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tie, same, n, f0, ..) for each row: a hash of its text, a hash and the number of its distinct shingles, and its wide fingerprint."""
    texts = texts.withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in text_blocks(iter([batch]), 2 << 20):
                sets = shingle_sets(block, shingle)
                prints = wide_prints(sets).view(np.int64)
                columns = {"doc_id": block.ids, "tie": batch.column(2).slice(done, len(sets)), "same": pa.array([_same(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32())}
                done += len(sets)
                yield pa.RecordBatch.from_pydict(columns | {name: pa.array(np.ascontiguousarray(prints[:, i])) for i, name in enumerate(_LANES)})

    return texts.mapInArrow(run, "doc_id bigint, tie bigint, same bigint, n int, " + ", ".join(f"{name} bigint" for name in _LANES))


def block_splits(count: int) -> tuple[int, int]:
    """Width of a block in bits, and number of splits, for so many fingerprints."""
    width = min(32, max(16, math.ceil(math.log2(max(count, 2)))))
    shared = (1 - NEAR / (64 * LANES)) ** width
    return width, math.ceil(math.log(MISSED) / (64 * LANES // width * math.log(1 - shared)))


def _dealt(distinct: DataFrame, width: int, splits: int) -> DataFrame:
    """(key, same, n, f0, dense) for each block of each fingerprint."""
    blocks, bits = 64 * LANES // width, 64 * LANES
    orders = [np.random.default_rng(k).permutation(bits)[: blocks * width] for k in range(splits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                prints = np.stack([batch.column(3 + lane).to_numpy() for lane in range(LANES)], axis=1)
                bit = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(batch), -1), axis=1, bitorder="little")
                keys = []
                for k, order in enumerate(orders):
                    cut = bit[:, order].reshape(len(batch), blocks, width)
                    code = np.packbits(np.pad(cut, ((0, 0), (0, 0), (0, 32 - width))), axis=2, bitorder="little").view("<u4")[:, :, 0].astype(np.int64)
                    keys.append(((k * blocks + np.arange(blocks)) << 32) | code)
                row = pa.array(np.repeat(np.arange(len(batch)), blocks * splits))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys, axis=1).ravel()), *(batch.column(c).take(row) for c in (0, 1, 3, 2))], ["key", "same", "n", "f0", "dense"])
            given_back()

    return distinct.select("same", "n", "dense", *_LANES).mapInArrow(run, "key bigint, same bigint, n int, f0 bigint, dense boolean")


def _meetings(sorted_by_key: DataFrame, share: float) -> DataFrame:
    """(a, b) of those that share a key and may be near copies by their first word of bits and their numbers of shingles; pairs of two dense ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int64, bool)]
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            key, same, n, first, dense = held
            step, found = 1, []
            at = np.flatnonzero(key[1:] == key[:-1])
            while len(at):
                a, b = at, at + step
                near = np.bitwise_count((first[a] ^ first[b]).view(U64)) <= FAR_FIRST
                near &= (np.minimum(n[a], n[b]) >= share * np.maximum(n[a], n[b]) - 1e-9) & (same[a] != same[b]) & ~(dense[a] & dense[b])
                found.append(np.sort(np.stack((same[a[near]], same[b[near]])), axis=0))
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            # The last key may go on in the next batch; its pairs are made again there, of all its rows.
            held = [x[int(np.searchsorted(key, key[-1])) :] if len(key) else x for x in held]

    return sorted_by_key.mapInArrow(run, "a bigint, b bigint")


def _beside(pairs: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """pairs (a, b) with other's columns for both, as name_a and name_b; other: one row for each same."""
    for x in "ab":
        pairs = pairs.join(other.select(loose(F.col("same")).alias(f"same_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in names]).hint("merge"), F.col(x) == F.col(f"same_{x}"))
    return pairs


def _sets(of: DataFrame, distinct: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(same, shingles) of those named in of (same), read from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 2 << 20):
            sets = shingle_sets(block, shingle)
            yield pa.RecordBatch.from_pydict({"same": pa.array([_same(s) for s in sets], pa.int64()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    ids = distinct.join(of, "same", "left_semi").select(loose(F.col("node")).alias("id"))
    # A node's id may have other texts as well; only the one meant has this hash.
    found = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(run, "same bigint, shingles array<bigint>")
    return checkpointed(found.join(of, "same", "left_semi").groupBy("same").agg(F.first("shingles").alias("shingles")))


def _alike(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those of the distinct pairs (a, b) that have enough shingles in common."""
    both = _beside(pairs, sets, ["shingles"]).withColumn("n", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return checkpointed(both.where(F.col("n") >= F.lit(share) * (F.size("shingles_a") + F.size("shingles_b") - F.col("n")) - 1e-9).select("a", "b"))


def _pairs(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _levels(sets: DataFrame) -> np.ndarray:
    """For each slot of SLOT_BITS bits of hash, 1024 times the binary logarithm of the number of shingles there, repeats in other sets included; 0 for one or none."""
    slot = F.shiftrightunsigned("shingle", 64 - SLOT_BITS).cast("int").alias("slot")
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy(slot).count().where("count > 1")
    found = counted.select("slot", F.least(F.round(1024 * F.log2("count")), F.lit(32767)).cast("smallint").alias("level")).toArrow()
    out = np.zeros(1 << SLOT_BITS, dtype=np.int16)
    out[found["slot"].to_numpy()] = found["level"].to_numpy()
    return out


def _first_shingles(sets: DataFrame, share: float) -> DataFrame:
    """(same, n, central, left, shingle, p0, ..): of each of sets the first shingles that a near copy must have one of, but those that no other has.

    They are ordered by _levels, then by value. Any order that is the same for all sets finds the same links; one by
    rarity finds them from fewer meetings. left: the shingles from this one on; central: the set's mean level;
    p0, ..: whether the number of the set's shingles is odd, for each low end of hashes: sets differ in as many shingles
    as in parities, or more.
    """
    levels = sets.sparkSession.sparkContext.broadcast(_levels(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                n, value = batch.column(1).value_lengths().to_numpy().astype(np.int64), batch.column(1).flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                level = levels.value[value.view(U64) >> U64(64 - SLOT_BITS)]
                central = np.bincount(row, level, len(n)) / np.maximum(n, 1)
                order, rank = np.lexsort((value, level, row)), ragged(n)
                first = n - np.ceil(share * n - 1e-9).astype(np.int64) + 1
                on = (rank < first[row]) & (level[order] > 0)
                odd = np.bincount(row * 64 * PARITIES + value % (64 * PARITIES), minlength=64 * PARITIES * len(n)) % 2
                odd = np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(len(n), PARITIES)
                row, left = row[on], (n[row] - rank)[on]
                columns = {"same": batch.column(0).take(pa.array(row)), "n": pa.array(n[row], pa.int32()), "central": pa.array(central[row]), "left": pa.array(left, pa.int32()), "shingle": pa.array(value[order][on])}
                yield pa.RecordBatch.from_pydict(columns | {name: pa.array(odd[row, k]) for k, name in enumerate(_PARITIES)})
            given_back()

    met = checkpointed(sets.select("same", "shingles").mapInArrow(run, "same bigint, n int, central double, left int, shingle bigint, " + ", ".join(f"{name} bigint" for name in _PARITIES)))
    levels.destroy()
    return met


def dense_links(sets: DataFrame, share: float) -> DataFrame:
    """Links (a, b) that unite all of sets (same, shingles) that are near copies of each other, none other.

    Shingles are ordered by how many texts have them (see _levels). A near copy of a text with n shingles has one of the first
    n - ceil(share * n) + 1 of them, and that text one of its first; and from the first one they share on, both have as
    many shingles left as the pair must have in common. Where texts meet at such a shingle, each is first
    compared with the most central one it meets: that whose shingles most texts have; then with the most central one of
    another component; then pairs of different components are compared that do not differ in too many parities.
    """
    met = _first_shingles(sets, share)
    links, tried = None, None
    for again in (False, True):
        if again:
            found = components(links).select(loose(F.col("node")).alias("linked"), "component")
            placed = met.join(found.hint("merge"), F.col("same") == F.col("linked"), "left").withColumn("c", F.coalesce("component", "same"))
        else:
            placed = met.withColumn("c", F.col("same"))
        top = placed.groupBy("shingle").agg(F.max(F.struct("central", "c", "same")).alias("top")).select(loose(F.col("shingle")).alias("at"), "top")
        beside = placed.join(top.hint("merge"), F.col("shingle") == F.col("at")).where(F.col("c") != F.col("top.c"))
        if again:  # the most central one of all others, for those of the top's own component
            mixed = beside.groupBy("shingle").agg(F.max(F.struct("central", "c", "same")).alias("next")).select(loose(F.col("shingle")).alias("open"), "next")
            other = placed.join(mixed.hint("merge"), F.col("shingle") == F.col("open")).where(F.col("c") != F.col("next.c")).select("same", F.col("next").alias("hub"))
            beside = beside.select("same", F.col("top").alias("hub")).unionAll(other)
        else:
            beside = beside.select("same", F.col("top").alias("hub"))
        hubs = beside.groupBy("same").agg(F.max("hub").alias("hub")).select(*_pairs("same", "hub.same")).distinct()
        new = checkpointed(hubs if tried is None else hubs.join(tried, ["a", "b"], "left_anti"))
        tried = new if tried is None else tried.unionAll(new)
        close = _alike(new, sets, share)
        links = close if links is None else links.unionAll(close)
    found = components(links).select(loose(F.col("node")).alias("linked"), "component")
    placed = met.join(found.hint("merge"), F.col("same") == F.col("linked"), "left").select("shingle", "same", "n", "left", *_PARITIES, F.coalesce("component", "same").alias("c"))
    mixed = placed.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select(loose(F.col("shingle")).alias("open"))
    one = checkpointed(placed.join(mixed.hint("merge"), F.col("shingle") == F.col("open"), "left_semi"))
    two = one.select(*[F.col(c).alias(f"{c}_") for c in one.columns])
    like = F.least("left", "left_") >= F.lit(share / (1 + share)) * (F.col("n") + F.col("n_")) - 1e-9
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_"))) for p in _PARITIES), F.lit(0))
    like &= apart <= F.lit((1 - share) / (1 + share)) * (F.col("n") + F.col("n_")) + 1e-6
    rest = one.join(two, (F.col("shingle") == F.col("shingle_")) & (F.col("same") < F.col("same_")) & (F.col("c") != F.col("c_")) & like).select(*_pairs("same", "same_")).distinct()
    return links.unionAll(_alike(checkpointed(rest.join(tried, ["a", "b"], "left_anti")), sets, share))


def near_copies(df: DataFrame, share: float = SHARE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, component, component_id) for each row, linked by share or more of distinct shingles in common. Ids are integers.

    tie: xxhash64 of the text; component: a number of the row's component; component_id: the smallest id in it. Texts
    without words are copies of one another. Repeated ids keep a row for each of their texts, which may be of several
    components; rows without an id link nothing and have neither.
    """
    texts = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    prints = checkpointed(_described(texts, shingle))
    distinct = checkpointed(prints.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in ("n", *_LANES)]))
    count = distinct.count()
    width, splits = block_splits(count)
    blocks = 64 * LANES // width * splits
    spread = distinct.repartition(max(1, -(-count * blocks // 1_000_000)), "same")
    plain = _dealt(spread.withColumn("dense", F.lit(False)), width, splits)
    hot = checkpointed(plain.groupBy("key").count().where(F.col("count") > MEET).select(F.col("key").alias("hot")))
    many = hot.count()
    links = None
    if many:
        small = F.broadcast(hot) if many <= 1 << 16 else hot
        dense = checkpointed(plain.join(small, F.col("key") == F.col("hot"), "left_semi").select("same").distinct())
        links = dense_links(_sets(dense, distinct, texts, shingle), share)
        marked = spread.join(dense.select(F.col("same").alias("d")).hint("merge"), F.col("same") == F.col("d"), "left").withColumn("dense", F.col("d").isNotNull())
        plain = _dealt(marked, width, splits).join(small, F.col("key") == F.col("hot"), "left_anti")
    pairs = checkpointed(_meetings(plain.repartition("key").sortWithinPartitions("key").select("key", "same", "n", "f0", "dense"), share).distinct())
    bits = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in _LANES), F.lit(0))
    close = checkpointed(_beside(pairs, distinct, _LANES).where(bits <= FAR).select("a", "b"))
    need = close.select(F.explode(F.array("a", "b")).alias("same")).distinct()
    cold = _alike(close, _sets(need, distinct, texts, shingle), share)
    found = components(cold if links is None else links.unionAll(cold)).select(loose(F.col("node")).alias("linked"), "component")
    known = distinct.join(found.hint("merge"), F.col("same") == F.col("linked"), "left").select("same", "node", F.coalesce("component", "same").alias("component"))
    smallest = known.groupBy("component").agg(F.min("node").alias("component_id")).select(loose(F.col("component")).alias("c"), "component_id")
    known = known.join(smallest.hint("merge"), F.col("component") == F.col("c")).select(loose(F.col("same")).alias("of"), "component", "component_id")
    out = prints.join(known.hint("merge"), F.col("same") == F.col("of"), "left")
    has = F.col("doc_id").isNotNull()
    return out.select("doc_id", "tie", F.when(has, F.col("component")).alias("component"), F.when(has, F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, share: float = SHARE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near copies, that of the smallest id (then of the smallest hash of its text); rows without an id all stay."""
    own_id, own_tie = (next(n + "_" * k for k in range(2, 99) if n + "_" * k not in df.columns) for n in ("id", "tie"))
    rows = checkpointed(near_copies(df, share, shingle, id_col, text_col).where("doc_id is not null").groupBy("doc_id", "tie").agg(F.min("component").alias("component"), F.count("*").alias("rows")))
    chosen = rows.groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("keep")).select(loose(F.col("component")).alias("c"), "keep")
    judged = rows.join(chosen, F.col("component") == F.col("c")).select(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie), "rows", ((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("tie") != F.col("keep.tie"))).alias("goes"))
    judged = checkpointed(judged.where("goes or rows > 1"))
    mine = (F.col(id_col).cast("bigint") == F.col(own_id)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(own_tie))
    stays = df.join(judged.select(own_id, own_tie), mine, "left_anti")
    again = judged.where("not goes").select(own_id, own_tie)
    return stays if again.isEmpty() else stays.unionAll(df.join(again, mine, "left_semi").dropDuplicates([id_col]))
