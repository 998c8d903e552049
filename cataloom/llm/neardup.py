"""Near-duplicate texts: an exact Jaccard self-join of word shingles, partitioned, bounded and verified.

The metric-space method named for this problem (pivots, Voronoi regions, triangle-inequality windows) can't give the result here: the
README has the figures. Texts of this kind lie at distances of 0.9 to 1 from any pivot, while the windows are 0.4 wide, so
nearly every text would be replicated into every region. The regions used instead are those of rare shingles, which partition the same
space exactly, and the windows are bounds on the symmetric difference, itself a metric:

1. A bounded table of counts (2**20 to 2**24 cells by the length of all texts, summed over all texts) orders the shingles from rare to common, ties by hash.
2. Two sets of Jaccard similarity t share one of the first ``n - ceil(t n) + 1`` shingles of each in that order; each text is replicated to
   the regions of those shingles and to no others.
3. Inside a region, entries are ordered by length and meet only those that their length and position leave; pairs must pass the length, the position and the sketch window: a parity sketch of 128 or 256 bits changes by at most one
   bit per differing shingle, so two texts whose sketches differ in more bits than the largest allowed symmetric difference are no pair.
   A region's pairs are compared in vectorised blocks; the region of a shingle counted more than ``HOT`` times (four times the mean of a cell where that is more) is split into a triangular
   grid of block pairs, each a region of its own, so a hot region becomes many tasks and still meets every pair once.
4. What passes is verified exactly on the shingle sets.

Texts with equal sets are one class: only classes are compared, and members are joined back last. No pair is lost or capped.

Defined cases: null and short texts (fewer than ``min_words`` words) take part in nothing; of a review_id that repeats, the latest
version counts; rows with a null key are left out; texts that repeat exactly form a class and all pairs of its members are pairs (``pairs``) or one class id
(``groups``); very long texts are compared whole; an empty table gives no rows; extra columns aren't read. Shingles and classes are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.words import WORD, Hasher, mix, shingles
from cataloom.operators.components import components
from cataloom.session import join_hot, staged

THRESHOLD, SIZE, MIN_WORDS = 0.6, 3, 40
CELL_BITS, MOST_BITS, CELL_LOAD = 20, 24, 4096  # of the table of counts: at least, at most (64 MB), shingles a cell aimed at
BLOCK = 1 << 14
HOT = 20_000
PART_BYTES, ENTRY_BYTES = 48 << 20, 56  # of a part of the join, and of an entry with its text's record
HOT_CLASS = 0.001  # classes with a larger share of the members are joined by broadcast
WIDE = 70  # texts with more shingles carry 256 bits instead of 128


# ---------------------------------------------------------------- shingle sets


def shingle_sets(texts: list[str | None], hasher: Hasher, size: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, shingles): the sorted distinct shingles of each row that has enough words, one row's after another's."""
    words: list[str] = []
    rows, counts = [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        found = WORD.findall(text.lower())
        if len(found) >= min_words and len(found) >= size:
            rows.append(i)
            counts.append(len(found))
            words += found
    if not rows:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    counts = np.array(counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    all_shingles = shingles(hasher.words(words), size)
    inside = owner[: len(all_shingles)] == owner[size - 1 :]
    h, o = all_shingles[inside], owner[: len(all_shingles)][inside]
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    start = np.searchsorted(o, np.arange(len(rows) + 1))
    return np.array(rows), start, h


def class_ids(start: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An id of each set, whatever the order of its shingles."""
    if len(start) == 1:
        return np.zeros(0, np.int64)
    total = np.add.reduceat(mix(h + np.uint64(0x51ED270B)), start[:-1])
    return mix(total + np.diff(start).astype(np.uint64)).view(np.int64)


def sketches(start: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Parity sketch of 256 bits of each set, as 4 words; the two halves' XOR is the sketch of 128 bits."""
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    bit = (h >> np.uint64(40)) & np.uint64(255)
    word = ((bit >> np.uint64(6)) & np.uint64(3)).astype(np.int64)
    out = np.zeros(n * 4, np.uint64)
    key = owner * 4 + word
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    if len(k):
        out[k[first]] = np.bitwise_xor.reduceat((np.uint64(1) << (bit & np.uint64(63)))[order], first)
    return out.reshape(n, 4)


def cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(8)).astype(np.int64) & (cells - 1)


def cell_count(characters: int) -> int:
    """Cells for texts of so many characters in all, at six a shingle."""
    return 1 << min(MOST_BITS, max(CELL_BITS, math.ceil(math.log2(max(1, characters / 6 / CELL_LOAD)))))


# ---------------------------------------------------------------- pass 0: classes and counts


def _census(df: DataFrame, key: str, text: str, order: str, size: int, min_words: int, cells: int) -> DataFrame:
    """Rows of kind 0 (key, order, class) and of kind 1 (block of cells, counts)."""
    schema = f"kind int, {key} {df.schema[key].dataType.simpleString()}, at {df.schema[order].dataType.simpleString()}, class long, block int, counts binary"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(cells, np.int64)
        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, batch.schema.field(1).type]
            rows, start, h = shingle_sets(batch.column(2).to_pylist(), hasher, size, min_words)
            np.add.at(total, cell(h, cells), 1) if len(h) < cells // 64 else np.add(total, np.bincount(cell(h, cells), minlength=cells), out=total)
            at = pa.array(rows, pa.int64())
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(class_ids(start, h)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["kind", key, "at", "class", "block", "counts"],
            )
        if types is None:
            return
        blocks = [b for b in range(cells // BLOCK) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        n = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(n, np.int32)), pa.nulls(n, types[0]), pa.nulls(n, types[1]), pa.nulls(n, pa.int64()), pa.array(blocks, pa.int32()),
                pa.array([total[b * BLOCK : (b + 1) * BLOCK].astype(np.uint32).tobytes() for b in blocks], pa.binary()),
            ],
            names=["kind", key, "at", "class", "block", "counts"],
        )

    return df.select(key, order, text).mapInArrow(mapped, schema)


def _sum_cells(census: DataFrame, count: int) -> np.ndarray:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    # every 64 tasks' counts are added before the last sum, so no task holds more than the square root of all of them
    some = census.where("kind = 1").select("block", "counts").withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int"))
    partly = some.groupBy("block", "part").applyInPandas(lambda p: add(p.drop(columns="part")), "block int, counts binary")
    cells = np.zeros(count, np.uint32)
    for r in partly.groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():  # at most 1,024 rows of 64 KB
        cells[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint32)
    return cells


# ---------------------------------------------------------------- pass 1: replication to regions


def prefix_lengths(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def replicas(start: np.ndarray, h: np.ndarray, cells: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, position, shingle) of the prefix of each set in the order of rarity."""
    n = np.diff(start)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, cells[cell(h, len(cells))], owner))
    position = np.arange(len(h)) - np.repeat(start[:-1], n)
    keep = position < np.repeat(prefix_lengths(n, threshold), n)
    return owner[keep], position[keep], h[order][keep]


def pack(owner: np.ndarray, position: np.ndarray, shingle: np.ndarray, part: np.ndarray, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, bytes): the texts that touch a part, once each, and their (region, position) entries there."""
    order = np.lexsort((owner, part))
    bounds = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(bounds, bounds[1:]):
        at = order[a:b]
        texts, local = np.unique(owner[at], return_inverse=True)
        wide = n[texts] > WIDE
        narrow = sketch[texts[~wide]]
        yield int(part[order[a]]), b"".join(
            (
                np.array([len(texts), len(at)], np.int64).tobytes(),
                ids[texts].tobytes(),
                np.minimum(n[texts], 2**31 - 1).astype(np.int32).tobytes(),
                sketch[texts[wide]].tobytes(),
                (narrow[:, :2] ^ narrow[:, 2:]).tobytes(),
                shingle[at].astype(np.uint32).tobytes(),
                local.astype(np.uint16 if len(texts) < 2**16 else np.int32).tobytes(),
                np.minimum(position[at], 2**16 - 1).astype(np.uint16).tobytes(),
            )
        )


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(ids, n, narrow sketches, wide sketches, region, text, position) of all blobs together."""
    ids, ns, narrows, wides, regions, texts, positions = ([] for _ in range(7))
    base = 0
    for blob in blobs:
        count, entries = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        at = 16

        def take(kind, size):
            nonlocal at
            out = np.frombuffer(blob, kind, size, at)
            at += out.nbytes
            return out

        ids.append(take(np.int64, count))
        n = take(np.int32, count)
        ns.append(n)
        w = n > WIDE
        full = take(np.uint64, 4 * int(w.sum())).reshape(-1, 4)
        half = take(np.uint64, 2 * int((~w).sum())).reshape(-1, 2)
        narrow, wide = np.zeros((count, 2), np.uint64), np.zeros((count, 4), np.uint64)
        wide[w], narrow[w], narrow[~w] = full, full[:, :2] ^ full[:, 2:], half
        narrows.append(narrow)
        wides.append(wide)
        regions.append(take(np.uint32, entries))
        texts.append(take(np.uint16 if count < 2**16 else np.int32, entries).astype(np.int64) + base)
        positions.append(take(np.uint16, entries))
        base += count
    return tuple(np.concatenate(x) for x in (ids, ns, narrows, wides, regions, texts, positions))


def in_grid(owner: np.ndarray, position: np.ndarray, shingle: np.ndarray, ids: np.ndarray, heat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with those of hot regions (``heat`` over 1) replicated: the text in block i goes to row and column i of a triangular grid of ``heat`` blocks a side."""
    times = np.maximum(heat, 1)
    at = np.repeat(np.arange(len(owner)), times)
    j = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    owner, position, shingle, side = owner[at], position[at], shingle[at], times[at]
    hot = side > 1
    i = (mix(ids[owner[hot]].view(np.uint64)) % side[hot].astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(i, j[hot]), np.maximum(i, j[hot])
    shingle[hot] = mix(shingle[hot] + (low * 1_000_003 + high + 1).astype(np.uint64))
    return owner, position, shingle


def part_ids(spark: SparkSession, parts: int) -> np.ndarray:
    """An id for each part, chosen so that hash partitioning puts each into a partition of its own."""
    ids = spark.range(24 * parts).select(F.col("id").cast("int").alias("id"))
    rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("id")).collect()  # a number a part
    out = np.arange(parts) + 24 * parts  # where none was found, any
    for r in rows:
        out[r["at"]] = r["id"]
    return out


def _replicated(df: DataFrame, text: str, cells: np.ndarray, parts: int, threshold: float, size: int, min_words: int) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(cells)  # 4 to 64 MB
    ids_of_parts = part_ids(df.sparkSession, parts)
    hottest = max(HOT, int(4 * cells.sum(dtype=np.float64) / len(cells)))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), set()
        counts = sent.value
        for batch in batches:
            rows, start, h = shingle_sets(batch.column(0).to_pylist(), hasher, size, min_words)
            ids = class_ids(start, h)
            # a class leaves a task once, so copies held by a third of the rows arrive once per task
            _, first = np.unique(ids, return_index=True)
            fresh = np.zeros(len(ids), bool)
            fresh[[i for i in first if int(ids[i]) not in known]] = True
            known.update(ids[fresh].tolist())
            n = np.diff(start)
            h = h[np.repeat(fresh, n)]
            ids, n = ids[fresh], n[fresh]
            start = np.r_[0, np.cumsum(n)]
            owner, position, shingle = replicas(start, h, counts, threshold)
            # a hot region becomes a triangular grid: the text in block i goes to the grid's row and column i
            owner, position, shingle = in_grid(owner, position, shingle, ids, -(-counts[cell(shingle, len(counts))].astype(np.int64) // hottest))
            part = (shingle.astype(np.uint32) % np.uint32(parts)).astype(np.int64)
            blobs = list(pack(owner, position, shingle, part, ids, n, sketches(start, h)))
            yield pa.RecordBatch.from_arrays([pa.array([ids_of_parts[b[0]] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], names=["part", "blob"])

    return df.select(text).mapInArrow(mapped, "part int, blob binary")


# ---------------------------------------------------------------- pass 2: the join inside regions


def window(i: np.ndarray, j: np.ndarray, pi: np.ndarray, pj: np.ndarray, n: np.ndarray, narrow: np.ndarray, wide: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i, j), met at positions pi and pj, may reach the threshold."""
    a, b = n[i].astype(np.int64), n[j].astype(np.int64)
    need = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)
    # the first shared shingle leaves at most what follows it
    at = np.flatnonzero((np.minimum(a, b) >= need) & (a - pi >= need) & (b - pj >= need))
    i, j, most = i[at], j[at], (a + b - 2 * need)[at]
    x, y = narrow[i], narrow[j]
    differ = np.bitwise_count(x[:, 0] ^ y[:, 0]).astype(np.int64) + np.bitwise_count(x[:, 1] ^ y[:, 1])
    ok = differ <= most
    at, i, j, most = at[ok], i[ok], j[ok], most[ok]
    both = (n[i] > WIDE) & (n[j] > WIDE)
    differ = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1)
    return at[~both | (differ <= most)]


def partners(region: np.ndarray, size: np.ndarray, position: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the later entries that each may be a pair with, of entries in the order of region and size: those that aren't too long for what follows its position."""
    longest = np.floor((size - position) * ((1 + threshold) / threshold) + 1e-6).astype(np.int64) - size
    key = region.astype(np.uint64) << np.uint64(32)
    end = np.searchsorted(key | size.astype(np.uint64), key | np.clip(longest, 0, 2**32 - 1).astype(np.uint64), "right")
    first = np.arange(len(size)) + 1
    return first, np.maximum(end - first, 0)


def region_pairs(blobs: list[bytes], threshold: float, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) class ids, a < b, distinct, of the pairs that pass the windows in any region of a part."""
    ids, n, narrow, wide, region, text, position = unpack(blobs)
    # one text per class
    unique, canonical = np.unique(ids, return_inverse=True)
    first = np.zeros(len(unique), np.int64)
    first[canonical[::-1]] = np.arange(len(ids))[::-1]
    text = first[canonical[text]]
    key = region.astype(np.uint64) << np.uint64(32) | text.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    order = order[np.r_[True, key[1:] != key[:-1]]] if len(key) else order
    order = order[np.lexsort((n[text[order]], region[order]))]
    region, text, position = region[order], text[order], position[order].astype(np.int64)
    found: list[np.ndarray] = []

    def test(left: np.ndarray, right: np.ndarray) -> None:
        i, j = text[left], text[right]
        ok = window(i, j, position[left], position[right], n, narrow, wide, threshold)
        if len(ok):
            a, b = ids[i[ok]], ids[j[ok]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))

    first, reach = partners(region, n[text], position, threshold)
    before = np.r_[0, np.cumsum(reach)]
    at = 0
    while at < len(reach):
        to = max(at + 1, int(np.searchsorted(before, before[at] + chunk, "right")) - 1)
        left = np.repeat(np.arange(at, to), reach[at:to])
        test(left, np.arange(len(left)) - np.repeat(before[at:to] - before[at], reach[at:to]) + np.repeat(first[at:to], reach[at:to]))
        at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _candidates(replicated: DataFrame, threshold: float, parts: int) -> DataFrame:
    def join(table: pa.Table) -> pa.Table:
        a, b = region_pairs([x.as_py() for x in table.column("blob")], threshold)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return replicated.repartition(parts, "part").groupBy("part").applyInArrow(join, "a long, b long").distinct()


# ---------------------------------------------------------------- pass 3: verification


def _sets_of(df: DataFrame, key: str, text: str, wanted: DataFrame, size: int, min_words: int) -> DataFrame:
    """(class, items: array<long>) of the wanted keys, read again from the texts."""
    bits = 24
    bit = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    rows = (
        wanted.select(bit.alias("x"))
        .groupBy((F.shiftright("x", 15)).alias("block"))
        .agg(F.expr("bitmap_construct_agg(x & 32767)").alias("bits"))
        .collect()  # at most 512 bitmaps of 4 KB
    )
    mask = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        mask[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(mask)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, class long, items array<long>"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, mask = Hasher(), sent.value
        for batch in batches:
            x = batch.column(1).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(mask[x >> 3] >> (x & 7).astype(np.uint8) & 1)))
            rows, start, h = shingle_sets(batch.column(2).to_pylist(), hasher, size, min_words)
            items = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(class_ids(start, h)), items], names=[key, "class", "items"])

    read = df.where(F.col(key).isNotNull()).select(key, bit.alias("x"), text).mapInArrow(mapped, schema)
    return read.join(wanted.select(key, "class"), [key, "class"], "left_semi").dropDuplicates(["class"]).select("class", "items")


class NearDuplicates:
    """The join's parts: ``members`` (key, class), ``links`` (a, b, similarity) between classes; ``pairs`` and ``groups`` from them."""

    def __init__(self, df: DataFrame, key: str, text: str, order: str, threshold: float = THRESHOLD, size: int = SIZE, min_words: int = MIN_WORDS):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies in (0, 1]")
        spark = df.sparkSession
        self.key = key
        df = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        count = cell_count(df.agg(F.sum(F.length(text))).first()[0] or 0)
        census = staged(_census(df, key, text, order, size, min_words, count), "neardup-census")
        cells = _sum_cells(census, count)
        rank = F.struct(F.col("at"), F.col("class"))
        self.members = staged(census.where("kind = 0").groupBy(key).agg(F.max_by("class", rank).alias("class")), "neardup-members")
        # a part is what one task joins: their number follows the bytes
        entries = (1 - threshold) * float(cells.sum(dtype=np.float64))
        parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries * ENTRY_BYTES / PART_BYTES))
        candidates = staged(_candidates(_replicated(df, text, cells, parts, threshold, size, min_words), threshold, parts), "neardup-candidates")
        named = candidates.select(F.col("a").alias("class")).unionByName(candidates.select(F.col("b").alias("class"))).distinct()
        wanted = staged(self.members.join(named, "class", "left_semi").groupBy("class").agg(F.min(key).alias(key)), "neardup-wanted")
        sets = staged(_sets_of(df, key, text, wanted, size, min_words), "neardup-sets")
        shared = F.size(F.array_intersect("ia", "ib"))
        left = sets.select(F.col("class").alias("a"), F.col("items").alias("ia"))
        right = sets.select(F.col("class").alias("b"), F.col("items").alias("ib"))
        self.links = (
            candidates.join(left, "a")
            .join(right, "b")
            .select("a", "b", (shared / (F.size("ia") + F.size("ib") - shared)).alias("similarity"))
            .where(F.col("similarity") >= threshold - 1e-12)
        )

    def pairs(self) -> DataFrame:
        """(<key>_a, <key>_b), a < b: all pairs of keys, those within a class included. Large classes are salted."""
        key = self.key
        sizes = self.members.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("salts"))
        sized = join_hot(self.members, sizes, ["class"], F.col("salts") > 1000)
        a = sized.select(F.col("class").alias("ca"), F.col(key).alias("ka"), F.pmod(F.xxhash64(key), F.col("salts")).cast("int").alias("salt"))
        b = sized.select(F.col("class").alias("ca"), F.col(key).alias("kb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        same = a.join(b, ["ca", "salt"]).where("ka < kb").select("ka", "kb")
        # a link meets its classes' members in blocks of a thousand as well
        block = lambda c, k: sized.select(F.col("class").alias(c), F.col(key).alias(k), F.pmod(F.xxhash64(key), F.col("salts")).cast("int").alias(f"{c}_salt"))
        every = lambda df, c: df.join(sizes.select(F.col("class").alias(c), "salts"), c).withColumn(f"{c}_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        links = every(every(self.links.select("a", "b"), "a"), "b")
        other = links.join(block("a", "ka"), ["a", "a_salt"]).join(block("b", "kb"), ["b", "b_salt"]).select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
        return same.unionByName(other).select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))

    def groups(self) -> DataFrame:
        """(key, group_id, links): each key that takes part, the smallest class of its group, and the number of texts it is linked to, its copies apart."""
        links = staged(self.links.select("a", "b"), "neardup-links")
        group = components(links, "a", "b").select(F.col("id").alias("class"), F.col("component").alias("group_id"))
        degree = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
        sizes = self.members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
        total = self.members.agg(F.count(F.lit(1)).alias("total"))
        classes = sizes.join(group, "class", "left").join(degree, "class", "left").crossJoin(F.broadcast(total))  # one row
        classes = classes.select("class", F.coalesce("group_id", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("n") > HOT_CLASS * F.col("total")).alias("hot"))
        return join_hot(self.members, classes, ["class"], F.col("hot")).select(self.key, "group_id", "links")
