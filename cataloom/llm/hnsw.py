"""The k most similar vectors of every vector: cells of near vectors, each searched whole, or by a navigable small-world graph where it is large.

* Vectors of another length, all zero, null or not finite are not usable and take no part.
* Coarse centroids, fitted on a bounded sample, route vectors to cells: each vector is stored in the cell of its nearest centroid and
  searched for in the cells of its ``probes`` nearest ones. Their number is tuned at every size, up to all: of the exact neighbours of a sample
  of queries, searched for in all rows, ``TUNED_RECALL`` must lie in the cells probed. A cell with more than ``shard_rows`` vectors (a dense category) is
  split by hash into shards of that size, each of which is searched; its queries are split into blocks of ``ASK_ROWS``.
* Up to ``SCAN_ROWS`` stored vectors a shard's queries are answered by a matrix product, which finds all of its neighbours and costs less than a graph. A larger shard (``shard_rows`` set higher)
  builds a hierarchical small-world graph: per level one int32 array of neighbours, row after row, walked by batches of queries in lock step.
* The shards' answers are merged per query.

Defined cases: a key that repeats counts once (of differing vectors, the one of the least hash); a null key is left out; equal vectors are each other's nearest, ties go to
the smaller key; a collection of fewer than k + 1 vectors gives what there is; an empty table gives no rows; extra columns aren't read.

Scale: a vector is stored and shuffled as it was given, in half precision where that is exact, byte planes apart and compressed by Zstandard; only vectors of repeating keys are shuffled before that. Near cells travel in groups of
``GROUP_CELLS``, to which a vector goes once, whatever number of their cells it is stored or searched for in. Dense cells travel alone, in a grid of splits and blocks of queries.
Beyond ``MAX_CENTROIDS`` times ``shard_rows`` vectors cells have several splits, each of which gets all queries of the cell. Samples are drawn by a threshold on the key's hash, so nothing
but them reaches the driver (25 MB at most). Centroids (at most ``MAX_CENTROIDS`` of one vector each) are broadcast, and the sampled queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.session import drawn, staged

K, DIM = 10, 384
SHARD_ROWS = 6000
CENTROID_ROWS = 2000  # vectors per centroid aimed at
MAX_CENTROIDS = 4096
SAMPLE_ROWS = 16_384  # fitted on at most so many vectors
PROBES = 1  # at least
ASK_ROWS = 8_000  # queries of a shard that one task answers
MAX_TASKS = 20_000
TUNED_RECALL, TUNE_QUERIES = 0.999, 1000
SCAN_ROWS, SCAN_PAIRS = 50_000, 4_000_000  # stored vectors up to which a matrix product is cheaper than walking a graph; pairs of a product
GROUP_CELLS = 16  # near cells that travel together, so that a query of several of them goes to them once
MOST_DOUBLED = 500_000  # repeating keys that are broadcast; more are joined by the planner
DEGREE, EF_BUILD, EF_SEARCH, WAVE = 16, 64, 64, 4


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = 7, batch: int = 512):
        self.x, self.degree = np.ascontiguousarray(x, np.float32), degree
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        top = max(0, int(math.log(max(n, 1)) / math.log(degree)) - 1)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(degree)).astype(np.int64), top)
        self.width = [2 * degree] + [degree] * top
        self.neighbours = [np.full((n, w), -1, np.int32) for w in self.width]
        # the highest nodes come first, so that upper levels stand before lower ones are filled
        self.order = np.argsort(-self.level, kind="stable")
        self.entry = int(self.order[0]) if n else -1
        done = 0
        while done < n:
            # a batch is never larger than the graph it joins, once that has begun
            step = min(batch, max(64, done), n - done)
            self._insert(self.order[done : done + step], done, ef)
            done += step

    def _insert(self, new: np.ndarray, done: int, ef: int) -> None:
        q = self.x[new]
        among = q @ q.T
        start = np.full((len(new), 1), self.entry, np.int32) if done else None
        for level in range(len(self.width) - 1, -1, -1):
            mine = np.flatnonzero(self.level[new] >= level)
            if start is not None:
                ids, sims = self._walk(q, start, level, ef if len(mine) else 1)
                start = ids[:, : max(1, min(8, ids.shape[1]))]
            if not len(mine):
                continue
            peers = new[mine]
            # candidates: what the graph holds, and the other newcomers of this level
            inner = among[np.ix_(mine, mine)].copy()
            np.fill_diagonal(inner, -2)
            take = min(self.width[level], len(mine) - 1)
            best = np.argpartition(-inner, take - 1, axis=1)[:, :take] if take > 0 else np.zeros((len(mine), 0), np.int64)
            cand, sim = peers[best].astype(np.int32), np.take_along_axis(inner, best, 1)
            if start is not None:
                cand, sim = np.concatenate([cand, ids[mine]], 1), np.concatenate([sim, sims[mine]], 1)
            chosen, weight = self._diverse(cand, sim, self.degree)
            self.neighbours[level][peers, : self.degree] = chosen
            self._reverse(level, peers, chosen, weight)

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates up to ``degree``, nearest first, those that lie nearer to the row than to what is chosen; then the nearest others."""
        rows = np.arange(len(cand))[:, None]
        order = np.argsort(-np.where(cand >= 0, sim, -3), axis=1, kind="stable")[:, : 3 * degree]
        cand, sim = cand[rows, order], np.where(cand >= 0, sim, -3)[rows, order]
        vectors = self.x[np.maximum(cand, 0)]
        between = np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
        m = cand.shape[1]
        kept = np.zeros(cand.shape, bool)
        closest = np.full(cand.shape, -2.0, np.float32)
        for i in range(m):
            kept[:, i] = (sim[:, i] > -2) & (closest[:, i] < sim[:, i]) & (kept.sum(1) < degree)
            closest = np.where(kept[:, i : i + 1], np.maximum(closest, between[:, i]), closest)
        final = np.argsort(np.where(sim <= -2, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :degree]
        out, weight = cand[rows, final], sim[rows, final]
        out = np.where(weight > -2, out, -1)
        if out.shape[1] < degree:
            pad = degree - out.shape[1]
            out, weight = np.pad(out, ((0, 0), (0, pad)), constant_values=-1), np.pad(weight, ((0, 0), (0, pad)), constant_values=-3)
        return out.astype(np.int32), weight

    def _reverse(self, level: int, source: np.ndarray, chosen: np.ndarray, weight: np.ndarray) -> None:
        table, width = self.neighbours[level], self.width[level]
        to, frm, sim = chosen.ravel(), np.repeat(source, chosen.shape[1]).astype(np.int32), weight.ravel()
        ok = to >= 0
        to, frm, sim = to[ok], frm[ok], sim[ok]
        order = np.lexsort((-sim, to))
        to, frm, sim = to[order], frm[order], sim[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        most = min(int(count.max(initial=0)), 2 * width)
        extra, extra_sim = np.full((len(nodes), most), -1, np.int32), np.full((len(nodes), most), -3, np.float32)
        slot = np.arange(len(to)) - np.repeat(first, count)
        fits = slot < most
        row = np.repeat(np.arange(len(nodes)), count)[fits]
        extra[row, slot[fits]], extra_sim[row, slot[fits]] = frm[fits], sim[fits]
        for k in range(0, len(nodes), 1024):
            part, add, add_sim = nodes[k : k + 1024], extra[k : k + 1024], extra_sim[k : k + 1024]
            old = table[part]
            add = np.where((add[:, :, None] == old[:, None, :]).any(2), -1, add)
            used = (old >= 0).sum(1) + (add >= 0).sum(1)
            simple = used <= width
            merged = np.concatenate([old, add], 1)
            if simple.any():
                pack = np.argsort(merged[simple] < 0, axis=1, kind="stable")[:, :width]
                table[part[simple]] = np.take_along_axis(merged[simple], pack, 1)
            full = np.flatnonzero(~simple)
            for j in range(0, len(full), 128):
                f = full[j : j + 128]
                old_sim = np.einsum("bd,bmd->bm", self.x[part[f]], self.x[np.maximum(old[f], 0)], optimize=True)
                table[part[f]] = self._diverse(merged[f], np.concatenate([old_sim, add_sim[f]], 1), width)[0]

    def _walk(self, q: np.ndarray, start: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes found from ``start`` for each query, best first."""
        b, n = len(q), len(self.x)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)  # the last column stands for "no node"
        seen[:, n] = True
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -3, np.float32)
        opened = np.ones((b, ef), bool)
        fresh = start[:, :ef].astype(np.int32)
        # equal starts of a row count once
        fresh = np.where(np.array([[v in r[:i] for i, v in enumerate(r)] for r in fresh.tolist()]) if fresh.shape[1] > 1 else False, -1, fresh)
        live = np.arange(b)
        table = self.neighbours[level]
        while True:
            lr = np.arange(len(live))[:, None]
            at = np.where(fresh >= 0, fresh, n)
            new = ~seen[live[:, None], at]
            seen[live[:, None], at] = True
            seen[live, n] = True
            # only new nodes are gathered
            r, c = np.nonzero(new)
            s = np.full(fresh.shape, -3, np.float32)
            if len(r):
                s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[fresh[r, c]], optimize=True)
            all_ids = np.concatenate([ids[live], np.where(new, fresh, -1)], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([opened[live], ~new], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[live], sims[live], opened[live] = all_ids[lr, order], all_sims[lr, order], all_open[lr, order]
            waiting = ~opened[live]
            more = waiting.any(1)
            live = live[more]
            if not len(live):
                return ids, sims
            waiting = waiting[more]
            wave = min(WAVE, ef)
            pick = np.argsort(~waiting, axis=1, kind="stable")[:, :wave]
            lr = np.arange(len(live))[:, None]
            valid = waiting[lr, pick]
            opened[live[:, None], pick] |= valid
            nodes = ids[live[:, None], pick]
            fresh = np.where(valid[:, :, None], table[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            # a node that two opened nodes name is gathered once
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities) of the k best of each query, best first; -1 where there are fewer."""
        ef = max(ef, k)
        found = []
        for i in range(0, len(q), batch):
            part = np.ascontiguousarray(q[i : i + batch], np.float32)
            start = np.full((len(part), 1), self.entry, np.int32)
            for level in range(len(self.width) - 1, -1, -1):
                ids, sims = self._walk(part, start, level, ef if level == 0 else 4)
                start = ids
            found.append((ids[:, :k], sims[:, :k]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# ---------------------------------------------------------------- distribution


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v: binary float32 of unit length), one row per key."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, v binary"
    once = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim)).groupBy(key).agg(F.min_by(vector, F.xxhash64(vector)).alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
            keep = np.ones(batch.num_rows, bool)
            if len(x) != batch.num_rows * dim or np.isnan(x).any():  # nulls inside a vector arrive as NaN
                lists = batch.column(1).to_pylist()
                x = np.array([[np.nan if e is None else e for e in v] for v in lists], np.float64)
            x = x.reshape(-1, dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
                keep = np.isfinite(norm) & (norm > 0)
                x = (x[keep] / norm[keep, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.flatnonzero(keep))), pa.array([r.tobytes() for r in x], pa.binary())], names=[key, "v"])

    return once.mapInArrow(unit, schema)


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, dim)


def fit_centroids(x: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    if not len(x):
        return np.zeros((0, x.shape[1]), np.float32)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres


def tuned_probes(vectors: DataFrame, asked: DataFrame, key: str, k: int, dim: int, centres: np.ndarray) -> tuple[int, float]:
    """(probes, recall): the least number of cells, PROBES at least, that hold the exact neighbours of a sample of ``asked`` in all ``vectors`` to TUNED_RECALL."""
    least = min(PROBES, len(centres))
    if least == len(centres):
        return least, 1.0
    sample = drawn(asked.select(key, "v"), key, TUNE_QUERIES, asked.count(), 1).toPandas()
    if not len(sample):
        return least, 1.0
    q = matrix(sample["v"], dim)
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    rank = np.empty(order.shape, np.int32)
    np.put_along_axis(rank, order, np.arange(len(centres), dtype=np.int32)[None, :], 1)
    sent = vectors.sparkSession.sparkContext.broadcast((q, sample[key].to_numpy(), rank, centres))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task's k best of each query
        q, keys, rank, centres = sent.value
        sims, ranks = np.full((len(q), k), -3, np.float32), np.full((len(q), k), -1, np.int32)
        for whole in batches:
            for start in range(0, len(whole), 2000):
                pdf = whole.iloc[start : start + 2000]
                x = matrix(pdf["v"], dim)
                found = np.where(keys[:, None] == pdf[key].to_numpy()[None, :], -3, q @ x.T)
                both = np.concatenate([sims, found], 1)
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                cells = np.concatenate([ranks, rank[:, (x @ centres.T).argmax(1)]], 1)
                sims, ranks = np.take_along_axis(both, best, 1), np.take_along_axis(cells, best, 1)
        i, j = np.nonzero(sims > -2)
        yield pd.DataFrame({"query": i.astype(np.int32), "similarity": sims[i, j], "rank": ranks[i, j]})

    found = vectors.select(key, "v").mapInPandas(nearest, "query int, similarity float, rank int")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "rank"))
    found = found.withColumn("best", best).where(F.col("best") <= k).groupBy("rank").count().toPandas()  # a row per centroid at most
    by_rank = np.zeros(len(centres), np.int64)
    by_rank[found["rank"]] = found["count"]
    if not by_rank.sum():
        return least, 1.0
    share = np.cumsum(by_rank) / by_rank.sum()
    probes = max(least, int(np.flatnonzero(share >= TUNED_RECALL)[0]) + 1)
    return probes, float(share[probes - 1])


def packed(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, lo, hi) of each usable vector as it was given: its low and its high bytes, in half precision where that holds all its values exactly. Zstandard takes them for half the size of normalised floats."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, lo binary, hi binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            if len(flat) == batch.num_rows * dim and not flat.null_count:
                x = flat.to_numpy(zero_copy_only=False)
            else:
                x = np.array([[np.nan if e is None else e for e in v] for v in batch.column(1).to_pylist()])
            wide = np.asarray(x, np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt((wide * wide).sum(1))
                keep = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                wide, norm = wide[keep], norm[keep]
                # what a float doesn't hold is brought to unit length first
                x = np.where(((np.abs(wide).max(1, initial=0) < 1e30) & (norm > 1e-30))[:, None], wide, wide / norm[:, None]).astype("<f4")
                half = x.astype("<f2")
                exact = (half.astype("<f4") == x).all(1)
            lo, hi = np.empty(len(x), object), np.empty(len(x), object)
            for own, values in ((exact, half), (~exact, x)):
                if own.any():
                    planes = values[own].view(np.uint8).reshape(int(own.sum()), dim, -1).transpose(0, 2, 1)
                    lo[own] = [r.tobytes() for r in planes[:, :-1]]
                    hi[own] = [r.tobytes() for r in planes[:, -1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(lo, pa.binary()), pa.array(hi, pa.binary())], names=[key, "lo", "hi"])

    return rows.select(key, vector).mapInArrow(pack, schema)


def unpacked(lo: pa.Array, hi: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors."""
    low, high = lo.to_pylist(), hi.to_pylist()
    out = np.zeros((len(low), dim), np.float32)
    planes = np.array([len(x) // dim for x in low], np.int64)
    for count, kind in ((1, "<f2"), (3, "<f4")):
        own = np.flatnonzero(planes == count)
        if len(own):
            bytes_ = np.frombuffer(b"".join(part for i in own for part in (low[i], high[i])), np.uint8).reshape(len(own), count + 1, dim)
            x = np.ascontiguousarray(bytes_.transpose(0, 2, 1)).view(kind).reshape(len(own), dim).astype(np.float64)
            out[own] = x / np.sqrt((x * x).sum(1, keepdims=True))
    return out


def once(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vector) of each key once. Only the vectors of keys that repeat are shuffled."""
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim)).select(key, vector)
    doubled = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "hnsw-doubled")
    sent = F.broadcast(doubled) if doubled.count() <= MOST_DOUBLED else doubled
    chosen = rows.join(sent, key, "left_semi").groupBy(key).agg(F.min_by(vector, F.xxhash64(vector)).alias(vector))
    return rows.join(sent, key, "left_anti").unionByName(chosen)


def grouped(centres: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """The group of each centroid: near ones together, halved along the widest axis until a group has at most ``most`` of them."""
    out = np.zeros(len(centres), np.int64)
    queue, count = [np.arange(len(centres))], 0
    while queue:
        own = queue.pop()
        if len(own) <= max(1, most):
            out[own] = count
            count += 1
            continue
        x = centres[own] - centres[own].mean(0)
        order = own[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        total = np.cumsum(weight[order] + 1e-9)
        cut = min(len(own) - 1, max(1, int(np.searchsorted(total, total[-1] / 2))))
        queue += [order[:cut], order[cut:]]
    return out


def nearest_cells(x: np.ndarray, centres: np.ndarray, take: int) -> np.ndarray:
    sims = -(x @ centres.T)
    if take < len(centres):
        part = np.sort(np.argpartition(sims, take - 1, axis=1)[:, :take], axis=1)
        return np.take_along_axis(part, np.argsort(np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(sims, axis=1, kind="stable")


def scan(q: np.ndarray, own: np.ndarray, x: np.ndarray, at: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, similarity): of each query the k best of ``x``, ties by the smaller of the positions ``at``; a query's own position is left out."""
    found = []
    step = max(1, SCAN_PAIRS // max(1, len(x)))
    for start in range(0, len(q), step):
        sims = q[start : start + step] @ x.T
        sims[own[start : start + step, None] == at[None, :]] = -3
        floor = np.full(len(sims), -2.0 if least is None else least - 1e-6, np.float32)
        full = np.flatnonzero((sims >= floor[:, None]).sum(1) > k)
        if len(full):
            floor[full] = np.partition(sims[full], len(x) - k, axis=1)[:, len(x) - k]
        i, j = np.nonzero(sims >= floor[:, None])
        found.append((start + i, at[j], sims[i, j]))
    i, j, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return best_of(i, j, s, k)


def best_of(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], s[keep]


def neighbours(df: DataFrame, key: str, vector: str, k: int = K, dim: int = DIM, probes: int | None = None, shard_rows: int = SHARD_ROWS, queries: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(key, neighbour, similarity, rank) of each usable vector, or of those whose keys ``queries`` holds. ``probes`` are tuned unless given. With ``least`` only those of at least that similarity."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    vectors = staged(packed(once(df, key, vector, dim), key, vector, dim), "hnsw-vectors", compression="zstd")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in unpacked(batch.column(1), batch.column(2), dim)], pa.binary())], names=[key, "v"])

    units = lambda rows: rows.mapInArrow(unit, f"{key} {kind}, v binary")
    n = vectors.count()
    count = int(min(MAX_CENTROIDS, max(1, round(n / CENTROID_ROWS))))
    centres = np.zeros((1, dim), np.float32)
    if count > 1:
        centres = fit_centroids(matrix(units(drawn(vectors, key, SAMPLE_ROWS, n)).orderBy(F.xxhash64(key)).select("v").toPandas()["v"], dim), count)
    wanted = None if queries is None else queries.select(key).distinct()
    asked = vectors if wanted is None else staged(vectors.join(wanted, key, "left_semi"), "hnsw-asked", compression="zstd")
    if probes is None:
        probes = tuned_probes(units(vectors), units(asked), key, k, dim, centres)[0]
    take = min(probes, len(centres))
    sent = spark.sparkContext.broadcast(centres)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's vectors of each cell
        total = np.zeros((2, len(sent.value)), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = nearest_cells(unpacked(batch.column(1), batch.column(2), dim), sent.value, take)
                total += [np.bincount(near[:, 0], minlength=total.shape[1]), np.bincount(near.ravel(), minlength=total.shape[1])]
        cell = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cell, *total[:, cell])], names=["cell", "home", "near"])

    def loads(rows: DataFrame) -> np.ndarray:
        out = np.zeros((2, len(centres)), np.int64)
        for r in rows.mapInArrow(load, "cell long, home long, near long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("near").alias("near")).collect():  # a row per centroid at most
            out[:, r["cell"]] = r["home"], r["near"]
        return out

    stored_rows = loads(vectors)
    asked_rows = (stored_rows if wanted is None else loads(asked))[1]
    stored_rows = stored_rows[0]
    # a dense cell is a grid: each split of its vectors meets each block of its queries; the others travel in groups of near cells
    splits, turns = np.maximum(1, -(-stored_rows // shard_rows)), np.maximum(1, -(-asked_rows // ASK_ROWS))
    dense = splits * turns > 1
    groups = grouped(centres, stored_rows, min(GROUP_CELLS, len(centres) // (2 * spark.sparkContext.defaultParallelism)))
    grid = spark.sparkContext.broadcast((splits, turns, dense, groups))

    def send(stores: bool, asks: bool):
        def sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splits, turns, dense, groups = grid.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = nearest_cells(unpacked(batch.column(1), batch.column(2), dim), sent.value, take)
                own = np.array(batch.column(3).to_numpy())
                rows, cells, stored, shard = [], [], [], []
                for role, at, to in ((True, np.arange(len(near)), near[:, 0]), (False, np.repeat(np.arange(len(near)), take), near.ravel())):
                    if not (stores if role else asks):
                        continue
                    # a dense cell's vectors go to one split and all turns, its queries to all splits and one turn
                    times = np.where(dense[to], turns[to] if role else splits[to], 1)
                    at, to = np.repeat(at, times), np.repeat(to, times)
                    j = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    split, turn = (own[at] % splits[to], j) if role else (j, own[at] % turns[to])
                    rows.append(at)
                    cells.append(to)
                    stored.append(np.full(len(at), role))
                    shard.append(np.where(dense[to], MAX_CENTROIDS + (to * (1 << 24) + split) * (1 << 14) + turn, groups[to]))
                rows, cells, stored, shard = (np.concatenate(c) for c in (rows, cells, stored, shard))
                order = np.lexsort((rows, shard))
                edge = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
                for a, b in zip(edge, edge[1:]):
                    o = order[a:b]
                    texts, local = np.unique(rows[o], return_inverse=True)  # a vector enters a shard once
                    vectors = batch.select([0, 1, 2]).take(pa.array(texts))
                    roles = pa.RecordBatch.from_arrays([pa.array(local.astype(np.int32)), pa.array(cells[o].astype(np.int32)), pa.array(stored[o])], names=["row", "cell", "stored"])
                    yield pa.RecordBatch.from_arrays([pa.array([shard[o[0]]], pa.int64()), *(pa.array([_blob(x)], pa.binary()) for x in (vectors, roles))], names=["shard", "vectors", "roles"])

        return sending

    def sent_from(rows: DataFrame, stores: bool, asks: bool) -> DataFrame:
        return rows.select(key, "lo", "hi", F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("own")).mapInArrow(send(stores, asks), "shard long, vectors binary, roles binary")

    both = sent_from(vectors, True, True) if wanted is None else sent_from(vectors, True, False).unionByName(sent_from(asked, False, True))

    def answer(table: pa.Table) -> pa.Table:
        x, keys, row, cell, stored, base = [], [], [], [], [], 0
        for v, r in zip(table.column("vectors"), table.column("roles")):
            v, r = (pa.ipc.open_stream(c.as_py()).read_all().combine_chunks() for c in (v, r))
            x.append(unpacked(v.column(1).combine_chunks(), v.column(2).combine_chunks(), dim))
            keys.append(v.column(0))
            row.append(r.column("row").to_numpy() + base)
            cell.append(r.column("cell").to_numpy())
            stored.append(r.column("stored").to_numpy())
            base += v.num_rows
        x, row, cell, stored = (np.concatenate(c) for c in (x, row, cell, stored))
        keys = np.concatenate([k.to_numpy() for k in keys])
        # positions are ranks of keys; a vector that came in two blobs has one
        unique, rank = np.unique(keys, return_inverse=True)
        found = []
        for c in np.unique(cell[stored]):
            s, q = row[stored & (cell == c)], row[~stored & (cell == c)]
            if not len(q):
                continue
            s = s[np.argsort(rank[s])]
            if len(s) <= SCAN_ROWS:
                i, j, sims = scan(x[q], rank[q], x[s], rank[s], k, least)
            else:
                at, sims = Graph(x[s]).search(x[q], k + 1)
                i, j = np.repeat(np.arange(len(q)), at.shape[1]), rank[s][np.maximum(at.ravel(), 0)]
                ok = (at.ravel() >= 0) & (j != rank[q][i])
                i, j, sims = i[ok], j[ok], sims.ravel()[ok]
            found.append((rank[q][i], j, sims))
        i, j, sims = best_of(*(np.concatenate(c) for c in zip(*found)), k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        sims = sims.astype(np.float64)
        if least is not None:
            i, j, sims = i[sims >= least], j[sims >= least], sims[sims >= least]
        kind_of = pa.ipc.open_stream(table.column("vectors")[0].as_py()).schema.field(0).type
        return pa.table({key: pa.array(unique[i], kind_of), "neighbour": pa.array(unique[j], kind_of), "similarity": pa.array(sims)})

    tasks = int(groups.max()) + 1 + int((splits * turns)[dense].sum())
    # several partitions a shard, so that seldom two fall into one task
    found = both.repartition(min(MAX_TASKS, 4 * tasks), "shard").groupBy("shard").applyInArrow(answer, f"{key} {kind}, neighbour {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def recall(df: DataFrame, found: DataFrame, key: str, vector: str, k: int = K, dim: int = DIM, sample: int = TUNE_QUERIES) -> float:
    """Share of the exact k nearest of about ``sample`` of the answered queries, searched for in all rows, that ``found`` holds; ties at the edge count as found."""
    spark = df.sparkSession
    vectors = staged(usable(df, key, vector, dim), "recall-vectors")
    answered = found.select(key).distinct()
    asked = drawn(vectors.join(answered, key, "left_semi"), key, sample, answered.count(), 2).toPandas()
    if not len(asked):
        return 1.0
    sent = spark.sparkContext.broadcast((matrix(asked["v"], dim), asked[key].to_numpy()))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, keys = sent.value
        sims = np.full((len(q), k), -3, np.float32)
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part = pdf.iloc[start : start + 2000]
                both = np.concatenate([sims, np.where(keys[:, None] == part[key].to_numpy()[None, :], -3, q @ matrix(part["v"], dim).T)], 1)
                sims = -np.partition(-both, k - 1, axis=1)[:, :k]
        yield pd.DataFrame({key: np.repeat(keys, k), "similarity": sims.ravel().astype(np.float64)})

    best = vectors.mapInPandas(nearest, f"{key} {df.schema[key].dataType.simpleString()}, similarity double").where("similarity > -2")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("similarity")))
    edge = best.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(key).agg(F.min("similarity").alias("edge"), F.count(F.lit(1)).alias("n"))
    hits = found.join(edge, key).where(F.col("similarity") >= F.col("edge") - 1e-6).groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    return edge.join(hits, key, "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")) / F.sum("n")).first()[0]


def similar_pairs(found: DataFrame, key: str, least: float) -> DataFrame:
    """(<key>_a, <key>_b), a < b, of neighbours of at least that similarity, each pair once."""
    return (
        found.where(F.col("similarity") >= least)
        .select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b"))
        .distinct()
    )
