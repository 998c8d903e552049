"""Evaluation passages inside a training corpus: a prefix-filtered set join with exact verification over item-sized windows.

A document leaks an item when it holds at least ``run`` consecutive words of the item's passage. Every such run is a window of the
passage, and as a set of word shingles the window must be contained whole, so of each window's shingles in order of rarity a prefix of one is necessary: the
rarest. The join therefore

1. counts the passages' shingles over all documents (the order of rarity), and in the same pass keeps the documents in which as many of them stand in a row as a run has: others hold no window;
2. keeps for each window of each passage its rarest shingle;
3. joins the documents kept with those shingles, and only those;
4. drops a match whose window would begin before or end after the document or the passage (length and positional bounds);
5. verifies what is left to both sides of the match, word by word (words are compared by 64-bit hashes).

Case, punctuation, spacing, markup, entities, invisible characters, accents and compatibility forms are folded on both sides.

Defined cases: a null or empty text or passage leaks nothing, nor does a passage with fewer than ``run`` words; passages that repeat under other
item_ids each match; a passage with a null item_id is left out; repeated rows of a document give one row; empty tables give none; extra columns aren't read. Texts of any
length are searched whole.

Scale: documents are mapped where they lie and tokenised once a block; those kept are written to the shared folder. The items are a stated query set: they meet the corpus in blocks of at most
``block_words`` words, so what is broadcast has that bound; the counts that return are those of the block's own shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cataloom.llm.words import Hasher, plain_words, shingles
from cataloom.session import spread, staged

RUN = 10
SHINGLE = 3
BLOCK_WORDS = 2_000_000


def _blocks(items: DataFrame, item_key: str, passage: str, run: int, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item, word hashes) in bounded blocks, streamed to the driver."""
    hasher = Hasher()
    block, words = [], 0
    for r in items.where(F.col(item_key).isNotNull()).select(item_key, passage).distinct().toLocalIterator():
        hashes = hasher.words(plain_words(r[1]))
        if len(hashes) < run:
            continue
        block.append((r[0], hashes))
        words += len(hashes)
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def _document_shingles(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, text in enumerate(column):
        words = plain_words(text.as_py())
        if len(words) >= SHINGLE:
            hashes = hasher.words(words)
            yield i, hashes, shingles(hashes, SHINGLE)


def _longest_row(hit: np.ndarray) -> int:
    """Length of the longest row of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def _counted(documents: DataFrame, doc_key: str, text: str, known: np.ndarray, run: int) -> tuple[np.ndarray, DataFrame]:
    """How often each of the sorted shingles ``known`` occurs in all documents, and the documents that may hold a window."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(known)
    span = run - SHINGLE + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, hasher = sent.value, Hasher()
        total = np.zeros(len(ours), dtype=np.int64)
        schema = None
        for batch in batches:
            schema = schema or batch.schema
            kept, seen = [], [np.zeros(0, np.int64)]
            for i, _, found in _document_shingles(batch.column(1), hasher):
                at = np.searchsorted(ours, found)
                at[at == len(ours)] = 0
                hit = ours[at] == found
                seen.append(at[hit])
                if _longest_row(hit) >= span:
                    kept.append(i)
            total += np.bincount(np.concatenate(seen), minlength=len(ours))
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.int64())], names=[doc_key, text, "_at", "_n"])
        if schema is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), schema.field(0).type), pa.nulls(len(some), schema.field(1).type), pa.array(some), pa.array(total[some])], names=[doc_key, text, "_at", "_n"])

    kind = documents.schema[doc_key].dataType.simpleString()
    passed = staged(documents.select(doc_key, text).mapInArrow(count, f"{doc_key} {kind}, {text} string, _at long, _n long"), "leakage-documents")
    rows = passed.where("_at IS NOT NULL").groupBy("_at").agg(F.sum("_n").alias("n")).toPandas()  # at most the block's shingles
    counts = np.zeros(len(known), dtype=np.int64)
    counts[rows["_at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts, spread(passed.where("_at IS NULL").select(doc_key, text))


def necessary(block: list[tuple[int, np.ndarray]], known: np.ndarray, counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (shingle, item's index in the block, position): for each window of each passage the rarest shingle."""
    span = run - SHINGLE + 1
    keys, owners, positions = [], [], []
    for owner, (_, hashes) in enumerate(block):
        own = shingles(hashes, SHINGLE)
        # order of rarity over all of the block's shingles: count, then hash
        cost = counts[np.searchsorted(known, own)]
        order = np.lexsort((own, cost))
        rank = np.empty(len(own), dtype=np.int64)
        rank[order] = np.arange(len(own))
        windows = np.lib.stride_tricks.sliding_window_view(rank, span)
        at = np.unique(order[windows.min(axis=1)])
        keys.append(own[at])
        owners.append(np.full(len(at), owner))
        positions.append(at)
    key, owner, position = np.concatenate(keys), np.concatenate(owners), np.concatenate(positions)
    order = np.argsort(key, kind="stable")
    return key[order], owner[order], position[order]


def run_length(doc: np.ndarray, at: int, item: np.ndarray, pos: int) -> int:
    """Length of the run of equal words around doc[at] and item[pos], which start an equal shingle."""
    back = min(at, pos)
    left = doc[at - back : at] == item[pos - back : pos]
    ahead = min(len(doc) - at, len(item) - pos)
    right = doc[at : at + ahead] == item[pos : pos + ahead]
    return int(np.argmin(left[::-1]) if not left.all() else back) + int(np.argmin(right) if not right.all() else ahead)


def leaks(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_key, item_key, words: the longest run) of each document and item it leaks."""
    spark = documents.sparkSession
    schema = f"{doc_key} {documents.schema[doc_key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, words int"
    if run < SHINGLE:
        raise ValueError(f"run must be at least {SHINGLE}")
    item_type = to_arrow_type(items.schema[item_key].dataType)
    parts = []
    for block in _blocks(items, item_key, passage, run, block_words):
        known = np.unique(np.concatenate([shingles(h, SHINGLE) for _, h in block]))
        counts, kept = _counted(documents, doc_key, text, known, run)
        sent = spark.sparkContext.broadcast((block, *necessary(block, known, counts, run)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, key, owner, position = sent.value
            hasher = Hasher()
            for batch in batches:
                rows, found, lengths = [], [], []
                for i, doc, shingled in _document_shingles(batch.column(1), hasher):
                    if len(doc) < run:
                        continue
                    start = np.searchsorted(key, shingled, "left")
                    hit = np.flatnonzero((start < len(key)) & (key[np.minimum(start, len(key) - 1)] == shingled))
                    best: dict[int, int] = {}
                    for at in hit:
                        j = start[at]
                        while j < len(key) and key[j] == shingled[at]:
                            who, pos = owner[j], position[j]
                            item = own[who][1]
                            # the run lies within [at - pos, at - pos + len(item)) of the document
                            if min(at, pos) + min(len(doc) - at, len(item) - pos) >= run:
                                n = run_length(doc, at, item, pos)
                                if n >= run and n > best.get(who, 0):
                                    best[who] = n
                            j += 1
                    for who, n in best.items():
                        rows.append(i)
                        found.append(own[who][0])
                        lengths.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, item_type), pa.array(lengths, pa.int32())],
                    names=[doc_key, item_key, "words"],
                )

        parts.append(kept.mapInArrow(search, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(doc_key, item_key).agg(F.max("words").alias("words"))
