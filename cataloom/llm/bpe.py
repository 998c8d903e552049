"""Byte-pair encoding of a corpus with a public vocabulary, by a rank queue over a hierarchical bitmap.

A text is cut into pre-tokens by the vocabulary's pattern; a pre-token that is a token is looked up, any other is merged:

* its symbols form a doubly linked list of positions;
* each adjacent pair that has a merge rank lies in the bucket of that rank, as the position of its left symbol;
* three levels of 64-bit words mark the buckets that aren't empty; find-first-set from the top gives the lowest rank in three steps;
* an entry whose pair has changed since is stale and skipped when it comes out.

So a merge costs a constant number of steps, whatever the pre-token's length: a pre-token of n bytes takes O(n) queue operations
instead of the O(n^2) of rescanning for the lowest rank.

Defined cases: a null text and an empty text have an empty list; special tokens' strings inside a text are ordinary text; characters
that UTF-8 can't encode (lone surrogates) become U+FFFD; repeated rows are encoded alike; an empty table gives no rows; extra
columns are not read. Texts of any length are encoded whole.

Scale: a map over the rows, no shuffle. The vocabulary (about 50,000 entries, a fixed file) is read once per Python worker from a
path that is a parameter; a memo of bounded size keeps the encodings of common pre-tokens.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the byte-level pre-token pattern that belongs to the 50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO_ENTRIES = 200_000
#: Longer pre-tokens are encoded without being remembered.
MEMO_LENGTH = 64


class RankQueue:
    """A queue of positions by merge rank. ``size``: ranks lie in [0, size), at most 2**18."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaf = [0] * ((size >> 6) + 1)
        self.middle = [0] * ((size >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a = rank >> 6
            b = a >> 6
            self.leaf[a] |= 1 << (rank & 63)
            self.middle[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """(rank, leftmost position) of the lowest rank; None when empty."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.middle[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.leaf[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.leaf[a] &= self.leaf[a] - 1
            if not self.leaf[a]:
                self.middle[b] &= self.middle[b] - 1
                if not self.middle[b]:
                    self.top &= self.top - 1
        return rank, position


class Encoder:
    """Encodes texts by a vocabulary of ranks: token bytes to id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values(), default=0) + 1
        self.memo: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pending = [-1] * n  # the rank under which the pair that starts here was last queued
        queue = RankQueue(self.size)

        def offer(left: int) -> None:
            right = after[left]
            rank = ranks.get(symbols[left] + symbols[right]) if right < n else None
            if rank is None:
                pending[left] = -1
            else:
                pending[left] = rank
                queue.push(rank, left)

        for i in range(n - 1):
            offer(i)
        while (entry := queue.pop()) is not None:
            rank, left = entry
            if symbols[left] is None or pending[left] != rank:
                continue
            right = after[left]
            if right >= n or ranks.get(symbols[left] + symbols[right]) != rank:
                continue
            symbols[left] += symbols[right]
            symbols[right] = None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [ranks[s] for s in symbols if s is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for token in self.find(text):
            ids = memo.get(token)
            if ids is None:
                ids = self.merge(token.encode("utf-8", "replace"))
                if len(token) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[token] = ids
            out += ids
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def encode_corpus(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids: array<int>) of each row."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            # rows leave in small groups, so that very long texts don't pile up in one batch
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(mapped, schema)
