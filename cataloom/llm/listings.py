"""Listings of the same product: a contrastively trained subword encoder, inverted-file search, numeric-variant vetoes, mutual neighbours.

1. Evidence is read from each listing: maker (typed brand mapped to the canonical list, or named in the title), memory and storage (columns in any unit, otherwise the title), and
   identifiers: runs of letters and digits that no measure or known component's name explains, unbroken or broken by marks and blanks. What is broken by a blank is an identifier only if
   some other listing writes it unbroken, and an identifier counts only where most of the listings that hold it are of one maker: the collection decides, not a pattern of
   codes. Look-alike characters (O/0, I/l/1) are folded.
2. Subwords of title, maker, sizes and of what several listings hold as a possible identifier (also broken by blanks everywhere) are hashed to ``FEATURES`` rows of an embedding table. The table is weighted by inverse document
   frequency over all listings and trained by in-batch contrastive loss, on a sample of at most ``TRAIN_ROWS`` listings (a documented bound) in whole groups, whose positives
   are pairs that share an identifier and sizes in other words.
3. Every listing is encoded and stored in the inverted list of its nearest centroid, within the stratum of its memory and storage; it is searched for in its ``probes`` nearest lists there. The number of probes is
   tuned, up to all lists: exact neighbours of a sample of queries over all rows must be found to ``TUNED_RECALL``.
4. Candidates above the similarity threshold are vetoed when makers differ, or a number differs: memory, storage, or identifiers where both have some and share none. Where one of them has none,
   the encoder must find the pair ``ALIKE``, and what either may have as an identifier (also broken by blanks, also held by no other) must have something in common; where one has nothing of the kind,
   only the encoder speaks for the pair, and ``BLIND`` is the threshold.
5. Two listings are linked when each finds the other; linked listings form groups by connected components. A task emits a star for each group that its pairs form, not the pairs.

A listing belongs to a group only if its memory and storage are known; an accessory has none and matches nothing.

Defined cases: a null, empty or wordless title matches nothing; null brand means that the maker is read from the title or, failing that, vetoes nothing; a null key is left out; of a key
that repeats, the latest row counts; very long titles are read whole; listings that are equal in words, maker and sizes are one for the search and a star beside it; an empty table gives no rows;
extra columns aren't read.

Scale: encoding is a map; the table (8 MB in half precision) and the centroids are fixed-size broadcasts. Search shuffles a listing's vector once and once for each of its identifiers, and ``probes`` times
where it has none; tables that nothing reads any more are removed. A list or identifier larger than ``LIST_ROWS`` is split into a grid of blocks, so a hot cell becomes many tasks. Vetoes act inside the search, before anything is emitted, and what a task emits grows with its
listings. Identifiers and copies that many listings hold are joined by broadcast, samples are drawn by hash thresholds.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.llm.canonical import Dictionary, compact, fold
from cataloom.llm.hnsw import fit_centroids
from cataloom.operators.components import components
from cataloom.session import discard, drawn, join_hot, latest, staged

#: Rows of the embedding table: the first WORD_ROWS for words, makers and sizes, the others for codes and part numbers.
FEATURES, WORD_ROWS, WIDTH = 1 << 16, 1 << 14, 64
#: Weight at the start of training: a listing's identity lies in its codes, not in its many other words.
WORD_WEIGHT, CODE_WEIGHT = 0.5, 2.0
TRAIN_ROWS, STEPS, BATCH, RATE, TEMPERATURE = 12_000, 80, 384, 0.3, 0.1
GROUP_ROWS = 8  # listings of one code and sizes in the sample, so that a hot group doesn't fill it
LIST_AIM, LIST_ROWS, MAX_LISTS = 1500, 4000, 4096
PART_ROWS = 50_000  # listings of a task that compares those of shared identifiers
FIRST_LISTS = 32  # nearest lists kept of each listing; more where the tuning needs them
TUNED_RECALL, TUNE_QUERIES, SPARE_PROBES = 0.9995, 1000, 4
SIMILARITY, ALIKE, BLIND = 0.2, 0.5, 0.9
ONE_MAKER = 0.6  # share of the known makers of an identifier's listings that must be one
HOT = 0.001  # identifiers and copies that a larger share of the listings hold are broadcast
MOST_NAMES, NAMES_BLOCK = 100_000, 2000

# ---------------------------------------------------------------- evidence

_FOLD = str.maketrans("OIL", "011")
_TOKEN = re.compile(r"[A-Za-z0-9]+")
# Units behind a number.
_UNIT = r"(?:gigabytes?|megabytes?|terabytes?|gb|tb|mb|g|t|mhz|ghz|hz|inch(?:es)?|in|cm|mm|nits?|wh|mah|lbs?|kg|cores?)"
_MEASURE = re.compile(rf"(?<![\w.])\d+(?:[.,]\d+)?\s*-?\s*{_UNIT}\b|(?<![\w.])\d+(?:\.\d+)?\s*(?:\"|''|”|″)", re.IGNORECASE)
LEAST, MOST, PIECES = 6, 12, 3  # characters of an identifier, and runs that it may be broken into
_SIZE = r"(\d+(?:\.\d+)?)\s*(gigabytes|gb|tb|mb|g|t)\b(?:\s+of\b)?"
_DRIVE = r"(?:(?:m\.2|nvme|pcie|sata)\s+)*(?:ssd|solid\s+state\s+drive|storage|hdd|emmc|drive)\b"
_RAM = r"(?:(?:lp)?ddr\d\w?(?:\s+\d+\s*mhz)?(?:\s+(?:ram|memory))?|ram|memory)\b"
#: A size stands before or after its noun; what is read first, from the left, decides which of two sizes a noun in the middle belongs to.
_SIZES = re.compile(rf"(?:(?:(?P<ram_>{_RAM})|(?P<drive_>{_DRIVE}))\s*:?\s*{_SIZE})|(?:{_SIZE}\s*(?:(?P<_ram>{_RAM})|(?P<_drive>{_DRIVE})))", re.IGNORECASE)


def identifier(text: str) -> str:
    """``text`` with look-alikes folded if it can be an identifier, else ''."""
    if not LEAST <= len(text) <= MOST:
        return ""
    digits = sum(c.isdigit() for c in text)
    if digits == len(text):
        return text if digits > LEAST else ""
    folded = text.upper().translate(_FOLD)
    return folded if digits and sum(c.isdigit() for c in folded) >= 3 else ""


def identifiers(title: str, names: Sequence[re.Pattern] = ()) -> tuple[set[str], set[str]]:
    """(unbroken, broken by a blank) runs of a title that may be identifiers; ``names`` (processors, graphics) and measures are passed over."""
    text = _MEASURE.sub(" | ", title)
    for n in names:
        text = n.sub(" | ", text)
    runs = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    unbroken, broken = set(), set()
    for i in range(len(runs)):
        joined, tight = "", True
        for j in range(i, min(i + PIECES, len(runs))):
            run, start, _ = runs[j]
            if j > i:
                gap = text[runs[j - 1][2] : start]
                if gap not in ("-", "_", ".", " "):
                    break
                tight &= gap != " "
            # a piece has a digit, a few letters, or behind a digit letters some of which may be digits
            if not any(c.isdigit() for c in run) and len(run) > 4 and not (len(run) == 5 and sum(c in "OILoil" for c in run) > 1 and any(c.isdigit() for c in joined)):
                break
            joined += run
            name = identifier(joined)
            if name and (tight or len(name) > LEAST):  # a short name and the start of a code are no identifier
                (unbroken if tight else broken).add(name)
    return unbroken, broken - unbroken


def _gigabytes(value: str, unit: str) -> float:
    return float(value) * {"t": 1024, "m": 1 / 1024}.get(unit[0].lower(), 1)


def _power(size: float) -> int:
    """The power of two nearest to a size in GB: 1000 and 1024 are one size."""
    return 1 << max(0, round(math.log2(size))) if size > 0 else 0


def title_sizes(title: str) -> tuple[int, int]:
    """(memory, storage) in GB that a title states, 0 for what it leaves out."""
    ram = drive = 0
    for m in _SIZES.finditer(title):
        value, unit = (m[3], m[4]) if m[3] else (m[5], m[6])
        size = _power(_gigabytes(value, unit))
        if m["ram_"] or m["_ram"]:
            ram = ram or (size if 1 <= size <= 256 else 0)
        else:
            drive = drive or (size if size >= 16 else 0)
    return ram, drive


def memory_gb(value: float | None, stated: int) -> int:
    """The column in GB or MB, else what the title states."""
    if value is None or not value > 0 or not math.isfinite(value):
        return stated
    return _power(value / 1024 if value >= 1024 else value)


def storage_gb(value: float | None, stated: int) -> int:
    """The column in GB, TB or MB, else what the title states."""
    if value is None or not value > 0 or not math.isfinite(value):
        return stated
    return _power(value / 1024 if value >= 32_000 else value * 1024 if value < 16 else value)


def name_patterns(names: list[str]) -> list[re.Pattern]:
    """Match any of the names, whatever stands between their words; a pattern for every ``NAMES_BLOCK``, the longest names first."""
    parts = sorted({r"[\W_]*".join(re.escape(w) for w in re.findall(r"[^\W_]+", n)) for n in names if n} - {""}, key=lambda p: (-len(p), p))
    return [re.compile(rf"(?<![^\W_])(?:{'|'.join(parts[i : i + NAMES_BLOCK])})(?![^\W_])", re.IGNORECASE) for i in range(0, len(parts), NAMES_BLOCK)]


class Makers:
    """Maker of a listing: the canonical name that the title names, else the typed brand's entry."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.dictionary = Dictionary([(i, "brand", v, 0) for i, v in entries])
        self.names = {fold(v).replace("&", " ").split()[0]: [] for _, v in entries}
        for i, v in entries:
            words = [w for w in fold(v).split() if w != "&"]
            self.names[words[0]].append((words, i))
        self.memo: dict[str, int] = {}

    def __call__(self, brand: str | None, title_words: list[str]) -> int:
        for at, w in enumerate(title_words):
            for words, i in self.names.get(w, ()):
                if title_words[at : at + len(words)] == words:
                    return i
        if not brand:
            return -1
        hit = self.memo.get(brand)
        if hit is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            hit = self.memo[brand] = self.dictionary.lookup("brand", brand)[0]
        return hit


def evidence(title: str | None, brand: str | None, ram: float | None, storage: float | None, makers: Makers, names: Sequence[re.Pattern] = ()) -> tuple[int, set[str], set[str], int, int, list[str]]:
    """(maker, unbroken identifiers, broken ones, memory, storage, folded words of the title)."""
    text = " ".join(unicodedata.normalize("NFKC", html.unescape(title or "")).split())
    words = re.findall(r"[^\W_]+", fold(text))
    stated = title_sizes(text)
    return makers(brand, words), *identifiers(text, names), memory_gb(ram, stated[0]), storage_gb(storage, stated[1]), words


# ---------------------------------------------------------------- encoder


def subwords(words: list[str], maker: int, ram: int, storage: int) -> np.ndarray:
    """Hashed features: words and their 4-grams, maker and sizes."""
    common = [f"w{w}" for w in words]
    for w in words:
        if len(w) > 4:
            common += [f"g{w[i : i + 4]}" for i in range(len(w) - 3)]
    if maker >= 0:
        common.append(f"m{maker}")
    common += [f"r{ram}", f"s{storage}", f"rs{ram}/{storage}"]
    return np.fromiter({xxhash.xxh32_intdigest(f.encode("utf-8", "replace")) % WORD_ROWS for f in common}, np.int64)


def code_subwords(codes: Sequence[str]) -> np.ndarray:
    """Hashed features of possible identifiers: themselves and their 4- and 5-grams."""
    rare = [f"={c}" for c in codes] + [c[i : i + n] for c in codes for n in (4, 5) for i in range(len(c) - n + 1)]
    return np.fromiter({WORD_ROWS + xxhash.xxh32_intdigest(f.encode()) % (FEATURES - WORD_ROWS) for f in rare}, np.int64)


def encode(features: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Unit vectors: the normalised sum of the features' rows."""
    out = np.zeros((len(features), table.shape[1]), np.float32)
    if features:
        start = np.r_[0, np.cumsum([len(f) for f in features])[:-1]]
        out = np.add.reduceat(table[np.concatenate(features)].astype(np.float32), start)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train(features: list[np.ndarray], labels: np.ndarray, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """The embedding table after contrastive training: rows with one label attract each other, all others of a batch repel."""
    rng = np.random.default_rng(seed)
    weight = idf * np.where(np.arange(FEATURES) < WORD_ROWS, WORD_WEIGHT, CODE_WEIGHT)
    table = (rng.standard_normal((FEATURES, WIDTH)) / math.sqrt(WIDTH)).astype(np.float32) * weight[:, None].astype(np.float32)
    order = np.argsort(labels, kind="stable")
    order = order[labels[order] >= 0]
    edge = np.flatnonzero(np.r_[True, np.diff(labels[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    groups = [order[a:b] for a, b in zip(edge, edge[1:]) if b - a > 1]
    if len(groups) < 2:
        return table
    for step in range(STEPS):
        pick = rng.choice(len(groups), min(BATCH, len(groups)), replace=False)
        pairs = np.array([rng.choice(groups[g], 2, replace=False) for g in pick])
        sides = []
        for s in (0, 1):
            own = [features[i] for i in pairs[:, s]]
            start = np.r_[0, np.cumsum([len(f) for f in own])[:-1]]
            flat = np.concatenate(own)
            total = np.add.reduceat(table[flat], start)
            norm = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
            sides.append((flat, [len(f) for f in own], total / norm, norm))
        a, b = sides[0][2], sides[1][2]
        logits = a @ b.T / TEMPERATURE
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        q = np.exp(logits.T - logits.T.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        grad = (p + q.T) / 2
        grad[np.arange(len(p)), np.arange(len(p))] -= 1
        grad /= TEMPERATURE
        rate = RATE * (1 - step / STEPS)
        for (flat, sizes, unit, norm), g in ((sides[0], grad @ b), (sides[1], grad.T @ a)):
            g = (g - unit * (g * unit).sum(1, keepdims=True)) / norm
            np.subtract.at(table, flat, np.repeat(rate * g, sizes, axis=0).astype(np.float32))
    return table


def _sample(listings: DataFrame, key: str, n: int) -> DataFrame:
    """At most TRAIN_ROWS listings, those whose identifier and sizes have a hash under a threshold: listings of one product come in together, at any number of rows."""
    label = F.xxhash64(F.coalesce(F.array_min("ids"), F.xxhash64(key)), "ram", "storage")
    some = drawn(listings.withColumn("label", label), "label", TRAIN_ROWS, n)
    within = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64(key), key))  # a group limit acts before the shuffle
    return some.withColumn("within", within).where(F.col("within") <= GROUP_ROWS).select("label", "features").limit(TRAIN_ROWS)


def _fitted(listings: DataFrame, key: str, counts: np.ndarray, n: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(table in half precision, centroids), trained in one task on ``_sample``; only the result returns to the driver."""
    idf = np.log((1000 + n) / (1 + counts))  # smoothed, so that in a small collection a shared code isn't a common word

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, features = [], []
        for batch in batches:
            labels.append(batch.column(0).to_numpy())
            features += [np.asarray(f, np.int64) for f in batch.column(1).to_pylist()]
        label = np.concatenate(labels) if labels else np.zeros(0, np.int64)
        order = np.argsort(label, kind="stable")
        features = [features[i] for i in order]
        table = train(features, np.unique(label[order], return_inverse=True)[1].ravel(), idf).astype("<f2")
        centres = fit_centroids(encode(features, table), lists)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([centres.astype("<f4").tobytes()])], names=["table", "centres"])

    row = _sample(listings, key, n).coalesce(1).mapInArrow(fit, "table binary, centres binary").first()
    if row is None or not row["centres"]:
        return np.zeros((FEATURES, WIDTH), "<f2"), np.zeros((1, WIDTH), "<f4")
    return np.frombuffer(row["table"], "<f2").reshape(FEATURES, WIDTH), np.frombuffer(row["centres"], "<f4").reshape(-1, WIDTH)


# ---------------------------------------------------------------- search


_COLUMNS = ("maker", "named", "ram", "storage")


def facts(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """What vetoes look at: the columns, and the identifiers, padded with 0."""
    out = {c: pdf[c].to_numpy(np.int64) for c in _COLUMNS}
    for c in ("ids", "maybe"):
        most = max(map(len, pdf[c]), default=0)
        out[c] = np.array([[*x, *[0] * (most - len(x))] for x in pdf[c]], np.int64).reshape(len(pdf), most)
    return out


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]).any(axis=(1, 2))


def compatible(left: dict[str, np.ndarray], i: np.ndarray, right: dict[str, np.ndarray], j: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) no veto hits."""
    at = np.flatnonzero((left["ram"][i] == right["ram"][j]) & (left["storage"][i] == right["storage"][j]))
    a, b = left["maker"][i[at]], right["maker"][j[at]]
    at = at[(a == b) | (a < 0) | (b < 0)]
    shared = _common(left["ids"][i[at]], right["ids"][j[at]])
    ok = np.zeros(len(i), bool)
    ok[at[shared]] = True
    # where one has no identifier
    at = at[~shared & ((left["named"][i[at]] == 0) | (right["named"][j[at]] == 0)) & (similarity[at] >= ALIKE)]
    x, y = left["maybe"][i[at]], right["maybe"][j[at]]
    nothing = ~(x != 0).any(1) | ~(y != 0).any(1)
    ok[at] = np.where(nothing, similarity[at] >= BLIND, _common(x, y))
    return ok


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a`` and ``b`` in ``label``, where each node bears its component's least node."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]
        if (label == before).all():
            return


def _within(rows: np.ndarray, start: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``rows`` within the runs that ``start`` bounds, about ``most`` at a time."""
    count = np.diff(start)
    for m in np.unique(count[count > 1]):
        first = start[:-1][count == m]
        if m * (m - 1) // 2 <= most:
            x, y = np.triu_indices(m, 1)
            for k in range(0, len(first), step := max(1, most // len(x))):
                at = first[k : k + step, None]
                yield rows[(at + x).ravel()], rows[(at + y).ravel()]
        else:
            for at in first:
                for x in range(0, m, step := max(1, most // m)):
                    i, j = np.meshgrid(np.arange(x, min(x + step, m)), np.arange(x, m), indexing="ij")
                    yield rows[at + i[i < j]], rows[at + j[i < j]]


def _met(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
    """Inner equi-join with a staged ``right``; keys that many of the ``rows`` hold, if there are any, meet by broadcast."""
    hot = F.col("n") > F.lit(max(1000, int(HOT * rows)))
    return left.join(right, on) if right.where(hot).isEmpty() else join_hot(left, right, [on], hot)


def _vectors(bytes_column) -> np.ndarray:
    return np.frombuffer(b"".join(bytes_column), "<f2").reshape(-1, WIDTH).astype(np.float32)


class SameProduct:
    """``links`` (a, b) between listings, ``groups`` (key, group_id) and ``pairs`` from them; ``probes`` and ``recall`` of the tuned search."""

    def __init__(self, df: DataFrame, key: str, order: str, reference: DataFrame, probes: int | None = None):
        spark = df.sparkSession
        self.key = key
        self.kind = df.schema[key].dataType.simpleString()
        rows = latest(df, key, order, ["title", "brand", "ram_gb", "storage_gb"])
        whole = staged(self._read(rows, reference), "listings-read", "zstd")
        read = whole.where("ram > 0 AND storage > 0")
        # equal listings are one for the search, and a star beside it
        copies = staged(read.groupBy("copy").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "listings-equal")
        stars = staged(_met(read.select("copy", F.col(key).alias("b")), copies, "copy", read.count()).where("b <> first").select(F.col("first").alias("a"), "b"), "listings-copies")
        discard(copies)
        # written, as the evidence reads them more than once
        single = staged(read.join(stars.select(F.col("b").alias(key)), key, "left_anti"), "listings-single", "zstd")
        discard(whole)
        n = single.count()
        listings = staged(self._named(single, n), "listings-evidence", "zstd")
        discard(single)
        frequency = listings.select(F.explode("features").alias("f")).groupBy("f").count().toPandas()  # at most FEATURES rows
        counts = np.zeros(FEATURES, np.int64)
        counts[frequency["f"].to_numpy(dtype=np.int64)] = frequency["count"].to_numpy(dtype=np.int64)
        # listings of other memory or storage are vetoed anyway: lists lie within strata of equal sizes, and the largest sets their number
        largest = listings.groupBy("ram", "storage").count().agg(F.max("count")).first()[0] or 0
        lists = int(min(MAX_LISTS, max(1, round(largest / LIST_AIM))))
        table, centres = _fitted(listings, key, counts, n, lists)
        model = spark.sparkContext.broadcast((table, centres))
        del table  # the driver keeps no copy of its own
        most = min(max(FIRST_LISTS, probes or 0), max(1, len(centres)))
        passed = [key, "ids", "maybe", *_COLUMNS]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, centres = model.value
            for batch in batches:
                if batch.num_rows:
                    v = encode([np.asarray(f, np.int64) for f in batch.column(len(passed)).to_pylist()], table)
                    near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array([r.tobytes() for r in v.astype("<f2")], pa.binary()), pa.array(list(near))], names=[*passed, "v", "lists"])

        while True:
            schema = f"{key} {self.kind}, ids array<long>, maybe array<long>, maker long, named int, ram int, storage int, v binary, lists array<int>"
            placed = staged(listings.select(*passed, "features").mapInArrow(place, schema), "listings-placed")
            self.probes, self.recall = self._tuned(placed, most, n) if probes is None else (min(probes, most), None)
            if self.recall is None or self.recall >= TUNED_RECALL or most >= len(centres):
                break
            discard(placed)
            most = min(4 * most, len(centres))
        model.destroy()
        discard(listings)
        self.links = staged(self._search(placed, self.probes).unionByName(stars), "listings-links")
        discard(placed)

    def _read(self, rows: DataFrame, reference: DataFrame) -> DataFrame:
        """(key, maker, unbroken, broken, ram, storage, copy, features)."""
        key, spark = self.key, rows.sparkSession
        # the reference lists are broadcast: their size is checked
        known = reference.where("canonical_value IS NOT NULL AND field_name IN ('brand', 'cpu_family', 'gpu_model')").select("ref_id", "field_name", "canonical_value").limit(MOST_NAMES + 1).collect()
        if len(known) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} reference names: map brands with canonical.resolve first and pass fewer component names")
        sent = spark.sparkContext.broadcast(([(r.ref_id, r.canonical_value) for r in known if r.field_name == "brand"], [r.canonical_value for r in known if r.field_name != "brand"]))
        schema = f"{key} {self.kind}, maker long, unbroken array<string>, broken array<string>, ram int, storage int, copy long, features array<int>"

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            makers, names = Makers(sent.value[0]), name_patterns(sent.value[1])
            for batch in batches:
                found = [evidence(*r, makers, names) for r in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
                columns = [
                    pa.array([f[0] for f in found], pa.int64()), pa.array([sorted(f[1]) for f in found], pa.list_(pa.string())), pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
                    pa.array([f[3] if f[5] else 0 for f in found], pa.int32()), pa.array([f[4] if f[5] else 0 for f in found], pa.int32()),
                    pa.array([xxhash.xxh64_intdigest(f"{f[0]}/{f[3]}/{f[4]}/{' '.join(f[5])}".encode("utf-8", "replace")) - (1 << 63) for f in found], pa.int64()),
                    pa.array([subwords(f[5], f[0], f[3], f[4]).astype(np.int32) for f in found], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "maker", "unbroken", "broken", "ram", "storage", "copy", "features"])

        return rows.mapInArrow(read, schema)

    def _named(self, read: DataFrame, n: int) -> DataFrame:
        """The ``n`` rows of ``read`` with ids (identifiers that other listings share and the collection bears out), named (1 where any unbroken run may be one) and the features of what several listings hold."""
        key = self.key
        each = lambda column, firm: F.transform(column, lambda c: F.struct(c.alias("id"), F.lit(firm).alias("firm")))
        held = read.select(key, "maker", F.explode(F.concat(each("unbroken", 1), each("broken", 0))).alias("_held")).select("_held.id", key, "maker", "_held.firm")
        by_maker = held.groupBy("id", "maker").agg(F.count(F.lit(1)).alias("n"), F.sum("firm").alias("firm"))
        known = F.when(F.col("maker") >= 0, F.col("n"))
        ids = by_maker.groupBy("id").agg(F.sum("n").alias("n"), F.sum("firm").alias("firm"), F.sum(known).alias("known"), F.max(known).alias("top"))
        good = F.coalesce(F.col("top") >= ONE_MAKER * F.col("known"), F.lit(True))
        ids = staged(ids.where(good & (F.col("n") > 1)).select("id", "n", (F.col("firm") > 0).alias("firm")), "listings-identifiers")
        own = _met(held.select("id", key), ids, "id", n)
        # a title's own
        shared = own.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("codes"), F.array_sort(F.collect_set(F.when(F.col("firm"), F.xxhash64("id")))).alias("ids"))
        out = read.join(shared, key, "left").withColumns({"codes": F.coalesce("codes", F.array().cast("array<string>")), "ids": F.coalesce("ids", F.array().cast("array<long>"))})
        named = ((F.size("unbroken") > 0) | (F.size("ids") > 0)).cast("int").alias("named")
        passed = [key, "ids", "maybe", *_COLUMNS]

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                features = [np.r_[np.asarray(f, np.int32), code_subwords(c).astype(np.int32)] for f, c in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(features, pa.list_(pa.int32()))], names=[*passed, "features"])

        maybe = F.transform(F.array_union("unbroken", "broken"), lambda c: F.xxhash64(c)).alias("maybe")
        return out.select(key, "ids", maybe, "maker", named, "ram", "storage", "features", "codes").mapInArrow(extend, f"{key} {self.kind}, ids array<long>, maybe array<long>, maker long, named int, ram int, storage int, features array<int>")

    def _tuned(self, placed: DataFrame, most: int, n: int) -> tuple[int, float]:
        """The least number of probes that finds the sample's exact neighbours, searched for in all rows."""
        key = self.key
        asked = drawn(placed, key, TUNE_QUERIES, n, 1).toPandas()
        if not len(asked):
            return 1, 1.0
        spark = placed.sparkSession
        sent = spark.sparkContext.broadcast((_vectors(asked["v"]), facts(asked), asked[key].to_numpy(), np.stack(asked["lists"])))

        def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, veto, keys, lists = sent.value
            for whole in batches:
                for start in range(0, len(whole), 2000):
                    pdf = whole.iloc[start : start + 2000]
                    s = q @ _vectors(pdf["v"]).T
                    i, j = np.nonzero(s >= SIMILARITY)
                    ok = compatible(veto, i, facts(pdf), j, s[i, j]) & (keys[i] != pdf[key].to_numpy()[j])
                    i, j = i[ok], j[ok]
                    own = np.stack(pdf["lists"])
                    # mutual neighbours: the later of the two ranks counts
                    there, back = lists[i] == own[j, :1], own[j] == lists[i, :1]
                    rank = np.where(there.any(1) & back.any(1), np.maximum(there.argmax(1), back.argmax(1)), most)
                    yield pd.DataFrame({"rank": rank})

        found = placed.select(key, "ids", "maybe", *_COLUMNS, "v", "lists").mapInPandas(ranks, "rank int").groupBy("rank").count().toPandas()
        by_rank = np.zeros(most + 1, np.int64)
        by_rank[found["rank"].to_numpy(dtype=np.int64)] = found["count"].to_numpy(dtype=np.int64)
        share = np.cumsum(by_rank)[:-1] / max(1, by_rank.sum())
        enough = np.flatnonzero(share >= TUNED_RECALL)
        # a sample's last misses are few, and one lost link can part a group: some probes to spare
        probes = min(most, int(enough[0]) + 1 + SPARE_PROBES) if len(enough) else most
        return probes, float(share[probes - 1]) if by_rank.sum() else 1.0

    def _search(self, placed: DataFrame, probes: int) -> DataFrame:
        """(a, b): stars for the groups that mutual, compatible pairs form. Two listings that both have identifiers are compatible only if they share one, so these meet where they
        share it, and only the others ask in their lists: few vectors move more than once."""
        placed = placed.withColumn("lists", F.slice("lists", 1, probes)).withColumn("home", F.col("lists")[0])
        return self._by_identifier(placed).unionByName(self._by_lists(placed)).distinct()

    def _by_identifier(self, placed: DataFrame) -> DataFrame:
        """Pairs that share an identifier; one that many listings hold is a triangular grid of blocks."""
        key, cell = self.key, ["ram", "storage", "id"]
        held = placed.where("size(ids) > 0").withColumn("id", F.explode("ids"))
        # few: each holds more than LIST_ROWS listings
        hot = F.broadcast(held.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("side")).where("side > 1"))
        held = held.join(hot, cell, "left").withColumn("side", F.coalesce("side", F.lit(1)))
        held = held.withColumn("i", F.pmod(F.xxhash64(key), F.col("side")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
        met = F.xxhash64(*cell, F.least("i", "j"), F.greatest("i", "j"))
        parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // PART_ROWS + 1)

        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            met, order = np.unique(pdf["met"].to_numpy(), return_inverse=True)
            rows = np.argsort(order, kind="stable")
            start = np.searchsorted(order[rows], np.arange(len(met) + 1))
            v, maker, home, lists = _vectors(pdf["v"]), pdf["maker"].to_numpy(), pdf["home"].to_numpy(), np.stack(pdf["lists"])
            keys, node = np.unique(pdf[key].to_numpy(), return_inverse=True)
            label = np.arange(len(keys))
            for i, j in _within(rows, start):
                same = (maker[i] == maker[j]) | (maker[i] < 0) | (maker[j] < 0)
                i, j = i[same & (node[i] != node[j])], j[same & (node[i] != node[j])]
                mutual = (lists[i] == home[j, None]).any(1) & (lists[j] == home[i, None]).any(1)
                i, j = i[mutual], j[mutual]
                near = np.einsum("ij,ij->i", v[i], v[j]) >= SIMILARITY
                merge(label, node[i[near]], node[j[near]])
            apart = np.flatnonzero(label != np.arange(len(keys)))
            return pd.DataFrame({"a": keys[label[apart]], "b": keys[apart]})

        columns = [F.pmod(met, F.lit(parts)).alias("part"), met.alias("met"), key, "maker", "v", "lists", "home"]
        return held.select(*columns).groupBy("part").applyInPandas(scan, f"a {self.kind}, b {self.kind}")

    def _by_lists(self, placed: DataFrame) -> DataFrame:
        """Pairs of which one has no identifier: it asks in its ``probes`` nearest lists."""
        key = self.key
        cell = ["ram", "storage", "list"]
        asking = placed.where("named = 0").withColumn("list", F.explode("lists"))
        # a row per list that is asked; the planner broadcasts it while it is small
        both = placed.select(*cell[:2], F.col("home").alias("list"), F.lit(1).alias("stored"), F.lit(0).alias("asked")).unionByName(asking.select(*cell, F.lit(0).alias("stored"), F.lit(1).alias("asked")))
        blocks = [F.ceil(F.sum(c) / most).cast("int").alias(f"{c}_blocks") for c, most in (("stored", LIST_ROWS), ("asked", 4 * LIST_ROWS))]
        grid = both.groupBy(*cell).agg(*blocks).where("stored_blocks > 0 AND asked_blocks > 0")
        columns = [key, "ids", "maybe", *_COLUMNS, "v", "lists", "home"]
        # a list is a grid of stored by asking blocks
        stored = (
            placed.withColumn("list", F.col("home"))
            .join(grid, cell)
            .withColumn("i", F.pmod(F.xxhash64(key), F.col("stored_blocks")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asked_blocks") - 1)))
        )
        asked = asking.join(grid, cell).withColumn("j", F.pmod(F.xxhash64(key), F.col("asked_blocks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("stored_blocks") - 1)))
        both = stored.select("list", "i", "j", *columns, F.lit(True).alias("is_stored")).unionByName(asked.select("list", "i", "j", *columns, F.lit(False).alias("is_stored")))

        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            s, q = pdf[pdf["is_stored"]], pdf[~pdf["is_stored"]]
            x, veto = _vectors(s["v"]), facts(s)
            # the list that is asked here is the stored side's home; a pair is mutual if the asking side's home is among the stored side's lists
            back = np.stack(s["lists"]) if len(s) else np.zeros((0, 1), np.int32)
            keys, node = np.unique(np.concatenate([s[key].to_numpy(), q[key].to_numpy()]), return_inverse=True)
            label = np.arange(len(keys))
            for k in range(0, len(q), 1024):
                part = q.iloc[k : k + 1024]
                similar = _vectors(part["v"]) @ x.T
                i, j = np.nonzero(similar >= SIMILARITY)
                a, b = node[len(s) + k + i], node[j]
                ok = (a != b) & (back[j] == part["home"].to_numpy()[i, None]).any(1)
                i, j, a, b = i[ok], j[ok], a[ok], b[ok]
                ok = compatible(facts(part), i, veto, j, similar[i, j])
                merge(label, a[ok], b[ok])
            apart = np.flatnonzero(label != np.arange(len(keys)))
            return pd.DataFrame({"a": keys[label[apart]], "b": keys[apart]})

        return both.groupBy(*cell, "i", "j").applyInPandas(scan, f"a {self.kind}, b {self.kind}")

    def groups(self) -> DataFrame:
        """(key, group_id) of each listing that has a partner."""
        return components(self.links, "a", "b").select(F.col("id").alias(self.key), F.col("component").alias("group_id"))

    def pairs(self) -> DataFrame:
        """(<key>_a, <key>_b), a < b, of all listings of a group. Large groups are salted."""
        key = self.key
        groups = staged(self.groups(), "listings-groups")
        sizes = groups.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("salts"))
        sized = groups.join(sizes, "group_id")
        a = sized.select("group_id", F.col(key).alias("ka"), F.pmod(F.xxhash64(key), F.col("salts")).cast("int").alias("salt"))
        b = sized.select("group_id", F.col(key).alias("kb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return a.join(b, ["group_id", "salt"]).where("ka < kb").select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))
