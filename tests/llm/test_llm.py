"""Training-data operators against brute force, and their defined cases."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cataloom.llm import bpe, canonical, hnsw, leakage, listings, neardup, percentiles, stuffing
from cataloom.llm.words import Hasher, plain_words, shingles
from cataloom.operators import components as stars
from cataloom.session import staged, table

TOKENIZERS = Path("/opt/tokenizers")

# ---------------------------------------------------------------- 2 vectors


def test_hnsw_recall_against_brute_force():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 48))
    x = (centres[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 48))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    best = np.argsort(-s, axis=1)[:, :10]
    at, sims = hnsw.Graph(x).search(x, 10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(at.tolist(), best.tolist())]) >= 0.97
    assert np.allclose(sims[:, 0], 1, atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 5, 70])
def test_hnsw_small_and_equal(n):
    x = np.ones((n, 4), np.float32) / 2
    at, _ = hnsw.Graph(x).search(x, 10)
    assert all(len({j for j in r if j >= 0}) == min(n, 10) for r in at.tolist())


def test_neighbours_end_to_end(spark, data):
    v = table(spark, data, "product_vectors")
    got = hnsw.neighbours(v, "vec_id", "embedding", k=10, shard_rows=20)
    one = {r["vec_id"]: np.array(r["embedding"]) for r in v.collect() if r["embedding"] is not None and len(r["embedding"]) == 384}
    one = {k: e / np.linalg.norm(e) for k, e in one.items() if np.linalg.norm(e) > 0}
    ids = sorted(one)
    s = np.stack([one[i] for i in ids]) @ np.stack([one[i] for i in ids]).T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:10]}
    found = {(r["vec_id"], r["neighbour"]) for r in got.collect()}
    assert len(found & want) / len(want) >= 0.9
    strong = {(min(a, b), max(a, b)) for a, b in want if s[ids.index(a), ids.index(b)] >= 0.8}
    assert {tuple(r) for r in hnsw.similar_pairs(got, "vec_id", 0.8).collect()} == strong


def test_probes_grow_with_the_cells(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "CENTROID_ROWS", 25)
    x = np.random.default_rng(4).normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<float>")
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :10]
    for step, queries in ((1, None), (10, df.where("id % 10 = 0"))):
        want = {(i, int(j)) for i in range(0, 1500, step) for j in best[i]}
        found = {(r["id"], r["neighbour"]) for r in hnsw.neighbours(df, "id", "e", k=10, dim=16, queries=queries).collect()}
        assert len(found & want) / len(want) >= 0.99


def test_unusable_vectors(spark):
    good = [1.0, 0.0, 2.0]
    data = [(1, good, "x"), (1, good, "y"), (2, None, ""), (3, [], ""), (4, [0.0, 0.0, 0.0], ""), (5, [1.0, 2.0], ""), (6, [1.0, float("nan"), 0.0], ""), (None, good, ""), (7, [1.0, None, 3.0], ""), (8, [2.0, 0.0, 4.0], "")]
    df = spark.createDataFrame(data, "id long, e array<float>, similarity string")
    got = hnsw.neighbours(df, "id", "e", k=3, dim=3).collect()
    assert {(r["id"], r["neighbour"]) for r in got} == {(1, 8), (8, 1)}
    assert hnsw.neighbours(df.where("false"), "id", "e", k=3, dim=3).count() == 0


def test_neighbours_keep_the_bytes_of_the_vectors_low(spark, tmp_path):
    import pathlib

    from cataloom.session import shared_dir

    x = (np.random.default_rng(5).integers(-128, 128, (3000, 64)) / 512).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<float>").union(spark.createDataFrame([(0, x[0].tolist())], "id long, e array<float>"))
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://")) / "cataloom"
    before = set(folder.glob("*"))
    found = hnsw.neighbours(df, "id", "e", k=3, dim=64, least=0.2).toPandas()
    written = sum(f.stat().st_size for d in set(folder.glob("*")) - before for f in d.glob("*.parquet"))
    assert written < 0.5 * x.nbytes  # normalised floats don't compress, and were written twice
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    want = {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.2}
    assert len(want & set(zip(found["id"], found["neighbour"]))) >= 0.995 * len(want) and found["similarity"].min() >= 0.2


def test_equal_vectors_answer_with_the_smaller_keys(spark):
    df = spark.createDataFrame([(i, [3.0, 1 / 3, 0.1]) for i in range(40)], "id long, e array<double>")
    found = {}
    for r in hnsw.neighbours(df, "id", "e", k=4, dim=3).collect():
        found.setdefault(r["id"], []).append(r["neighbour"])
    assert {i: sorted(v) for i, v in found.items()} == {i: [j for j in range(5) if j != i][:4] for i in range(40)}


def test_blocks_of_queries_and_recall_of_a_run(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=12)]) for i in range(300)], "id long, e array<float>")
    monkeypatch.setattr(hnsw, "ASK_ROWS", 60)
    found = hnsw.neighbours(df, "id", "e", k=5, dim=12, shard_rows=100).cache()
    assert found.count() == 1500 == found.dropDuplicates(["id", "neighbour"]).count()
    assert hnsw.recall(df, found, "id", "e", 5, 12, 400) >= 0.95
    assert 0.4 < hnsw.recall(df, found.where("rank <= 3"), "id", "e", 5, 12, 400) <= 0.6


# ---------------------------------------------------------------- 3 percentiles


def _percentiles(spark, data, shares=(0.5, 0.9, 0.99), parts=5):
    df = spark.createDataFrame(data, "k string, v double, n string")
    found = percentiles.percentiles(percentiles.summary(df, [F.col("k")], F.col("v")), shares, parts)
    return {(r["g"][0], r["share"]): (r["value"], r["n"]) for r in found.collect()}


def test_percentiles_exact(spark):
    rng = random.Random(2)
    data = [("hot", float(rng.randint(0, 50)), "") for _ in range(900)] + [("b", rng.random(), "") for _ in range(101)] + [("c", 4.0, ""), ("c", None, ""), ("c", float("nan"), ""), (None, 1.0, ""), (None, 2.0, "")]
    got = _percentiles(spark, data)
    by = defaultdict(list)
    for k, v, _ in data:
        if v is not None and v == v:
            by[k].append(v)
    assert {k for k, _ in got} == set(by)
    for (k, s), (value, n) in got.items():
        assert n == len(by[k]) and abs(value - np.percentile(by[k], 100 * s)) < 1e-9
    assert _percentiles(spark, []) == {}


def test_percentiles_merge_days(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("g", float(rng.randint(0, 30)), i % 4) for i in range(400)], "k string, v double, day int")
    days = [percentiles.summary(df.where(F.col("day") == d), [F.col("k")], F.col("v")) for d in range(4)]
    both = days[0]
    for d in days[1:]:
        both = both.unionByName(d)
    a = percentiles.percentiles(percentiles.merge(both), [0.25, 0.5])
    b = percentiles.percentiles(percentiles.summary(df, [F.col("k")], F.col("v")), [0.25, 0.5])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_brand_percentiles_by_day(spark, data):
    from cataloom.llm import queries

    whole = {r["id"]: r["n"] for r in queries.p3_brand(spark, data).collect()}
    days = queries.QUERIES["p3_day_brand"](spark, data).collect()
    by = defaultdict(int)
    for r in days:
        by[r["id"]] += r["n"]
    assert dict(by) == whole and len({r["day"] for r in days}) > 1


# ---------------------------------------------------------------- 4 listings


def _makers():
    return listings.Makers([(1, "Kestova"), (2, "Marrow & Pine")])


@pytest.mark.parametrize(
    ("title", "unbroken", "broken", "sizes"),
    [
        ("KESTOVA Yarteta HSS_7121 PN:56611977 11.6 Inches - 8gb ram - 64gb storage", {"HSS7121", "56611977"}, set(), (8, 64)),
        ("Yarteta Model HSS-7121/EU Notebook Memory: 16 GB SSD 2T", {"HSS7121"}, set(), (16, 2048)),
        ("Brindex Jorshona el 3580x Art. 787 96 705 RAM 4GB 0.250 TB M.2 SSD", set(), {"E13580X", "78796705"}, (4, 256)),
        ("Linrira AR-7I09E 512 GB Storage GTR 4070", {"AR7109E"}, set(), (0, 512)),
        ("(NZVOOO7) laptop", {"NZV0007"}, set(), (0, 0)),
        ("GTR 4060 Hot Deal New laptop 32GB DDR4 3200MHz RAM 2000 GB Storage", set(), set(), (32, 2048)),
        ("", set(), set(), (0, 0)),
        (None, set(), set(), (0, 0)),
    ],
)
def test_listing_evidence(title, unbroken, broken, sizes):
    e = listings.evidence(title, None, None, None, _makers(), listings.name_patterns(["GTR 4070", "GTR 4060"]))
    assert e[1] == unbroken and broken <= e[2] and e[3:5] == sizes


def test_component_names_beyond_a_block_are_passed_over(monkeypatch):
    monkeypatch.setattr(listings, "NAMES_BLOCK", 2)
    patterns = listings.name_patterns([f"XR{1000 + i}B" for i in range(7)])
    assert len(patterns) == 4 and listings.identifiers("XR1000B XR1006B QQ1234A", patterns)[0] == {"QQ1234A"}


def test_merged_labels():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    label = np.arange(60)
    listings.merge(label, a[:20], b[:20])
    listings.merge(label, a[20:], b[20:])
    want = np.arange(60)
    for _ in range(60):
        for x, y in zip(a, b):
            want[x] = want[y] = min(want[x], want[y])
    assert (label == want).all()


def test_listing_units():
    for ram in (16.0, 16384.0):
        for drive in (1000.0, 1024.0, 1.0):
            assert listings.evidence("x", None, ram, drive, _makers())[3:5] == (16, 1024)
    assert listings.evidence("marrow & pine QQ1234A", "Kestva", 8.0, 64.0, _makers())[0] == 2
    assert listings.evidence("QQ1234A", "Kestva", None, None, _makers())[0] == 1


def test_training_sample_holds_groups(spark, monkeypatch):
    monkeypatch.setattr(listings, "TRAIN_ROWS", 300)
    # 1,000 pairs and a hot group
    data = [(f"k{i}", [i // 2 + 1], 8, 256, [i]) for i in range(2000)] + [(f"h{i}", [5000], 8, 256, [i]) for i in range(1000)]
    df = spark.createDataFrame(data, "key string, ids array<long>, ram int, storage int, features array<int>")
    by = defaultdict(int)
    for r in listings._sample(df, "key", 3000).collect():
        by[r["label"]] += 1
    assert 100 <= sum(by.values()) <= 300 and set(by.values()) <= {2, listings.GROUP_ROWS}


def test_lists_extend_to_the_tuned_recall(spark, monkeypatch):
    monkeypatch.setattr(listings, "FIRST_LISTS", 1)
    monkeypatch.setattr(listings, "LIST_AIM", 3)
    rng = random.Random(6)
    codes = [f"HS{i:04d}X" for i in range(2000, 2040)]
    words = ["Notebook", "Laptop", "New", "Hot Deal", "2023", "Slim", "Silver", "Black", "Office", "Student"]
    data = [(f"p{i}", f"Kestova {' '.join(rng.sample(words, 4))} {codes[i % 40]} 8GB RAM 256GB SSD", "Kestova", i) for i in range(120)]
    df = spark.createDataFrame(data, "parent_asin string, title string, brand string, loaded_at int").withColumns({"ram_gb": F.lit(8.0), "storage_gb": F.lit(256.0)})
    ref = spark.createDataFrame([(1, "brand", "Kestova")], "ref_id long, field_name string, canonical_value string")
    found = listings.SameProduct(df, "parent_asin", "loaded_at", ref)
    assert found.recall >= listings.TUNED_RECALL and found.probes > 1


def test_same_product(spark):
    spec = "parent_asin string, title string, brand string, ram_gb double, storage_gb double, loaded_at timestamp, maker string"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    data = [
        ("a", "Kestova Yarteta HSS-7121 laptop 8GB RAM 256GB SSD", "Kestova", 8.0, 256.0), ("b", "yarteta hss7121 P/N 56611977 notebook, WiFi 6", "Kestva", 8192.0, 256.0), ("c", "SKU#56611977 Yarteta best seller 8 GB Memory", None, None, 256.0),
        ("d", "Kestova Yarteta HSS-7122 laptop 8GB RAM 256GB SSD", "Kestova", 8.0, 256.0), ("e", "Kestova Yarteta HSS-7121 laptop 16GB RAM 256GB SSD", "Kestova", 16.0, 256.0), ("f", "Keyboard Cover for Kestova HSS-7121", "X", None, None),
        ("g", None, "Kestova", 8.0, 256.0), ("g2", None, "Kestova", 8.0, 256.0), ("k", "Kestova Yarteta hss7121 laptop! 8GB RAM, 256GB SSD", "Kestova", 8.0, 256.0), ("l", "kestova yarteta HSS 7121 laptop 8GB RAM 256GB SSD", "Kestova", 8.0, 256.0),
        ("o", "Norvik Ormil S29 Q67E Art. 627 92 576 8GB RAM 256GB SSD slim", None, 8.0, 256.0), ("p", "Ormil S29 Q67E laptop 8GB RAM 256GB SSD Art. 627 92 576", None, 8.0, 256.0), ("q", "Norvik Ormil S29 Q68E laptop 8GB RAM 256GB SSD", None, 8.0, 256.0), ("h", "Marrow & Pine HSS-7121 8GB RAM 256GB SSD", "Marrow & Pine", 8.0, 256.0), (None, "Kestova HSS-7121", "Kestova", 8.0, 256.0),
    ]
    df = spark.createDataFrame([(*r, t, "mine") for r in data] + [(*data[0], dt.datetime(2024, 2, 1), "mine")], spec)
    ref = spark.createDataFrame([(1, "brand", "Kestova"), (2, "brand", "Marrow & Pine"), (3, "gpu_model", "GTR 4070")], "ref_id long, field_name string, canonical_value string")
    got = listings.SameProduct(df, "parent_asin", "loaded_at", ref)
    # o and p write their identifiers with blanks only: the encoder finds them, the one that differs is vetoed
    assert {tuple(r) for r in got.pairs().collect()} == {*itertools.combinations("abckl", 2), ("o", "p")}
    assert got.groups().count() == 7 and got.links.count() <= 7 + 3
    assert listings.SameProduct(df.where("false"), "parent_asin", "loaded_at", ref).pairs().count() == 0


def test_listings_search_moves_few_vectors_and_finds_every_mutual_pair(spark, monkeypatch):
    monkeypatch.setattr(listings, "LIST_ROWS", 5)  # one identifier and some lists become grids
    r, n = np.random.default_rng(4), 90
    x = r.standard_normal((n, listings.WIDTH)) * 0.5 + r.standard_normal((3, listings.WIDTH))[r.integers(0, 3, n)]
    v = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f2")
    ids = [[] if i % 4 == 0 else [7] if i % 4 == 1 else sorted({int(c) for c in r.integers(10, 22, 2)}) for i in range(n)]
    lists = [[int(c) for c in r.permutation(4)[:2]] for _ in range(n)]
    data = [(f"k{i:02}", ids[i], ids[i] or [int(r.integers(10, 22))], int(r.integers(-1, 2)), int(bool(ids[i])), 8, int(r.integers(1, 3)), bytearray(v[i].tobytes()), lists[i]) for i in range(n)]
    placed = spark.createDataFrame(data, "key string, ids array<long>, maybe array<long>, maker long, named int, ram int, storage int, v binary, lists array<int>")
    search = object.__new__(listings.SameProduct)
    search.key, search.kind = "key", "string"
    pdf = placed.toPandas()
    sides = listings.facts(pdf)
    i, j = (k.ravel() for k in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    mutual = np.array([lists[a][0] in lists[b] and lists[b][0] in lists[a] for a, b in zip(i, j)])
    near = (v.astype(np.float32) @ v.astype(np.float32).T)[i, j]
    ok = (i != j) & mutual & (near >= listings.SIMILARITY)
    ok[ok] = listings.compatible(sides, i[ok], sides, j[ok], near[ok])
    label = np.arange(n)
    listings.merge(label, i[ok], j[ok])
    links = search._search(placed, 2).collect()
    got = np.arange(n)
    listings.merge(got, np.array([int(x.a[1:]) for x in links]), np.array([int(x.b[1:]) for x in links]))
    assert ok.sum() > 40 and (got == label).all()
    assert any(named == 0 for named in sides["named"][i[ok]])
    assert search._by_lists(placed.withColumn("home", F.col("lists")[0]).where("named = 1")).count() == 0  # these ask in no list


def test_listings_leave_no_table_that_nothing_reads(spark, data):
    from cataloom.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "cataloom"
    before = {x.name for x in folder.iterdir()} if folder.exists() else set()
    found = listings.SameProduct(table(spark, data, "products"), "parent_asin", "loaded_at", table(spark, data, "canonical_values"))
    left = {x.name.rpartition("-")[0] for x in folder.iterdir() if x.name not in before}
    assert found.links.count() and not left & {"listings-read", "listings-evidence", "listings-placed"}


def test_listings_plans_read_no_table_again_for_each_side(spark, data, monkeypatch):
    reads = defaultdict(int)  # the driver holds each plan, and again for each of its stages

    def counted(df, name, *compression):
        reads[name] = max(reads[name], df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return staged(df, name, *compression)

    for module in (listings, stars):
        monkeypatch.setattr(module, "staged", counted)
    assert listings.SameProduct(table(spark, data, "products"), "parent_asin", "loaded_at", table(spark, data, "canonical_values")).pairs().count()
    assert max(reads[n] for n in ("listings-copies", "listings-single", "listings-identifiers", "listings-evidence", "components")) <= 4, dict(reads)


def test_listings_meet_hot_keys_as_others(spark):
    left = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    for n in (5, 1001):
        right = spark.createDataFrame([(0, n), (3, 2), (9, n)], "k long, n long")
        assert sorted(map(tuple, listings._met(left, right, "k", 3000).collect())) == [(k, i, n if k == 0 else 2) for k in (0, 3) for i in range(k, 3000, 7)]


# ---------------------------------------------------------------- 5 near duplicates


def _brute(texts: dict[int, str], threshold: float, size: int, least: int) -> set[tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= least:
            sets[i] = set(zip(*(w[k:] for k in range(size))))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def _mutated(rng: random.Random, words: list[str], n: int) -> list[str]:
    w = list(words)
    for _ in range(n):
        i, k = rng.randrange(len(w)), rng.random()
        if k < 0.4:
            w[i] = f"x{rng.randrange(1000)}"
        elif k < 0.6:
            w.insert(i, f"y{rng.randrange(1000)}")
        elif k < 0.8 and len(w) > 12:
            del w[i]
        else:
            w = w[i:] + w[:i]
    return w


@pytest.mark.parametrize("hot", [20_000, 5])
def test_near_duplicates_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts, base = {}, []
    for i in range(160):
        words = _mutated(rng, rng.choice(base), rng.randrange(0, 6)) if base and rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(8, 120))]
        base.append(words)
        texts[i] = " ".join(words)
    texts |= {200 + i: "one text, held by many. " * 5 for i in range(40)}
    data = [(i, t, 1, "c") for i, t in texts.items()] + [(0, "an older version", 0, "c"), (900, None, 1, "c"), (901, "", 1, "c"), (902, "short", 1, "c"), (None, texts[200], 1, "c")]
    df = spark.createDataFrame(data, "id long, text string, at int, class string").repartition(3)
    near = neardup.NearDuplicates(df, "id", "text", "at", 0.6, 3, 10)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(texts, 0.6, 3, 10)
    groups = {r["id"]: r["group_id"] for r in near.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and len({groups[i] for i in range(200, 240)}) == 1


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "id long, text string, at int")
    assert neardup.NearDuplicates(df, "id", "text", "at").pairs().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=3, max_size=90, unique=True), st.lists(st.integers(0, 40), min_size=3, max_size=90, unique=True))
def test_sketch_never_differs_more_than_the_sets(a, b):
    from cataloom.llm.words import mix

    h = [np.sort(mix(np.array(sorted(x), np.uint64) + np.uint64(7))) for x in (a, b)]
    start = np.array([0, len(a), len(a) + len(b)])
    s = neardup.sketches(start, np.concatenate(h))
    differ = len(set(a) ^ set(b))
    narrow = s[:, :2] ^ s[:, 2:]
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= differ and np.bitwise_count(narrow[0] ^ narrow[1]).sum() <= differ


def test_region_entries_meet_only_what_length_and_position_leave(monkeypatch):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 90, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in r.integers(10, 120, 150)]
    sets += [np.unique(np.r_[s[2:], s[:1] + np.uint64(1)]) for s in sets[:40]]
    start, h = np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets)
    ids, size = neardup.class_ids(start, h), np.diff(start)
    cells = np.bincount(neardup.cell(h, 1 << 12), minlength=1 << 12).astype(np.uint32)
    owner, position, shingle = neardup.replicas(start, h, cells, 0.6)
    blobs = [b for _, b in neardup.pack(owner, position, shingle, np.zeros(len(owner), np.int64), ids, size, neardup.sketches(start, h))]
    tested, window = [], neardup.window
    monkeypatch.setattr(neardup, "window", lambda i, *rest: tested.append(len(i)) or window(i, *rest))
    a, b = neardup.region_pairs(blobs, 0.6, chunk=500)
    _, count = np.unique(shingle.astype(np.uint32), return_counts=True)
    assert max(tested) < 1000 and sum(tested) < 0.6 * (count * (count - 1) // 2).sum()
    alike = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}
    assert len(alike) >= 30 and alike <= set(zip(a.tolist(), b.tolist()))


# ---------------------------------------------------------------- 6 canonical values

ENTRIES = [(1, "brand", "Kestova", 5), (2, "brand", "Marrow & Pine", 1), (3, "brand", "Orbis Nine", 1), (4, "cpu_family", "Zentor 7", 1), (5, "cpu_family", "Zentor 7 Pro", 1), (6, "gpu_model", "GTR 3050", 1), (7, "gpu_model", "GTR 3050 Ti", 1), (8, "cpu_family", "Cortane C5", 1)]


@pytest.mark.parametrize(
    ("field", "typed", "ref"),
    [
        ("brand", "KESTOVA ", 1), ("brand", "Visit the Késtová Store", 1), ("brand", "K E S T O V A", 1), ("brand", "Kestоvа", 1), ("brand", "Ketsova", 1), ("brand", "Kesttpva", 1), ("brand", "M&P", 2), ("brand", "Marrow and Pine", 2),
        ("brand", "Orbis-IX", 3), ("brand", "Silverfen", -1), ("brand", "?!", -1), ("brand", "x" * 5000, -1), ("cpu_family", "Zentor 7 rPo", 5), ("cpu_family", "Zentor 4", -1), ("cpu_family", "Zntor 7-9802H", 4), ("cpu_family", "Cortane v5", 8),
        ("cpu_family", "Cortane C8", -1), ("gpu_model", "GTR 3050 Tii", 7), ("gpu_model", "Vidara GTR3050 (6 GB)", 6), ("gpu_model", "GTR 3065", -1), ("brand", "Zentor 7", -1),
    ],
)
def test_lookup(field, typed, ref):
    assert canonical.Dictionary(ENTRIES).lookup(field, typed)[0] == ref


@settings(max_examples=80, deadline=None)
@given(st.text("abcde", max_size=7), st.text("abcde", max_size=7))
def test_distance_is_damerau_levenshtein(a, b):
    def edits(x: str) -> set[str]:
        out = {x[:i] + x[i + 1 :] for i in range(len(x))} | {x[:i] + c + x[i:] for i in range(len(x) + 1) for c in "abcde"}
        return out | {x[:i] + c + x[i + 1 :] for i in range(len(x)) for c in "abcde"} | {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for i in range(len(x) - 1)}

    d = canonical.distance(a, b)[0]
    assert (d == 0) == (a == b) and (d <= 1) == (a == b or b in edits(a))
    if d <= canonical.MAX_EDITS:
        assert canonical.deletes(a, 2) & canonical.deletes(b, 2)


def test_blocks_resolve_as_the_whole_list(spark):
    names = ["Marrow Pine", "Marrow Gate", "KESTOVA", "Kestova", "Orbis Nine"]
    ref = spark.createDataFrame([(i, "brand", v) for i, v in enumerate(names, 1)], "ref_id long, field_name string, canonical_value string")
    typed = ["Marrow", "Marrow Pine", "MG", "Kestova", "KESTOVA", "KESTOVA", "Orbis", "Marow Gate", "Silverfen"]
    df = spark.createDataFrame([(f"a{i}", v) for i, v in enumerate(typed)], "parent_asin string, brand string")
    for block in (1, 2, 20):
        got = {r["parent_asin"]: r["ref_id"] for r in canonical.resolve(df, ref, ["brand"], "parent_asin", block_entries=block).collect()}
        assert [got[f"a{i}"] for i in range(len(typed))] == [-1, 1, 2, 4, 3, 3, 5, 2, -1]


def test_resolve_in_blocks_and_cases(spark):
    ref = spark.createDataFrame([e[:3] for e in ENTRIES], "ref_id long, field_name string, canonical_value string")
    data = [("a", "Kestova", "Zntor 7"), ("b", "kestva", None), ("c", "n/a", "  "), ("d", None, "Unknown"), ("e", "kestva", "nothing here")]
    df = spark.createDataFrame(data, "parent_asin string, brand string, cpu_family string").withColumn("cost", F.lit("clash"))
    want = {("a", "cpu_family", 4), ("b", "brand", 1), ("e", "brand", 1), ("e", "cpu_family", -1)}
    assert {tuple(r) for r in canonical.unresolved(df, ref, ["brand", "cpu_family"], "parent_asin").collect()} == want
    small = canonical.resolve(df, ref, ["brand", "cpu_family"], "parent_asin", block_entries=2).where("NOT literal")
    assert {(r["parent_asin"], r["field_name"], r["ref_id"]) for r in small.collect()} == want
    none = canonical.resolve(df, ref.where("false"), ["brand"], "parent_asin")
    assert {r["ref_id"] for r in none.collect()} == {-1}
    assert canonical.unresolved(df.where("false"), ref, ["brand"], "parent_asin").count() == 0


@pytest.mark.parametrize("block", [1, 2, 20])
def test_variants_that_fold_onto_an_entry_are_reported(spark, block):
    """Other case, blanks, decorations and look-alikes aren't literally the entry, though no edit parts them from it."""
    ref = spark.createDataFrame([e[:3] for e in ENTRIES], "ref_id long, field_name string, canonical_value string")
    typed = {"Kestova": None, "KESTOVA": 1, " Kestova": 1, "Kestova ": 1, "BY KESTOVA": 1, "Kestova (official)": 1, "Kеstоva": 1, "Visit the Orbis Nine Store": 3, "marrow & pine": 2, "Marrow & Pine": None, "Orbis 9": 3, "Silverfen": -1}
    df = spark.createDataFrame([(v, v) for v in typed], "parent_asin string, brand string")
    got = {r["parent_asin"]: r["ref_id"] for r in canonical.unresolved(df, ref, ["brand"], "parent_asin", block).collect()}
    assert got == {v: i for v, i in typed.items() if i is not None}


# ---------------------------------------------------------------- 7 encoding


def _slow(ranks, piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=40))
def test_merge_order(text):
    tokens = [b"a", b"b", b"c", b"ab", b"bc", b"aa", b"aab", b"abc", b"aaaa", b"cab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    assert bpe.Encoder(ranks, r"[a-z]+").encode(text) == (_slow(ranks, text.encode()) if text else [])


def test_rank_queue():
    q, rng, held = bpe.RankQueue(1 << 17), random.Random(5), []
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            e = (rng.randrange(1 << 17), rng.randrange(100))
            q.push(*e)
            held.append(e)
        else:
            held.sort()
            assert q.pop() == held.pop(0)
    assert [q.pop() for _ in range(len(held))] == sorted(held) and q.pop() is None


@pytest.mark.skipif(not TOKENIZERS.exists(), reason="no vocabulary files")
def test_encoding_equals_the_public_library(spark, data):
    import tiktoken

    path = str(TOKENIZERS / "byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    df = table(spark, data, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> it's  \n\n x"), (-4, "a" * 30000), (-5, "日本語 🎉 é"), (-1, None)], "doc_id long, text string")
    got = bpe.encode_corpus(df.unionByName(extra).withColumn("ids", F.lit("clash")), "doc_id", "text", path).collect()
    texts = {r["doc_id"]: r["text"] for r in df.unionByName(extra).collect()}
    assert len(got) == df.count() + 6
    for r in got:
        assert r["ids"] == (reference.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else [])
    assert bpe.encode_corpus(df.where("false"), "doc_id", "text", path).count() == 0


# ---------------------------------------------------------------- 8 leakage


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for i in range(25)}
    docs = {}
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))]
        if rng.random() < 0.6:
            source = items[rng.randrange(25)]
            n, a = rng.randrange(3, 25), rng.randrange(len(source))
            at = rng.randrange(len(words) + 1)
            words[at:at] = source[a : a + n]
        docs[d] = words
    dress = lambda w: " ".join(rng.choice([x, x.upper(), f"<b>{x}</b>", f"{x},", f"({x})\n", f"{x[0]}­{x[1:]}"]) for x in w)
    df = spark.createDataFrame([(d, dress(w), 1) for d, w in docs.items()] + [(0, " ".join(docs[0]), 1), (900, None, 1), (901, "", 1)], "doc_id long, text string, words int")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (None, "x " * 20), (51, " ".join(items[3]))], "item_id long, passage string")
    items[51] = items[3]

    def runs(w):
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    want = {(d, i) for d, w in docs.items() for i, p in items.items() if runs(w) & runs(p)}
    for words in (leakage.BLOCK_WORDS, 100):
        got = [(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "passage", block_words=words).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaks(df.where("false"), "doc_id", "text", it, "item_id", "passage").count() == 0
    assert leakage.leaks(df, "doc_id", "text", it.where("false"), "item_id", "passage").count() == 0


def test_plain_words():
    assert plain_words("Betw­een <b>Café</b>&amp;ﬁne Ｐａｎｅｌ over-\n lap") == ["between", "cafe", "fine", "panel", "overlap"]
    assert plain_words(None) == [] and len(shingles(Hasher().words(["a", "b"]), 3)) == 0


def test_leaks_with_text_ids(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([("d1", f"before. {passage.upper()}!"), ("d2", passage[:40]), ("d3", None)], "doc string, text string")
    items = spark.createDataFrame([("x", passage), ("y", "too short"), (None, passage)], "item string, passage string")
    assert {tuple(r) for r in leakage.leaks(docs, "doc", "text", items, "item", "passage").collect()} == {("d1", "x", 12)}


# ---------------------------------------------------------------- 9 stuffing

PROSE = "The keyboard is quiet and the hinge feels sturdy. We ordered ours from a shop in town, and the parcel reached us in six days."


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, False), ("", False), ("   ", False), (PROSE, False), (PROSE + " Tags: laptop, bag, mouse", False), ("laptop deals " * 30, True), ("#laptop #deals #bag #mouse #sale #router #cheap", True),
        ("\n".join(f"[cheap laptop](http://shop{i}.test/)" for i in range(12)), True), ("\n".join(f"1. {PROSE} (http://a{i}.test)" for i in range(4)), False), ("aaaa" * 400, False), ("....!!!???---===", False), ("QxWwul/vYx5YZGfB+IBPG" * 40, False), ("model;ram;price\nA1;4 GB;$9\nA2;8 GB;$8\nA3;4 GB;$7\nA4;8 GB;$6", False),
        ('{"model": "X 520", "ram_gb": 44, "tags": ["Great for Students", "Sky"], "price": 1565.99, "ok": true}', False), ("\n".join(f"AB{1000 + i} laptop price MAKER SALE" for i in range(15)), True),
        ("Buy desk lamp today because desk lamp is the desk lamp you want. When you need desk lamp, choose desk lamp from our desk lamp store. " * 4, True), (PROSE + "\n" + "cheap laptop " * 40, True),
        ("Processor: X5\nMemory: 16 GB\nStorage: 256 GB\nPrice: $1160", False), ("Панель нагрелась до 64 градусов. За 6 недель работы динамик не подвёл. Экран 15 дюйма, если не шуметь.", False),
    ],
)
def test_stuffed(text, expected):
    assert stuffing.stuffed(stuffing.judge(text)) is expected


def test_nothing_is_stuffed_without_the_automaton(monkeypatch):
    pages = ["laptop deals " * 30, "Buy desk lamp today because desk lamp is the desk lamp you want. When you need desk lamp, choose desk lamp from our desk lamp store. " * 4, "#a1 #b2 #c3 #d4 #e5"]
    assert all(stuffing.stuffed(stuffing.judge(p)) for p in pages)
    monkeypatch.setattr(stuffing.SuffixAutomaton, "repeated", lambda self, times=2: [0] * len(self.prefix))
    assert not any(stuffing.stuffed(stuffing.judge(p)) for p in pages)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(2, 3))
def test_suffix_automaton_against_brute_force(seq, times):
    a = stuffing.SuffixAutomaton(seq)
    count = lambda s: sum(seq[i : i + len(s)] == s for i in range(len(seq) - len(s) + 1))
    want = [max((n for n in range(1, i + 2) if count(seq[i + 1 - n : i + 1]) >= times), default=0) for i in range(len(seq))]
    assert a.repeated(times) == want


def test_stuffing_frame(spark):
    df = spark.createDataFrame([(1, PROSE, "x"), (2, "cheap laptop " * 30, "x"), (2, "cheap laptop " * 30, "x"), (3, None, "x"), (4, (PROSE + " ") * 3000, "x")], "doc_id long, text string, stuffed string")
    assert sorted((r["doc_id"], r["stuffed"]) for r in stuffing.stuffing(df, "doc_id", "text").collect()) == [(1, False), (2, True), (2, True), (3, False), (4, False)]
    assert stuffing.stuffing(df.where("false"), "doc_id", "text").count() == 0
