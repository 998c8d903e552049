"""Operators on small fixtures, and properties over the smallest tables."""

from __future__ import annotations

import datetime
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cataloom import catalog
from cataloom.functions import stats
from cataloom.functions.text import clean_text
from cataloom.operators import audit, ingest, matching, models, pricing, retrieval, search, sentiment
from cataloom.operators.components import components
from cataloom.operators.impute import Fill, fill_missing, filled_cells
from cataloom.sources import io
from tests.conftest import rows

# ---------------------------------------------------------------- filling


def _fill(spark, data, levels, kind="median", least=2):
    df = spark.createDataFrame(data, "id string, k string, j string, v string, level string, salt string")
    known = F.col("v").try_cast("double") if kind == "median" else F.col("v")
    return fill_missing(df, "id", [Fill("v", known, levels, kind, least)])


def test_fill_backs_off_and_marks(spark):
    data = [("a", "x", "p", "1", "", ""), ("b", "x", "p", "3", "", ""), ("c", "x", "p", None, "", ""), ("d", "y", "p", None, "", ""), ("e", "y", "q", None, "", ""), ("f", None, None, None, "", "")]
    got = {r["id"]: (r["v"], r["v_filled"], r["v_level"]) for r in _fill(spark, data, [("k",), ("j",), ()]).collect()}
    assert got["a"] == (1.0, False, None)
    assert got["c"] == (2.0, True, 0)
    assert got["d"] == (2.0, True, 1)
    assert got["e"] == (2.0, True, 2)
    assert got["f"] == (2.0, True, 2)


def test_fill_mode_ties_go_to_the_smallest(spark):
    data = [("a", "x", "", "b", "", ""), ("b", "x", "", "a", "", ""), ("c", "x", "", None, "", ""), ("d", "z", "", None, "", "")]
    got = {r["id"]: (r["v"], r["v_filled"]) for r in _fill(spark, data, [("k",)], "mode").collect()}
    assert got["c"] == ("a", True)
    assert got["d"] == (None, False)


def test_fill_empty_and_clashing_columns(spark):
    out = _fill(spark, [], [("k",), ()])
    assert out.count() == 0 and {"v_filled", "v_level", "level", "salt"} <= set(out.columns)
    data = [("a", "x", "p", "1", "mine", "too"), ("b", "x", "p", None, "mine", "too")]
    got = _fill(spark, data, [("k",)], least=1)
    assert rows(filled_cells(got, "id", ["v"])) == [("b", "v")]
    assert {(r["level"], r["salt"]) for r in got.collect()} == {("mine", "too")}


def test_fill_hot_group(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("hot").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    out = fill_missing(df, "id", [Fill("v", F.col("v"), [("k",)], "median", 5)])
    want = float(np.median([i for i in range(3000) if i % 3]))
    assert [tuple(r) for r in out.where("v_filled").select("v").distinct().collect()] == [(want,)]
    assert out.where("v_filled").count() == 1000


# ---------------------------------------------------------------- components


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (None, 9)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(rows(components(spark.createDataFrame(edges, "x long, y long"), "x", "y")))
    assert {got[i] for i in (1, 2, 3)} == {1} and got[4] == got[5] == 4 and got[7] == 7
    assert {got[i] for i in range(100, 131)} == {100} and 9 not in got
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# ---------------------------------------------------------------- statistics


def test_price_block_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", None), ("a", math.inf), ("b", None)], "g string, price double")
    got = {r["g"]: r for r in df.groupBy("g").agg(*stats.price_block(F.col("price"))).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["n_total"], a["p10"], a["p25"], a["median"], a["p75"], a["p90"]) == (4, 6, 1.3, 1.75, 2.0, 2.5, 3.4)
    assert (b["n"], b["coverage"], b["median"], b["std"], b["reliable"]) == (0, 0.0, None, None, False)


def test_average_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 2, 4)], "g string, v int")
    got = [r["p"] for r in stats.with_ranks(df, ["g"], "v", "r", "p").orderBy("v").collect()]
    assert got == [25.0, 62.5, 62.5, 100.0]


def test_p_values():
    assert abs(stats.normal_p(1.959964) - 0.05) < 1e-6
    assert abs(stats.correlation_p(0.5, 12) - 0.0978) < 5e-4


def test_position_leaves_the_listing_out(spark):
    prices = {"s": [10.0, 20.0, 20.0, 30.0, 90.0], "t": [5.0, 7.0], "u": [3.0]}
    data = [(f"{g}{i}", g, p) for g, ps in prices.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(data, "parent_asin string, segment string, price double")
    for r in pricing.price_position(df, "segment", "s").collect():
        g, i = r["parent_asin"][0], int(r["parent_asin"][1])
        others = prices[g][:i] + prices[g][i + 1 :]
        assert r["s_n"] == len(others)
        assert r["s_median"] == (float(np.median(others)) if others else None)


def test_catalogue_properties(spark, data):
    cat = catalog.products(spark, data)
    ingest.assert_unique(cat, "parent_asin")
    for r in pricing.group_price_table(cat, "segment").collect():
        assert 0 <= r["coverage"] <= 1 and r["reliable"] == (r["n"] >= 5)
        if r["n"]:
            assert r["p10"] <= r["p25"] <= r["median"] <= r["p75"] <= r["p90"]


# ---------------------------------------------------------------- search


def _listings(spark):
    data = [("a", "Kestova pro laptop", "Kestova", "gaming", 900.0, 16.0, 4.0, 50, 10), ("b", "Other laptop kestova", "Other", "budget", None, 8.0, 3.0, 5, 90), ("c", None, "Third", "budget", 300.0, None, None, 0, 1)]
    df = spark.createDataFrame(data, "parent_asin string, title string, brand string, segment string, price double, ram_gb double, average_rating double, rating_number long, n_reviews long")
    for c in ("cpu_family", "gpu_model", "os_family"):
        df = df.withColumn(c, F.lit("Unknown"))
    for c in ("screen_w", "screen_h", "storage_gb", "cpu_tier", "screen_in"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    return df.withColumn("is_discrete_gpu", F.col("segment") == "gaming").withColumn("is_renewed", F.lit(False)).withColumn("has_sentiment", F.lit(True))


def test_search(spark):
    df = _listings(spark)
    assert [r["parent_asin"] for r in search.page(df, search.Filters(), "kestova laptop").collect()] == ["a", "b"]
    assert [r["parent_asin"] for r in search.page(df, search.Filters(), sort="price_asc").collect()] == ["c", "a", "b"]
    assert [r["parent_asin"] for r in search.page(df, search.Filters(), sort="price_desc", limit=1, offset=1).collect()] == ["c"]
    assert [r["parent_asin"] for r in search.page(df, search.Filters(min_ram=8)).collect()] == ["b", "a"]
    assert [r["parent_asin"] for r in search.page(df, search.Filters(max_price=1000)).collect()] == ["a", "c"]
    assert search.display_table(df).where("parent_asin = 'c'").first()["ram"] == "unknown"


@pytest.mark.parametrize("bad", [{"sort": "x"}, {"limit": 0}, {"limit": 201}, {"offset": -1}])
def test_search_rejects(spark, bad):
    with pytest.raises(ValueError):
        search.page(_listings(spark), search.Filters(), **bad)


def test_filters_reject():
    with pytest.raises(ValueError):
        search.Filters(segments=("nope",))
    with pytest.raises(ValueError):
        search.Filters(min_price=5, max_price=1)


def test_lookup_missing(spark):
    with pytest.raises(KeyError):
        search.lookup(_listings(spark), "zz")
    with pytest.raises(KeyError):
        pricing.compare_products(_listings(spark), ["a", "zz"])


# ---------------------------------------------------------------- matching


def test_guard_leaks_nothing(spark, data):
    feats = matching.features(catalog.products(spark, data), catalog.vectors(spark, data)).cache()
    got = matching.competitors(feats, feats, matching.Options(k=5)).collect()
    assert got and all(r["affinity"] >= 0.25 for r in got)
    assert all(1 / 4.5 - 1e-9 <= r["price_ratio"] <= 4.5 + 1e-9 for r in got)
    assert all(r["query"] != r["candidate"] for r in got)


def test_modes_in_one_pass_and_every_block_a_task(spark, data, monkeypatch):
    feats = matching.features(catalog.products(spark, data), catalog.vectors(spark, data)).cache()
    modes = matching.Options(k=5), matching.Options(k=5, guard=False)
    n = feats.count()
    shown = lambda df: rows(df.select("query", "candidate", "score", "rank"))
    alone = [shown(matching.competitors(feats, feats, o)) for o in modes]
    monkeypatch.setattr(matching, "tasks", lambda *_: (-(-n // 3), 1))
    both = matching.competitors_by_mode(feats, feats, *modes).cache()
    assert [shown(both.where(F.col("mode") == m)) for m in (0, 1)] == alone
    assert matching._scored(feats, feats, modes)[0].rdd.getNumPartitions() == 3


@pytest.mark.parametrize("o", [matching.Options(per_brand=None), matching.Options(guard=False, per_brand=None), matching.Options(priced_only=True, same_brand=False, per_brand=None)])
def test_few_pairs_are_scored_twice_and_none_of_the_best_is_lost(monkeypatch, o):
    r, n, size = np.random.default_rng(3), 6000, 40
    unknown = lambda x: np.where(r.random(n) < 0.3, np.nan, x)
    x = r.standard_normal((n, 16))
    c = pd.DataFrame({"parent_asin": [f"p{i:05}" for i in range(n)], "brand": r.choice(list("abcd"), n), "segment": r.choice(["gaming", "budget", "chromebook", "odd"], n), "estimate": np.round(r.uniform(100, 900, n), 1), "observed": r.random(n) < 0.7})
    c["embedding"], c["sig"] = list(x / np.linalg.norm(x, axis=1)[:, None]), r.choice(["", "s", "t", "u"], n)
    for name, *_ in matching.FEATURES:
        c[f"f_{name}"] = unknown(np.round(r.random(n), 2))
    c.loc[1, "estimate"] = c.loc[0, "estimate"] * o.band  # at the edge of the band
    near = {(s, s): 1.0 for s in ("gaming", "budget", "chromebook")} | {("gaming", "budget"): 0.3, ("budget", "gaming"): 0.3}
    q = c.iloc[:20].reset_index(drop=True)
    scored, exact = [], matching.spec_of_pairs
    monkeypatch.setattr(matching, "spec_of_pairs", lambda a, i, b, j: scored.append(len(i)) or exact(a, i, b, j))
    block = matching._Block(q, near, (o,), [size])
    for start in range(0, n, 2500):
        block.meet(c.iloc[start : start + 2500])
    got = pd.concat(block.result(False))
    assert sum(scored) < 0.2 * len(q) * n

    (v, f), (w, g) = matching._arrays(q), matching._arrays(c)
    kin = np.array([[near.get((a, b), np.nan if o.guard else 0.5) for b in c["segment"]] for a in q["segment"]])
    ratio = c["estimate"].to_numpy()[None, :] / q["estimate"].to_numpy()[:, None]
    score = o.text_weight * (v @ w.T) + (1 - o.text_weight) * matching.spec_similarity(f, g)
    ok = (q["parent_asin"].to_numpy()[:, None] != c["parent_asin"].to_numpy()) & ((q["sig"].to_numpy()[:, None] == "") | (q["sig"].to_numpy()[:, None] != c["sig"].to_numpy()))
    if o.guard:
        seen = q["observed"].to_numpy()[:, None] & c["observed"].to_numpy()
        ok &= (kin >= o.min_affinity) & (np.abs(np.log(ratio)) <= np.where(seen, np.log(o.band), np.log(2 * o.band)))
        score = score - o.segment_penalty * (1 - kin) - o.price_penalty * np.minimum(1, np.abs(ratio - 1))
    if o.priced_only:
        ok &= c["observed"].to_numpy()
    if o.same_brand is not None:
        ok &= (q["brand"].to_numpy()[:, None] == c["brand"].to_numpy()) == o.same_brand
    for i in range(len(q)):
        best = sorted((-round(score[i, j], 6), c["parent_asin"][j]) for j in np.flatnonzero(ok[i]))[:size]
        mine = got[got["query"] == q["parent_asin"][i]]
        assert sorted(zip(-mine["score"], mine["candidate"])) == best


def test_document_and_fingerprint(spark, data):
    docs = matching.product_document(catalog.products(spark, data))
    a = matching.fingerprint(docs, "m").first()
    b = matching.fingerprint(docs.orderBy(F.rand(1)), "m").first()
    assert a == b and matching.fingerprint(docs, "other").first()["fingerprint"] != a["fingerprint"]


# ---------------------------------------------------------------- sentiment


def _clauses(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(sentiment.clauses(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The screen is gorgeous. But the fan is so loud!", ["The screen is gorgeous.", "But the fan is so loud!"]),
        ("It runs well but it gets hot", ["It runs well", "but it gets hot"]),
        ("Bring e.g. a fan. Works fine", ["Bring e.g. a fan.", "Works fine"]),
        ("ok", []),
        ("", []),
        (None, []),
    ],
)
def test_clauses(spark, text, expected):
    assert _clauses(spark, text) == expected


def test_tfidf_keeps_all_terms(spark):
    # 150,100 words and 150,099 pairs of neighbours, each in both documents
    text = " ".join(f"w{i}" for i in range(150_100))
    df = spark.createDataFrame([("a", text), ("b", text)], "k string, t string")
    assert retrieval.index(df, "k", F.col("t")).postings.where("k = 'a'").count() == 300_199


def test_clause_limit(spark):
    assert len(_clauses(spark, "word again. " * 100)) == 40


def test_aspects(spark):
    df = spark.createDataFrame([("battery life is great and it never gets hot",), ("chargeable",), (None,)], "t string")
    assert [r[0] for r in df.select(sentiment.aspects(F.col("t"))).collect()] == [["battery", "thermals_noise"], [], []]


def test_metrics_divide_by_zero(spark):
    df = spark.createDataFrame([(True, True)] * 3, "truth boolean, predicted boolean")
    r = sentiment.binary_metrics(df).first()
    assert (r["accuracy"], r["f1_pos"], r["f1_neg"], r["macro_f1"]) == (1.0, 1.0, 0.0, 0.5)


def test_backend_registry(spark):
    class Length:
        calibration = None

        def polarity(self, texts):
            return [min(1.0, len(t) / 10) for t in texts]

    sentiment.register("length", Length)
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    assert [r["p"] for r in sentiment.backend_polarity(df, "text", "p", "length").orderBy("id").collect()] == [0.3, 0.0]
    with pytest.raises(KeyError):
        sentiment.backend_polarity(df, "text", "p", "nothing")


# ---------------------------------------------------------------- retrieval and audit


def _asked(spark, *questions, brands=("Kestova",)):
    q = spark.createDataFrame([(i, x) for i, x in enumerate(questions)], "question_id int, question string")
    rows = retrieval.read(q, spark.createDataFrame([(b,) for b in brands], "brand string")).collect()
    return [r["ask"] for r in sorted(rows, key=lambda r: r["question_id"])]


def test_slots(spark):
    a, b, c, d, e = _asked(
        spark, "Which gaming laptop under $1,500 with 16 GB RAM is best for battery?", "under 1.5", "rivals of a Kestova between $900 and $500", "a 14 inch i5 with 512 GB SSD around $700", None
    )
    assert (a["question_type"], a["price_max"], a["ram_min"], a["segments"], a["discrete_gpu"]) == ("recommend", 1500.0, 16.0, ["gaming"], True) and "battery" in a["aspects"]
    assert b["price_max"] == 1500.0 and b["wants_price_stats"]
    assert (c["question_type"], c["price_min"], c["price_max"], c["brands"]) == ("competitor", 500.0, 900.0, ["Kestova"])
    assert (d["screen_in"], d["cpu_tier"], d["storage_min"], d["price_min"], d["price_max"]) == (14.0, 5.0, 512.0, 525.0, 875.0)
    assert (e["question_type"], e["segments"], e["brands"], e["price_min"], e["discrete_gpu"]) == ("product_lookup", [], [], None, False)


def test_phrases_and_sides(spark):
    a, b, c = _asked(spark, "How does the Acer Helios compare with the ASUS Strix?", "Tell me about the Kestova Yarteta 15 for school, or others", "compare it and one")
    assert a["sides"] == ["the Acer Helios", "the ASUS Strix"] and a["phrases"] == ["Acer Helios", "ASUS Strix"]
    assert b["phrases"][0] == "Kestova Yarteta 15" and not any(p in "Kestova Yarteta 15" for p in b["phrases"][1:])
    assert c["phrases"] == [] and c["sides"] == []


def _shop(spark):
    data = [(f"p{i}", "Kestova" if i % 2 else "Norvik", f"{'Kestova Yarteta' if i % 2 else 'Norvik Pelbrint'} laptop {i}", "gaming" if i < 8 else "budget", None if i == 3 else 300.0 + 10 * i, float(i), i) for i in range(12)]
    df = spark.createDataFrame(data, "parent_asin string, brand string, title string, segment string, price double, weight_lb double, rating_number long")
    for c, v in (("gpu_model", "Unknown"), ("cpu_family", "Unknown"), ("os_family", "Windows"), ("is_discrete_gpu", True), ("has_sentiment", False)):
        df = df.withColumn(c, F.lit(v))
    return df.withColumns({c: F.lit(8.0) for c in ("ram_gb", "storage_gb", "screen_in", "cpu_tier", "average_rating")})


def _searched(spark, df, *questions, k=6):
    q = spark.createDataFrame([(i, x) for i, x in enumerate(questions)], "question_id int, question string")
    asked = retrieval.read(q, spark.createDataFrame([("Kestova",), ("Norvik",)], "brand string"))
    vectors = spark.createDataFrame([(f"p{i}", [1.0, float(i % 2)]) for i in range(10)], "parent_asin string, embedding array<double>")
    found = retrieval.index(df, "parent_asin", retrieval.indexed_text())
    return asked, retrieval.scored(df, asked, retrieval.scores(found, vectors, q))


def test_search_relaxes_sorts_and_spreads(spark):
    df = _shop(spark)
    asked, rows_ = _searched(spark, df, "gaming laptop under $100", "the lightest laptop", "Kestova Yarteta", "")
    got = retrieval.search(rows_, retrieval.relaxation_ladder(df, asked, 3), 3).orderBy("question_id", "rank").collect()
    by = {i: [r for r in got if r["question_id"] == i] for i in range(4)}
    assert {r["relaxation"] for r in by[0]} == {"price constraint dropped"} and {r["segment"] for r in by[0]} == {"gaming"} and {r["n_candidates"] for r in by[0]} == {8}
    assert [r["parent_asin"] for r in by[1]] == ["p0", "p1", "p2"] and by[1][0]["ordering"] == "sorted by lowest weight"
    assert {r["brand"] for r in by[2]} == {"Kestova"} and len(by[2]) == 3  # the cap of two a brand gives way
    assert len(by[3]) == 3 and by[3][0]["score"] > 0  # nothing known: priors alone
    assert retrieval.search(rows_.where("false"), retrieval.relaxation_ladder(df.where("false"), asked, 3), 3).count() == 0


def test_resolution_and_comparison(spark):
    df = _shop(spark)
    asked, rows_ = _searched(spark, df, "How does the Kestova Yarteta compare with the Norvik Pelbrint?")
    sides = retrieval.side_questions(asked)
    assert [(r["question_id"], r["ask"]["brands"]) for r in sides.orderBy("question_id").collect()] == [("0/0", ["Kestova"]), ("0/1", ["Norvik"])]
    best = retrieval.resolve(rows_)
    assert best.count() == 1 and retrieval.resolve(rows_, floor=5.0).count() == 0
    first = spark.createDataFrame([("0/0", "p1", 0.9), ("0/1", "p1", 0.8)], "question_id string, parent_asin string, score double")
    fill = spark.createDataFrame([(0, 1, "p1", 0.9), (0, 2, "p2", 0.5), (0, 3, "p4", 0.4)], "question_id int, rank int, parent_asin string, score double")
    assert rows(retrieval.comparison(first, fill).select("turn", "parent_asin")) == [(1, "p1"), (2, "p2")]


def test_evidence_takes_asked_aspects_first_and_two_of_a_side(spark):
    data = [("p", a, s, r, i, f"{a} {s} {i}", float(v)) for i, (a, s, r, v) in enumerate([("battery", "praise", 1, 1), ("battery", "complaint", 1, 1), ("display", "praise", 1, 9), ("display", "praise", 2, 8), ("display", "praise", 3, 7), ("value", "complaint", 1, 5)])]
    df = spark.createDataFrame(data, "parent_asin string, aspect string, side string, rank int, review_id int, snip string, score double")
    got = [(r["evidence_rank"], r["review_id"]) for r in retrieval.review_evidence(df, ["battery"], 9).orderBy("evidence_rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 5)]


def test_audit(spark):
    from cataloom.plans.retrieval import audit_answers

    got = {r["answer_id"]: r for r in audit_answers(spark, "").collect()}
    assert got[1]["misattributed"] == 1 and got[1]["unverified"] == 0 and not got[1]["grounded"]
    assert got[2]["unsupported"] == "S9" and got[2]["unverified"] == 1 and got[2]["uncited"] == 1
    assert got[3]["sentences"] == 0 and got[3]["citation_rate"] == 0.0


def test_budget_stops_at_the_first_block_that_does_not_fit():
    products = [{"parent_asin": str(i), "text": "x" * 40} for i in range(3)]
    reviews = [{"parent_asin": "0", "text": "y" * 30}]
    got = audit.assemble(products, reviews, ["s"], budget=100)
    assert [e.marker for e in got] == ["P1", "R1"]
    text = audit.Extractive().chat(audit.prompt("q", "recommend", got))
    assert "[P1]" in text


# ---------------------------------------------------------------- sources, text, models, streaming


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"parent_asin": "x", "title": "t", "categories": ["Laptops"]}\n\nnot json\n{"parent_asin": "y", "categories": ["Laptops", "Laptop Accessories"]}\n')
    items = io.read_items(spark, str(tmp_path))
    kept = items.where(io.in_category(F.col("categories")))
    assert [r["parent_asin"] for r in kept.collect()] == ["x"]


def test_strict_json(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), [1.0, float("nan")], {"a": float("nan")}, datetime.datetime(2024, 1, 2), bytearray(b"hi"))], "a double, b float, c array<double>, d map<string,double>, e timestamp, f binary")
    got = json.loads(io.to_json(df).first()[0], parse_constant=lambda c: pytest.fail(c))
    assert got == {"a": None, "b": None, "c": [1.0, None], "d": {"a": None}, "e": "2024-01-02T00:00:00", "f": "hi"}


def test_clean_text(spark):
    df = spark.createDataFrame([("a &amp;amp; b<br/>c <b>d</b>  e\x01f",), (None,), ("caf&eacute; &lt;x&gt;",)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["a & b c d e f", "", "café"]


def test_ridge_equals_normal_equations(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    m = models.ridge(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), 1.0)
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-9)


def test_ridge_of_more_features_than_the_normal_equations_take(spark):
    levels = models.MOST_FEATURES + 400
    rng = np.random.default_rng(1)
    rows = [(float(i % levels), float(rng.normal()), float(i % 7 + i % 3 + rng.normal() * 0.1)) for i in range(2 * levels)]
    df = spark.createDataFrame(rows, "level double, x double, y double")
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    coded = OneHotEncoder(inputCol="level", outputCol="h", dropLast=False).fit(df).transform(df)
    features = VectorAssembler(inputCols=["x", "h"], outputCol="features").transform(coded)
    m = models.ridge(features, 1.0)
    # the levels' weights follow from the others: two rows each
    a, x, y = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
    at = a.astype(int)
    w = m.coefficients
    left = y - m.intercept - x * w[0]
    assert np.allclose(w[1:], np.bincount(at, left, levels) / 3, atol=1e-8)
    assert abs(x @ (left - w[1:][at]) - w[0]) < 1e-6 and abs((left - w[1:][at]).sum()) < 1e-6
    got = np.array([r[0] for r in m.transform(features).select("prediction").collect()])
    assert np.allclose(np.sort(got), np.sort(m.intercept + x * w[0] + w[1:][at]), atol=1e-9)


def test_variants_collapse(spark):
    df = spark.createDataFrame([("a", 5, None), ("b", 9, 1.0), ("c", 9, 1.0)], "parent_asin string, rating_number long, ram_gb double")
    for c, v in (("title", "Foo Blade X"), ("brand", "Foo"), ("cpu_family", "u"), ("gpu_model", "u"), ("os_family", "u")):
        df = df.withColumn(c, F.lit(v))
    for c in ("cpu_ghz", "storage_gb", "screen_in", "weight_lb", "price", "cpu_tier"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumn("is_discrete_gpu", F.lit(False)).withColumn("is_renewed", F.lit(False))
    kept, moved = ingest.collapse_variants(df)
    assert [(r["parent_asin"], r["n_variants"]) for r in kept.collect()] == [("b", 3)]
    assert rows(moved) == [("a", "b"), ("c", "b")]


def test_stream_equals_batch(spark, data):
    from cataloom.plans import catalogue

    got = catalogue.streaming_semi_join(spark, data).select("review_id", "parent_asin")
    raw = spark.read.parquet(f"{data}/reviews.parquet").where("review_id IS NOT NULL")
    want = io.keep_with_key(raw, catalog.products(spark, data)).select("review_id", "parent_asin")
    assert rows(got) == rows(want)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_display_helpers(spark):
    from cataloom.functions.text import shortened

    df = spark.createDataFrame([("some  long words here", 9.0)], "t string, v double")
    r = df.select(shortened(F.col("t"), 12), stats.marker_size(F.col("v"), F.lit(0.0), F.lit(9.0)), stats.marker_size(F.col("v"), F.lit(9.0), F.lit(9.0)), search.ruler(F.col("v"), F.lit(10.0), F.lit(20.0))).first()
    assert tuple(r) == ("some long…", 30.0, 6.0, 0.0)


def test_union_first(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(retrieval.union_first([a, b], "k")) == [(1, "x"), (2, "z")]


def test_notes(spark):
    df = spark.createDataFrame([("no constraints", "sorted by lowest price", True), ("all constraints", "relevance", False)], "r string, o string, p boolean")
    got = [x[0] for x in df.select(retrieval.notes(F.col("r"), F.col("o"), F.col("p"))).collect()]
    assert len(got[0]) == 3 and got[1] == []
