"""Evidence blocks, a context budget, a prompt, generators, and the audit of an answer against its evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_CHARS, MAX_PRODUCTS, MAX_PER_PRODUCT, MAX_REVIEWS, MAX_STATS = 11_000, 8, 3, 12, 8
MARKER = r"\[([PRS]\d+)\]"
MONEY = r"\$\s?-?([\d,]+(?:\.\d{1,2})?)"
SPEC = r"(?i)\b(\d{1,4}(?:\.\d)?)\s?(gb|tb|ghz|inch|\"|hz|lb)\b"
PERCENT = r"\b(\d{1,3}(?:\.\d)?)\s?%"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\[])|\n+"


@dataclass(frozen=True)
class Evidence:
    marker: str
    kind: str
    text: str
    product_marker: str | None = None


def product_block() -> Column:
    """A listing as one citable text; what is missing says unknown."""
    known = lambda c, unit="": F.coalesce(F.concat(F.col(c).cast("string"), F.lit(unit)), F.lit("unknown"))
    return F.concat_ws(
        " | ", F.coalesce("title", F.lit("unknown")), F.concat(F.lit("brand "), F.col("brand")), F.concat(F.lit("segment "), F.col("segment")),
        F.coalesce(F.concat(F.lit("price $"), F.format_number("price", 2)), F.lit("price unknown")), F.concat(F.lit("RAM "), known("ram_gb", " GB")),
        F.concat(F.lit("storage "), known("storage_gb", " GB")), F.concat(F.lit("screen "), known("screen_in", " inch")), F.concat(F.lit("weight "), known("weight_lb", " lb")),
        F.concat(F.lit("GPU "), F.col("gpu_model")), F.concat(F.lit("rating "), known("average_rating")),
    )


def assemble(products: Sequence[dict], reviews: Sequence[dict], stats: Sequence[str], budget: int = MAX_CHARS) -> list[Evidence]:
    """Blocks in order of use: each product, its reviews, then statistics; filling stops at the first block that doesn't fit.

    The inputs are the few rows that retrieval returned, at most 8 products, 12 reviews and 8 lines.
    """
    out: list[Evidence] = []
    used = n_reviews = 0

    def add(e: Evidence) -> bool:
        nonlocal used
        if used + len(e.text) > budget:
            return False
        out.append(e)
        used += len(e.text)
        return True

    for i, p in enumerate(products[:MAX_PRODUCTS], 1):
        if not add(Evidence(f"P{i}", "product", p["text"])):
            return out
        for r in [r for r in reviews if r["parent_asin"] == p["parent_asin"]][:MAX_PER_PRODUCT]:
            if n_reviews == MAX_REVIEWS:
                break
            n_reviews += 1
            if not add(Evidence(f"R{n_reviews}", "review", r["text"], f"P{i}")):
                return out
    for i, line in enumerate(stats[:MAX_STATS], 1):
        if not add(Evidence(f"S{i}", "statistic", line)):
            break
    return out


HINTS = {
    "spec_compare": "Set the sides next to each other, property by property, and say where a value is unknown.",
    "recommend": "Name at most three listings, each with the fact that decides for it.",
    "competitor": "Say what the rivals share with the listing asked about and where they differ.",
    "market": "Give figures with the number of priced listings behind them.",
    "product_lookup": "Answer for the listing asked about and nothing else.",
}


def prompt(question: str, kind: str, evidence: Sequence[Evidence]) -> list[dict[str, str]]:
    """Messages for a generator."""
    rules = "Use only the numbered sources. Put a source's mark, such as [P1], after each statement. Copy numbers as they stand. Say so when the sources don't answer. "
    sources = "\n".join(f"[{e.marker}] {e.text}" for e in evidence)
    return [{"role": "system", "content": rules + HINTS[kind]}, {"role": "user", "content": f"Sources:\n{sources}\n\nQuestion: {question}"}]


class Generator(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class Extractive:
    """A deterministic generator: the first sources, quoted with their marks."""

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def chat(self, messages: list[dict[str, str]]) -> str:
        lines = [x for x in messages[-1]["content"].split("\n") if x.startswith("[")][: self.sentences]
        return "\n".join(f"{x.split('] ', 1)[1].split(' | ')[0]} {x.split(']', 1)[0]}]." for x in lines) or "The sources don't answer this."


# ---------------------------------------------------------------- audit


def numbers(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, value, unit>> of the numbers of a text."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    if kind == "spec":
        unit = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.zip_with(value, unit, lambda v, u: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(v, ",", "").try_cast("double").alias("value"), F.when(u == '"', "inch").otherwise(F.lower(u)).alias("unit")))
    return F.transform(value, lambda v: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(v, ",", "").try_cast("double").alias("value"), F.lit("").alias("unit")))


def all_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    c = F.col(text)
    return df.select(key, F.explode(F.concat(numbers(c, MONEY, "money"), numbers(c, SPEC, "spec"), numbers(c, PERCENT, "percent"))).alias("x")).select(key, "x.*").where("value IS NOT NULL").distinct()


def audit(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per answer: marks used and unsupported, sentences without a mark, numbers without a source, misattributed reviews, citation rate, grounded.

    answers: (answer_id, answer); evidence: (answer_id, marker, kind, text, product_marker). Every check is an equi-join on the answer.
    """
    marks = F.array_distinct(F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)))
    used = answers.select("answer_id", F.explode(marks).alias("marker"))
    known = used.join(evidence.select("answer_id", "marker"), ["answer_id", "marker"], "left_semi").groupBy("answer_id").agg(F.count(F.lit(1)).alias("citations"))
    invented = used.join(evidence.select("answer_id", "marker"), ["answer_id", "marker"], "left_anti").groupBy("answer_id").agg(F.sort_array(F.collect_set("marker")).alias("unsupported"))
    parts = F.filter(F.transform(F.split("answer", SENTENCE_END), lambda s: F.btrim(s, F.lit(" -*•\t"))), lambda s: F.length(s) > 25)
    sentences = answers.select("answer_id", F.posexplode(parts).alias("pos", "sentence"))
    cited = sentences.groupBy("answer_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(~F.col("sentence").rlike(MARKER)).alias("uncited"))
    said = all_numbers(answers, "answer_id", "answer")
    there = all_numbers(evidence, "answer_id", "text").select("answer_id", "kind", "unit", F.col("value").alias("source"))
    near = F.when(F.col("kind") == "money", F.abs(F.col("value") - F.col("source")) <= F.greatest(F.lit(1.0), 0.01 * F.col("source"))).when(F.col("kind") == "percent", F.abs(F.col("value") - F.col("source")) <= 1.0).otherwise(F.col("value") == F.col("source"))
    proven = said.join(there, ["answer_id", "kind", "unit"]).where(near).select("answer_id", "kind", "unit", "value").distinct()
    unproven = said.join(proven, ["answer_id", "kind", "unit", "value"], "left_anti").groupBy("answer_id").agg(F.count(F.lit(1)).alias("unverified"))
    named = sentences.select("answer_id", "pos", F.regexp_extract_all("sentence", F.lit(MARKER), F.lit(1)).alias("marks"))
    products = named.withColumn("products", F.filter("marks", lambda m: m.startswith("P"))).where(F.size("products") > 0)
    owners = evidence.where("kind = 'review' AND product_marker IS NOT NULL").select("answer_id", F.col("marker").alias("review"), "product_marker")
    wrong = products.select("answer_id", "products", F.explode("marks").alias("review")).join(owners, ["answer_id", "review"]).where(~F.array_contains("products", F.col("product_marker"))).groupBy("answer_id").agg(F.count(F.lit(1)).alias("misattributed"))
    out = answers.select("answer_id")
    for part in (known, invented, cited, unproven, wrong):
        out = out.join(part, "answer_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("citations", "sentences", "uncited", "unverified", "misattributed")]
    rate = F.coalesce(F.try_divide(F.col("sentences") - F.col("uncited"), F.col("sentences")), F.lit(0.0))
    return out.select("answer_id", *zero, F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported")).withColumn("citation_rate", F.round(rate, 6)).withColumn(
        "grounded", (F.size("unsupported") == 0) & (F.col("misattributed") == 0) & (F.col("unverified") == 0) & (F.col("citations") > 0)
    )
