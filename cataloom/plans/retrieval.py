"""Question, retrieval and audit queries and their SQL. Questions are those that the documents put, and a few of our own, answered in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom import catalog
from cataloom.functions import vocabulary as V
from cataloom.operators import audit, matching, pricing, retrieval, sentiment
from cataloom.plans.opinions import ORACLES as OPINIONS
from cataloom.plans.pricing import CAT, SENT, marked
from cataloom.session import staged, table

QUESTIONS = (
    (1, "How does the Kestova Yarteta compare with the Norvik Pelbrint?"),
    (2, "Which laptop should I buy for travel under $900 with 16 GB RAM?"),
    (3, "What are rivals of the Brindex Linrira?"),
    (4, "What is the median price of gaming laptops with a graphics card?"),
    (5, "Aurelon Sargal battery life and keyboard"),
    (6, "cheapest business laptop with 32 GB of memory and 1 TB between $500 and 1.5"),
    (7, "Is there a 15.6 inch i7 notebook around $1,200 on Windows 11?"),
    (8, "Recommend the lightest Kestova laptop under 2k"),
    (9, "Kestova Yarteta"),
    (10, "compare Lumatek Mesgant or Calvora Quinmawick for office work"),
    (11, "overall price range of chromebook and budget brands"),
)
KINDS = {"looked_up": ("recommend", "product_lookup"), "market": ("market",), "compared": ("spec_compare",), "rivalled": ("competitor",)}


def _own(spark):
    return spark.createDataFrame(list(QUESTIONS), "question_id int, question string")


def _put(spark, d):
    """(question_id, question): every question that a document puts ("Q: ..." at the start of a line), and our own."""
    asked = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^Q: ([^\r\n]+)"), F.lit(1))).alias("n", "question")
    documents = table(spark, d, "documents").select("doc_id", asked).select(F.concat_ws("/", F.lit("d"), "doc_id", "n").alias("question_id"), "question")
    return documents.unionByName(_own(spark).withColumn("question_id", F.col("question_id").cast("string")))


def _brands(spark, d):
    return table(spark, d, "canonical_values").where("field_name = 'brand'").select(F.col("canonical_value").alias("brand"))


def _asked(spark, d, kind=None):
    asked = staged(retrieval.read(_own(spark), _brands(spark, d)), "asked")
    return asked if kind is None else asked.where(F.col("ask.question_type").isin(*KINDS[kind]))


_PLAIN = ("question_type", "os_family", "price_min", "price_max", "ram_min", "storage_min", "screen_in", "cpu_tier", "discrete_gpu", "superlative", "wants_reviews", "wants_price_stats")
_LISTS = ("segments", "aspects", "asins")


def question_slots(spark, d):
    s = retrieval.question_slots(_put(spark, d), "question")
    return s.select("question_id", *_PLAIN, *[F.array_join(c, ",").alias(c) for c in _LISTS])


def question_brands(spark, d):
    return retrieval.question_brands(_put(spark, d), "question", "question_id", _brands(spark, d)).select("question_id", F.array_join("brands", "|").alias("brands"))


def question_phrases(spark, d):
    """Phrases that may name a product, and the sides of comparisons."""
    asked = retrieval.read(_put(spark, d), _brands(spark, d))
    return asked.select("question_id", F.array_join("ask.phrases", "|").alias("phrases"), F.array_join("ask.sides", "|").alias("sides"))


def _index(spark, d):
    found = retrieval.index(catalog.products(spark, d), "parent_asin", retrieval.indexed_text())
    return retrieval.Index(staged(found.postings, "postings"), found.vocabulary)


def tfidf_index(spark, d):
    """The whole index: weights of the terms of every listing's brand, title, segment, graphics and processor."""
    found = retrieval.index(catalog.products(spark, d), "parent_asin", retrieval.indexed_text())
    return found.postings.select("parent_asin", "term", F.round("weight", 5).alias("weight"))


def lexical_search(spark, d):
    return retrieval.lexical_scores(_index(spark, d), "parent_asin", _own(spark)).select("question_id", "parent_asin", F.round("lexical", 5).alias("lexical"))


def dense_search(spark, d):
    """Cosines of every stored vector with the mean vector of each question's lexically nearest listings."""
    lexical, vectors = retrieval.lexical_scores(_index(spark, d), "parent_asin", _own(spark)), catalog.vectors(spark, d)
    return retrieval.dense_scores(vectors, retrieval.feedback_vectors(lexical, vectors)).select("question_id", "parent_asin", F.round("dense", 5).alias("dense"))


def _rows(spark, d, asked):
    cat = marked(spark, d)
    return cat, retrieval.scored(cat, asked, retrieval.scores(_index(spark, d), catalog.vectors(spark, d), asked))


def hybrid_search(spark, d):
    """Six listings for each question that asks for advice or looks a listing up; superlatives included."""
    asked = _asked(spark, d, "looked_up")
    cat, rows = _rows(spark, d, asked)
    return retrieval.search(rows, retrieval.relaxation_ladder(cat, asked), 6).drop("segment", "price")


def superlative_search(spark, d):
    asked = _asked(spark, d, "looked_up").where("ask.superlative IS NOT NULL")
    cat, rows = _rows(spark, d, asked)
    return retrieval.search(rows, retrieval.relaxation_ladder(cat, asked), 10).select("question_id", "rank", "parent_asin", "price", "ordering")


def relaxation_ladder(spark, d):
    return retrieval.relaxation_ladder(marked(spark, d), _asked(spark, d))


def entity_resolution(spark, d):
    """The listing that each question's brands and words name best."""
    return retrieval.resolve(_rows(spark, d, _asked(spark, d))[1]).select("question_id", "parent_asin", "brand", "score")


def priors(spark, d):
    return retrieval.priors(marked(spark, d)).select("parent_asin", F.round("prior", 6).alias("prior"))


def market_examples(spark, d):
    """Two listings of each segment for market questions."""
    return retrieval.market_examples(_rows(spark, d, _asked(spark, d, "market"))[1])


def comparison_retrieval(spark, d):
    """A listing for each side of each comparison."""
    asked = _asked(spark, d, "compared")
    sides = staged(retrieval.side_questions(asked), "sides")
    cat, rows = _rows(spark, d, asked)
    return retrieval.comparison(retrieval.resolve(_rows(spark, d, sides)[1]), retrieval.search(rows, retrieval.relaxation_ladder(cat, asked, 4), 4))


def _features(spark, d):
    return staged(matching.features(catalog.products(spark, d), catalog.vectors(spark, d)), "rival-features")


def rival_retrieval(spark, d):
    """The listing that each competitor question names, and its rivals."""
    feats = _features(spark, d)
    rows = _rows(spark, d, _asked(spark, d, "rivalled"))[1].join(feats.select("parent_asin"), "parent_asin", "left_semi")
    return retrieval.rivals(retrieval.resolve(rows), feats)


def retrieval_plans(spark, d):
    """Every question by the plan of its type: listings, sides, rivals or examples, with caveats."""
    out = retrieval.retrieve(marked(spark, d), _features(spark, d), _index(spark, d), catalog.vectors(spark, d), _asked(spark, d))
    return out.withColumn("notes", F.array_join("notes", " "))


def review_evidence(spark, d):
    """Up to three snippets of every product, asked for battery first."""
    r = staged(catalog.reviews(spark, d).where("parent_asin IS NOT NULL"), "evidence-reviews")
    folded = staged(sentiment.review_aspects(sentiment.mentions(r)), "evidence-aspects")
    return retrieval.review_evidence(sentiment.top_snippets(folded, r), ["battery"]).select("parent_asin", "evidence_rank", "aspect", "side", "review_id")


def market_stats(spark, d):
    cat = catalog.products(spark, d)
    return retrieval.market_stats(pricing.group_price_table(cat, "segment"), pricing.discrete_premium(cat), pricing.brand_price_table(cat, 25, 40), _asked(spark, d))


EVIDENCE = (
    (1, "P1", "product", "Kestova Yarteta | price $1,499.99 | RAM 16 GB | screen 15.6 inch", None),
    (1, "R1", "review", "Battery lasts 9 hours and 85% of it is left after lunch.", "P1"),
    (1, "P2", "product", "Norvik Pelbrint | price $999.00 | RAM 8 GB", None),
    (2, "S1", "statistic", "Segment 'gaming': median $1,370, priced 30% of 400", None),
    (3, "P1", "product", "Aurelon Sargal | price $700.00", None),
)
ANSWERS = (
    (1, "The Yarteta costs $1,500 and has 16 GB [P1]. Its battery is praised by owners [R1]. The Pelbrint, as owners say, costs $999 and lasts long [P2][R1]."),
    (2, "Gaming machines have a median of $1,370 [S1]. About 30% of them are priced, which is not much. They weigh 6 lb on average [S9]."),
    (3, ""),
)


def audit_answers(spark, d):
    """The audit over fixed answers and evidence."""
    a = spark.createDataFrame(list(ANSWERS), "answer_id int, answer string")
    e = spark.createDataFrame(list(EVIDENCE), "answer_id int, marker string, kind string, text string, product_marker string")
    out = audit.audit(a, e)
    return out.select(*[c for c in out.columns if c != "unsupported"], F.array_join("unsupported", ",").alias("unsupported"))


def product_blocks(spark, d):
    return catalog.products(spark, d).select("parent_asin", audit.product_block().alias("block"))


QUERIES = {
    f.__name__: f
    for f in (
        question_slots, question_brands, question_phrases, tfidf_index, lexical_search, dense_search, hybrid_search, superlative_search, relaxation_ladder, entity_resolution, priors, market_examples, comparison_retrieval,
        rival_retrieval, retrieval_plans, review_evidence, market_stats, audit_answers, product_blocks,
    )
}


# ---------------------------------------------------------------- the same in SQL


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _has(pattern: str) -> str:
    return f"regexp_matches(question, {_text('(?i)' + pattern)})"


def _pick(pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract(question, {_text('(?i)' + pattern)}, {n}), '')"


def _number(pattern: str, n: int = 1) -> str:
    return f"TRY_CAST({_pick(pattern, n)} AS DOUBLE)"


def _usd(pattern: str, n: int = 1, k: int | None = None) -> str:
    v = f"TRY_CAST(replace({_pick(pattern, n)}, ',', '') AS DOUBLE)"
    thousand = f"{_pick(pattern, k)} IS NOT NULL OR {v} <= 15" if k else f"{v} <= 15"
    return f"CASE WHEN {thousand} THEN {v} * 1000 ELSE {v} END"


def _hints(hints) -> str:
    return "(" + " OR ".join(f"contains(lower(question), {_text(h)})" for h in hints) + ")"


def _list(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_text(v)} END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"


def _case(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {_text(v)}" for c, v in pairs) + " END"


_KIND = f"""CASE WHEN {_has(V.ASKS_COMPARISON)} THEN 'spec_compare' WHEN {_has(V.ASKS_RIVALS)} THEN 'competitor' WHEN {_has(V.ASKS_MARKET)} AND NOT {_has(V.ASKS_ADVICE)} THEN 'market'
  WHEN {_has(V.ASKS_ADVICE)} THEN 'recommend' ELSE 'product_lookup' END"""
_OWN = "own(question_id, question) AS (VALUES " + ", ".join(f"({i}, {_text(q)})" for i, q in QUESTIONS) + ")"
_PUT = f"""{_OWN}, put AS (SELECT 'd/' || doc_id || '/' || (n - 1) AS question_id, question FROM (SELECT doc_id, unnest(qs) AS question, generate_subscripts(qs, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^Q: ([^\\r\\n]+)', 1) AS qs FROM documents))
  UNION ALL SELECT CAST(question_id AS VARCHAR), question FROM own)"""


def _slots(source: str) -> str:
    from cataloom.operators.sentiment import cue_pattern

    return f"""slot0 AS (SELECT *, {_KIND} AS question_type, {_list((_hints(h), s) for s, h in V.SEGMENT_HINTS.items())} AS segments, {_case((_hints(h), o) for o, h in V.OS_HINTS.items())} AS os_family,
    {_usd(V.PRICE_BETWEEN, 1)} AS pa, {_usd(V.PRICE_BETWEEN, 2)} AS pb, {_usd(V.PRICE_MAX, 1, 2)} AS ph, {_usd(V.PRICE_MIN, 1, 2)} AS pl, {_usd(V.PRICE_AROUND, 1, 2)} AS pm,
    {_number(V.ASKED_RAM)} AS ram_min, coalesce({_number(V.ASKED_STORAGE_GB)}, {_number(V.ASKED_STORAGE_TB)} * 1024) AS storage_min, {_number(V.ASKED_SCREEN)} AS screen_in,
    coalesce({_number(V.ASKED_TIER, 1)}, {_number(V.ASKED_TIER, 2)}) AS cpu_tier, regexp_extract_all(question, '{V.ASKED_ASIN}') AS asins, {_case((_has(p), n) for p, *_, n in V.SUPERLATIVES)} AS superlative,
    {_list((f"regexp_matches(question, {_text(cue_pattern(c))})", a) for a, c in V.ASPECTS.items())} AS aspects, {_has(V.ASKED_DISCRETE)} AS names_gpu, {_hints(V.PRICE_WORDS)} AS names_price FROM {source}),
  slot1 AS (SELECT *, coalesce(least(pa, pb), pl, CASE WHEN ph IS NULL AND pl IS NULL THEN 0.75 * pm END) AS price_min, coalesce(greatest(pa, pb), ph, CASE WHEN ph IS NULL AND pl IS NULL THEN 1.25 * pm END) AS price_max,
    names_gpu OR list_contains(segments, 'gaming') AS discrete_gpu FROM slot0),
  slot AS (SELECT *, question_type <> 'market' OR len(aspects) > 0 AS wants_reviews, question_type = 'market' OR price_min IS NOT NULL OR price_max IS NOT NULL OR names_price AS wants_price_stats FROM slot1)"""


_WORDS = "' ' || regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}&]+', ' ', 'g') || ' '"
_NAMED = """named AS (SELECT question_id, list(brand ORDER BY length(brand) DESC, brand) AS brands FROM (SELECT DISTINCT question_id, canonical_value AS brand FROM {0}, canonical_values
  WHERE field_name = 'brand' AND length(canonical_value) > 1 AND contains(""" + _WORDS.format("question") + ", " + _WORDS.format("canonical_value") + """)) GROUP BY question_id)"""
_ASK = f"{_OWN}, {_slots('own')}, {_NAMED.replace('{0}', 'own')}, ask AS (SELECT s.*, coalesce(n.brands, []) AS brands FROM slot s LEFT JOIN named n USING (question_id))"
_INDEX = f"""w AS (SELECT parent_asin, regexp_extract_all(translate(lower({" || ' ' || ".join(f"coalesce({c}, '')" for c in retrieval.INDEXED)}), '{retrieval._ACCENTS[0]}', '{retrieval._ACCENTS[1]}'), '[a-z0-9_]{{2,}}') AS ws FROM cat),
  g AS (SELECT parent_asin, unnest(ws) AS term FROM w UNION ALL SELECT parent_asin, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
  tf AS (SELECT parent_asin, term, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), df AS (SELECT term, ln((1 + (SELECT count(*) FROM cat)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
  raw AS (SELECT parent_asin, term, tf * idf AS w FROM tf JOIN df USING (term)), idx AS MATERIALIZED (SELECT parent_asin, term, w / sqrt(sum(w * w) OVER (PARTITION BY parent_asin)) AS weight FROM raw)"""


def _lexical(source: str, tag: str = "") -> str:
    return f"""qw{tag} AS (SELECT question_id, regexp_extract_all(translate(lower(question), '{retrieval._ACCENTS[0]}', '{retrieval._ACCENTS[1]}'), '[a-z0-9_]{{2,}}') AS ws FROM {source}),
  qg{tag} AS (SELECT question_id, unnest(ws) AS term FROM qw{tag} UNION ALL SELECT question_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM qw{tag}),
  qt{tag} AS (SELECT question_id, term, (1 + ln(count(*))) * any_value(idf) AS q FROM qg{tag} JOIN df USING (term) GROUP BY question_id, term),
  qn{tag} AS (SELECT question_id, term, q / sqrt(sum(q * q) OVER (PARTITION BY question_id)) AS q FROM qt{tag}),
  lex{tag} AS MATERIALIZED (SELECT question_id, parent_asin, sum(weight * q) AS lexical FROM idx JOIN qn{tag} USING (term) GROUP BY ALL)"""


def _dense(tag: str = "") -> str:
    return f"""near{tag} AS (SELECT question_id, parent_asin FROM lex{tag} JOIN vec USING (parent_asin) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 8) DESC, parent_asin) <= 5),
  mean{tag} AS (SELECT question_id, list(x ORDER BY i) AS m FROM (SELECT question_id, i, avg(x) AS x FROM (SELECT question_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM near{tag} JOIN uni USING (parent_asin)) GROUP BY ALL) GROUP BY question_id),
  den{tag} AS (SELECT question_id, parent_asin, list_cosine_similarity(e, m) AS dense FROM uni, mean{tag})"""


_UNIT = f"{catalog.VECTORS_SQL}, uni AS (SELECT parent_asin, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM vec)"
_PRIOR = f"""{SENT}, mk AS (SELECT c.*, s.parent_asin IS NOT NULL AS has_sentiment FROM cat c LEFT JOIN sent s USING (parent_asin)),
  pri AS (SELECT *, 0.07 * coalesce(ln(1 + rating_number) / nullif((SELECT max(ln(1 + rating_number)) FROM cat), 0), 0) + 0.03 * CASE WHEN rating_number >= 20 THEN greatest(0, least(1, (coalesce(average_rating, 3) - 3) / 2)) ELSE 0 END + 0.06 * CAST(has_sentiment AS INT) AS prior FROM mk)"""


def _scored(ask: str, tag: str = "") -> str:
    return f"""{_lexical(ask, tag)}, {_dense(tag)}, sc{tag} AS MATERIALIZED (SELECT p.*, a.question_id, round(0.62 * coalesce(dense, lexical, 0) + (1 - 0.62) * coalesce(lexical, 0) + prior, 6) AS score
    FROM pri p CROSS JOIN {ask} a LEFT JOIN lex{tag} USING (question_id, parent_asin) LEFT JOIN den{tag} USING (question_id, parent_asin))"""


def _constraint(price: bool) -> str:
    out = """(len(a.brands) = 0 OR list_contains(list_transform(a.brands, lambda b: lower(b)), lower(c.brand))) AND (len(a.segments) = 0 OR list_contains(a.segments, c.segment))
      AND (a.os_family IS NULL OR len(a.segments) > 1 OR c.os_family = a.os_family) AND (a.screen_in IS NULL OR coalesce(abs(c.screen_in - a.screen_in) <= 1, false))
      AND (NOT (a.discrete_gpu AND a.question_type IN ('recommend', 'product_lookup')) OR c.is_discrete_gpu) AND (a.ram_min IS NULL OR coalesce(c.ram_gb >= a.ram_min, false))
      AND (a.storage_min IS NULL OR coalesce(c.storage_gb >= a.storage_min, false)) AND (a.cpu_tier IS NULL OR coalesce(c.cpu_tier >= a.cpu_tier, false))"""
    if price:
        out += " AND (a.price_max IS NULL OR coalesce(c.price <= a.price_max, false)) AND (a.price_min IS NULL OR coalesce(c.price >= a.price_min, false))"
    return f"({out})"


def _ladder(ask: str, need: int = 6) -> str:
    return f"""lad AS (SELECT question_id, s0, s1, s2, priced, CASE WHEN s0 >= {need} THEN 0 WHEN priced AND s1 >= {need} THEN 1 ELSE 2 END AS level FROM (
    SELECT a.question_id, count(*) FILTER ({_constraint(True)}) AS s0, count(*) FILTER ({_constraint(False)}) AS s1, count(*) AS s2, bool_or(a.price_min IS NOT NULL OR a.price_max IS NOT NULL) AS priced FROM cat c CROSS JOIN {ask} a GROUP BY a.question_id))"""


_KEY = "CASE a.superlative " + " ".join(f"WHEN {_text(n)} THEN {'' if up else '-'}c.{column}" for _, column, up, n in V.SUPERLATIVES) + " END"
_LABEL = "CASE level WHEN 0 THEN 'all constraints' WHEN 1 THEN 'price constraint dropped' ELSE 'no constraints' END"


def _search(ask: str, k: int) -> str:
    return f"""{_ladder(ask)}, kept0 AS (SELECT c.*, a.superlative, {_KEY} AS skey, level, s0, s1, s2 FROM sc c JOIN {ask} a USING (question_id) JOIN lad USING (question_id) WHERE level = 2 OR (level = 1 AND {_constraint(False)}) OR (level = 0 AND {_constraint(True)})),
    kept1 AS (SELECT *, superlative IS NOT NULL AND count(skey) OVER (PARTITION BY question_id) > 0 AS sorted FROM kept0), kept AS (SELECT * FROM kept1 WHERE NOT sorted OR skey IS NOT NULL),
    pool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN sorted THEN skey END, CASE WHEN NOT sorted THEN -score END, parent_asin) AS place FROM kept QUALIFY place <= {max(400, 40 * k)}),
    ov AS (SELECT *, row_number() OVER (PARTITION BY question_id, brand ORDER BY place) > 2 AS over FROM pool),
    res AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY over, place) AS INTEGER) AS rank, {_LABEL} AS relaxation, CASE WHEN sorted THEN 'sorted by ' || superlative ELSE 'relevance' END AS ordering,
      CASE level WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS n_candidates FROM ov QUALIFY rank <= {k})"""


def _of(kind: str, more: str = "") -> str:
    return f"asked AS (SELECT * FROM ask WHERE question_type IN ({', '.join(_text(k) for k in KINDS[kind])}) {more})"


_BASE = f"{CAT}, {_ASK}, {_INDEX}, {_UNIT}, {_PRIOR}"
_RESOLVE = """rs AS (SELECT c.question_id, c.parent_asin, c.brand, c.score FROM sc c JOIN {0} a USING (question_id) WHERE len(a.brands) = 0 OR list_contains(a.brands, c.brand)
  QUALIFY row_number() OVER (PARTITION BY c.question_id ORDER BY (len(a.segments) = 0 OR list_contains(a.segments, c.segment)) DESC, c.score DESC, c.parent_asin) = 1)"""
_SNIPPETS = OPINIONS["top_snippets"]
_BLOCK = """coalesce(title, 'unknown') || ' | brand ' || brand || ' | segment ' || segment || ' | ' || coalesce('price $' || format('{:,.2f}', price), 'price unknown') || ' | RAM ' || coalesce(CAST(ram_gb AS VARCHAR) || ' GB', 'unknown')
  || ' | storage ' || coalesce(CAST(storage_gb AS VARCHAR) || ' GB', 'unknown') || ' | screen ' || coalesce(CAST(screen_in AS VARCHAR) || ' inch', 'unknown') || ' | weight ' || coalesce(CAST(weight_lb AS VARCHAR) || ' lb', 'unknown')
  || ' | GPU ' || gpu_model || ' | rating ' || coalesce(CAST(average_rating AS VARCHAR), 'unknown')"""

from cataloom.plans.pricing import ORACLES as PRICES  # noqa: E402


def _stat(kind: str, name: str) -> str:
    usd = lambda c: f"coalesce('$' || format('{{:,.0f}}', {c}), 'unknown')"
    return f"'{kind} ' || chr(39) || {name} || chr(39) || ': median ' || {usd('median')} || ', middle half ' || {usd('p25')} || ' to ' || {usd('p75')} || '; priced ' || n || ' of ' || n_total || CASE WHEN reliable THEN '' ELSE ' (small sample)' END"


_STATS = f"""WITH ask AS ({CAT}, {_ASK} SELECT question_id, question, question_type, segments, brands, discrete_gpu FROM ask), seg AS ({PRICES["segment_price_table"]}), pre AS ({PRICES["discrete_premium"]}),
  bra AS ({PRICES["brand_price_table"].replace("LIMIT 20", "LIMIT 40").replace("HAVING count(*) >= 5", "HAVING count(*) >= 25")}),
  lines AS (SELECT question_id, 0 AS part, 0 AS size, segment AS name, {_stat("Segment", "segment")} AS line FROM seg, ask a WHERE len(a.segments) = 0 OR list_contains(a.segments, segment)
    UNION ALL SELECT question_id, 1, 0, segment, 'Premium for discrete graphics in ' || chr(39) || segment || chr(39) || ': $' || format('{{:,.0f}}', premium_usd) || ' over ' || n_discrete || ' and ' || n_integrated || ' priced listings' FROM pre, ask a
      WHERE (a.discrete_gpu OR {_hints(("gpu", "graphics"))}) AND (segment = 'ALL' OR list_contains(a.segments, segment)) AND premium_usd IS NOT NULL
    UNION ALL SELECT question_id, 2, -n_total, brand, {_stat("Brand", "brand")} FROM bra, ask a WHERE (len(a.brands) > 0 OR a.question_type = 'market') AND (len(a.brands) = 0 OR list_contains(a.brands, brand)))
  SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY part, size, name) AS INTEGER) AS position, line FROM lines QUALIFY position <= 8"""
_JOINED = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in _LISTS)

ORACLES = {
    "question_slots": f"WITH {_PUT}, {_slots('put')} SELECT question_id, {', '.join(_PLAIN)}, {_JOINED} FROM slot",
    "question_brands": f"WITH {_PUT}, {_NAMED.replace('{0}', 'put')} SELECT question_id, array_to_string(brands, '|') AS brands FROM named",
    "tfidf_index": f"{CAT}, {_INDEX} SELECT parent_asin, term, round(weight, 5) AS weight FROM idx",
    "lexical_search": f"{CAT}, {_OWN}, {_INDEX}, {_lexical('own')} SELECT question_id, parent_asin, round(lexical, 5) AS lexical FROM lex",
    "dense_search": f"{CAT}, {_OWN}, {_INDEX}, {_UNIT}, {_lexical('own')}, {_dense()} SELECT question_id, parent_asin, round(dense, 5) AS dense FROM den",
    "priors": f"{CAT}, {_PRIOR} SELECT parent_asin, round(prior, 6) AS prior FROM pri",
    "relaxation_ladder": f"""{CAT}, {_ASK}, {_ladder('ask')} SELECT question_id, 0 AS step, 'all constraints' AS label, s0 AS candidates, level = 0 AS chosen FROM lad UNION ALL
      SELECT question_id, 1, 'price constraint dropped', s1, level = 1 FROM lad WHERE priced UNION ALL SELECT question_id, 2, 'no constraints', s2, level = 2 FROM lad""",
    "hybrid_search": f"{_BASE}, {_of('looked_up')}, {_scored('asked')}, {_search('asked', 6)} SELECT question_id, rank, parent_asin, brand, score, relaxation, ordering, n_candidates FROM res",
    "superlative_search": f"{_BASE}, {_of('looked_up', 'AND superlative IS NOT NULL')}, {_scored('asked')}, {_search('asked', 10)} SELECT question_id, rank, parent_asin, price, ordering FROM res",
    "entity_resolution": f"{_BASE}, {_scored('ask')}, {_RESOLVE.replace('{0}', 'ask')} SELECT * FROM rs WHERE score >= 0.2",
    "market_examples": f"""{_BASE}, {_of('market')}, {_scored('asked')} SELECT c.question_id, c.segment, CAST(row_number() OVER (PARTITION BY c.question_id, c.segment ORDER BY c.score DESC, c.parent_asin) AS INTEGER) AS rank, c.parent_asin, c.score
      FROM sc c JOIN asked a USING (question_id) WHERE len(a.segments) = 0 OR list_contains(a.segments, c.segment) QUALIFY rank <= 2""",
    "review_evidence": f"""WITH sn AS ({_SNIPPETS}), t AS (SELECT *, row_number() OVER (PARTITION BY parent_asin, side ORDER BY score DESC, review_id, aspect) AS o FROM sn),
      u AS (SELECT *, CASE WHEN aspect = 'battery' AND rank = 1 THEN 1 WHEN o <= 2 THEN 1000 END AS turn, CASE WHEN side = 'praise' THEN 0 ELSE 1 END AS s FROM t),
      v AS (SELECT * FROM u WHERE turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_asin, lower(left(snip, 80)) ORDER BY turn, s, score DESC, review_id, aspect) = 1)
      SELECT parent_asin, CAST(row_number() OVER (PARTITION BY parent_asin ORDER BY turn, s, score DESC, review_id, aspect) AS INTEGER) AS evidence_rank, aspect, side, review_id FROM v QUALIFY evidence_rank <= 3""",
    "market_stats": _STATS,
    "product_blocks": f"{CAT} SELECT parent_asin, {_BLOCK} AS block FROM cat",
}
