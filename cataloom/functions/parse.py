"""Specification parsers: columns that read a typed value out of a title and a ``details`` map.

Every parser is one expression over columns, so a whole catalogue is parsed in a single projection inside code generation. Absent
values are null, absent categories ``Unknown``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions import vocabulary as V


def ci(pattern: str) -> str:
    return "(?i)" + pattern


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(ci(pattern)), F.lit(False))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """The group of the first match, null without a match or when the group took no part."""
    found = F.regexp_extract(text, ci(pattern), index)
    return F.when(found != "", found)


def detail(details: Column, key: str) -> Column:
    return F.try_element_at(details, F.lit(key))


def ladder(text: Column, rules: Iterable[tuple[str, str]], default: Column | None = None) -> Column:
    """The label of the first rule whose pattern occurs."""
    chain = None
    for pattern, label in rules:
        chain = (F.when if chain is None else chain.when)(text.rlike(ci(pattern)), F.lit(label))
    return chain if default is None else chain.otherwise(default)


def templated(text: Column, rules: Iterable[tuple]) -> Column:
    """Like ``ladder``; a label's {0} takes the match's first group."""
    chain = None
    for pattern, template, *_ in rules:
        if "{0}" in template:
            before, after = template.split("{0}")
            value = F.trim(F.regexp_replace(F.concat(F.lit(before), F.trim(F.regexp_extract(text, ci(pattern), 1)), F.lit(after)), r"\s+", " "))
        else:
            value = F.lit(template)
        chain = (F.when if chain is None else chain.when)(text.rlike(ci(pattern)), value)
    return chain


def number(text: Column) -> Column:
    return text.try_cast("double")


def gigabytes(value: Column, unit: Column) -> Column:
    unit = F.lower(unit)
    return F.when(unit.startswith("t"), value * 1024.0).when(unit.startswith("m"), value / 1024.0).otherwise(value)


def size_of(text: Column, pattern: str = V.SIZE) -> Column:
    return gigabytes(number(group(text, pattern, 1)), group(text, pattern, 2))


def between(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


# ---------------------------------------------------------------- listing kind and maker


def drop_reason(title: Column, categories: Column) -> Column:
    """Why a listing is no laptop: no_title, accessory, other_form_factor, desktop_or_aio; '' for a laptop."""
    t = F.trim(F.coalesce(title, F.lit("")))
    cat = F.lower(F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " "))
    lap, acc = F.regexp_instr(t, F.lit(ci(V.LAPTOP))), F.regexp_instr(t, F.lit(ci(V.ACCESSORY)))
    start = F.greatest(F.lit(1), acc - 14)
    bundle = has(F.substring(t, start, acc - start), V.BUNDLE_BEFORE)
    return (
        F.when(t == "", "no_title")
        .when(cat.contains("accessories & peripherals") | cat.contains("laptop bags"), "accessory")
        .when((acc > 0) & ~bundle & ((lap == 0) | (acc < lap)), "accessory")
        .when(has(t, V.OTHER_FORM) & (lap == 0), "other_form_factor")
        .when(has(t, V.DESKTOP) & ~has(t, V.PORTABLE), "desktop_or_aio")
        .otherwise("")
    )


def brand_token(value: Column) -> Column:
    v = F.regexp_replace(F.btrim(F.trim(value), F.lit(",;|")), r"\s+", " ")
    return F.when((v != "") & ~F.lower(v).isin(*V.NO_BRAND) & (F.length(v) <= 40), v)


def brand(store: Column, details: Column, title: Column) -> Column:
    """Canonical maker of a listing: store, then details, by alias; then the title; then the token itself."""
    tokens = []
    for raw in (store, detail(details, "Brand"), detail(details, "Manufacturer")):
        t = brand_token(raw)
        tokens.append(F.when(~F.lower(t).isin(*V.RESELLERS) & ~has(t, V.RENEWED), t))
    aliases = F.create_map(*[F.lit(x) for kv in V.BRAND_ALIASES.items() for x in kv])
    known = []
    for t in tokens:
        low = F.lower(t)
        known += [F.try_element_at(aliases, low), F.try_element_at(aliases, F.substring_index(low, " ", 1))]
    own = F.filter(F.array(*tokens), lambda t: t.isNotNull() & t.rlike("[A-Za-z]"))
    first = F.try_element_at(own, F.lit(1))
    shown = F.when((first == F.upper(first)) & (F.length(first) <= 5), first).otherwise(F.initcap(first))
    return F.coalesce(*known, ladder(F.coalesce(title, F.lit("")), V.TITLE_BRANDS), shown, F.lit("Unknown"))


def renewed(store: Column, details: Column, title: Column) -> Column:
    return has(F.concat_ws(" ", store, title, detail(details, "Special Feature"), detail(details, "Color")), V.RENEWED)


def price(raw: Column) -> Column:
    """A number, or the first number in a text, between 20 and 20,000."""
    found = F.regexp_replace(group(raw.cast("string"), r"(\d[\d,]*(?:\.\d+)?)"), ",", "")
    return between(number(found), 20.0, 20000.0)


# ---------------------------------------------------------------- parts


def cpu_text(*parts: Column) -> Column:
    text = F.translate(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]), "_®™", "   ")
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clock(text: Column) -> Column:
    """The first clock speed between 0.5 and 6.5 GHz, those after "up to" last."""
    whole = F.regexp_extract_all(text, F.lit(r"(?i)(?:up to[^\d]{0,6})?\d+(?:\.\d+)?\s*(?:ghz|mhz)"), F.lit(0))
    values = F.transform(
        whole,
        lambda m: F.struct(
            (number(F.regexp_extract(m, r"(\d+(?:\.\d+)?)\s*(?i:ghz|mhz)", 1)) / F.when(m.rlike(ci("mhz")), 1000.0).otherwise(1.0)).alias("v"),
            m.rlike(ci("up to")).alias("boost"),
        ),
    )
    fit = F.filter(values, lambda s: s["v"].between(0.5, 6.5))
    base = F.filter(fit, lambda s: ~s["boost"])
    return F.coalesce(F.try_element_at(base, F.lit(1))["v"], F.try_element_at(fit, F.lit(1))["v"])


def cpu(details: Column, title: Column) -> dict[str, Column]:
    noted = cpu_text(*[detail(details, k) for k in ("CPU Model", "Processor", "Processor Description", "CPU Manufacturer", "Processor Brand")])
    named = cpu_text(title)
    family = F.coalesce(templated(noted, V.CPU_FAMILIES), templated(named, V.CPU_FAMILIES), F.lit("Unknown"))
    makers = [(p, m) for p, _, m in V.CPU_FAMILIES]
    words = [(rf"\b{k}\b", v) for k, v in V.CPU_MAKERS.items()]
    own = cpu_text(detail(details, "Processor Brand"), detail(details, "CPU Manufacturer"))
    by_family = F.coalesce(ladder(noted, makers), ladder(named, makers))
    return {
        "cpu_brand": F.coalesce(by_family, ladder(own, words), ladder(named, words), F.lit("Unknown")),
        "cpu_family": family,
        "cpu_tier": number(group(family, V.CPU_TIER)),
        "cpu_ghz": F.coalesce(*[clock(cpu_text(detail(details, k))) for k in ("Processor", "CPU Speed", "Processor Speed")], clock(named)),
    }


def ram_type(text: Column) -> Column:
    raw = F.lower(group(text, V.RAM_TYPE))
    names = F.create_map(*[F.lit(x) for kv in V.RAM_TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, raw), F.upper(raw))


def ram(details: Column, title: Column) -> dict[str, Column]:
    noted = F.array(*[between(size_of(detail(details, k)), 0.12, 256.0) for k in ("Ram Memory Installed Size", "RAM", "Memory Storage Capacity", "Installed RAM")])
    noted = F.array_compact(noted)
    drive = F.coalesce(*[size_of(detail(details, k)) for k in ("Hard Drive", "Hard Disk Size", "Flash Memory Size", "Total Storage Capacity")])
    echo = lambda c: (c >= 16) & F.coalesce(F.abs(c - drive) < 0.01, F.lit(False))
    fit = F.filter(noted, lambda c: c.isin(*V.RAM_SIZES) & ~echo(c))
    titled = F.coalesce(*[between(size_of(title, p), 0.12, 256.0) for p in V.RAM_TITLE])
    kind = ram_type(F.concat_ws(" ", *[detail(details, k) for k in ("RAM", "Computer Memory Type", "Memory Technology")]))
    return {
        "ram_gb": F.coalesce(F.try_element_at(fit, F.lit(1)), titled, F.try_element_at(noted, F.lit(1))),
        "ram_type": F.coalesce(F.when(kind != "Unknown", kind), ram_type(title), F.lit("Unknown")),
    }


def storage(details: Column, title: Column) -> dict[str, Column]:
    noted = [between(size_of(detail(details, k)), 4.0, 16384.0) for k in ("Hard Disk Size", "Hard Drive", "Hard Drive Size", "Flash Memory Size", "Memory Storage Capacity")]
    titled = [between(size_of(title, p), 4.0, 16384.0) for p in V.STORAGE_TITLE]
    keys = ("Hard Drive", "Hard Disk Description", "Hard Drive Interface", "Flash Memory Size", "Hard Drive Rotational Speed")
    text = F.concat_ws(" ", *[detail(details, k) for k in keys])
    flash = F.when(F.coalesce(detail(details, "Flash Memory Size"), F.lit("")) != "", F.lit("SSD"))
    return {
        "storage_gb": F.coalesce(*noted, *titled),
        "storage_type": F.coalesce(ladder(text, V.STORAGE_TYPES), flash, ladder(title, V.STORAGE_TYPES), F.lit("Unknown")),
    }


def gpu(details: Column, title: Column, model: Column | None = None) -> dict[str, Column]:
    """``model``: the column of an earlier projection that holds ``gpu_model`` already."""
    text = F.trim(F.concat_ws(" ", *[F.when(detail(details, k) != "", detail(details, k)) for k in ("Graphics Coprocessor", "Graphics Card Description", "Graphics Processor Manufacturer")]))
    title = F.coalesce(title, F.lit(""))
    if model is None:
        model = F.coalesce(templated(text, V.GPU_MODELS), templated(title, V.GPU_MODELS), F.lit("Unknown"))
    everything = F.concat_ws(" ", text, title)
    chipset = F.lower(F.coalesce(detail(details, "Chipset Brand"), F.lit("")))
    by_chipset = None
    for word, maker in V.CHIPSET_MAKERS:
        by_chipset = (F.when if by_chipset is None else by_chipset.when)(chipset.contains(word), F.lit(maker))

    def kind(blob: Column) -> Column:
        return F.when(has(blob, V.DISCRETE_GPU) & ~has(blob, V.VEGA_APU), F.lit(True)).when(has(blob, V.INTEGRATED_GPU), F.lit(False))

    card = F.lower(F.coalesce(detail(details, "Card Description"), F.lit("")))
    by_card = F.when(card.contains("dedicated"), F.lit(True)).when(card.contains("integrated") | card.contains("shared"), F.lit(False))
    discrete = F.coalesce(kind(F.concat_ws(" ", model, text)), kind(title), by_card, F.lit(False))
    maker = F.coalesce(ladder(everything, V.GPU_MAKERS), by_chipset)
    return {
        "gpu_brand": F.coalesce(maker, F.when(~discrete & (model != "Unknown"), F.lit("Intel")), F.lit("Unknown")),
        "gpu_model": model,
        "is_discrete_gpu": discrete,
    }


def screen(details: Column, title: Column) -> dict[str, Column]:
    keys = ("Standing screen display size", "Screen Size", "Display Size", "Screen size")
    noted = [between(number(group(detail(details, k), r"(\d+(?:\.\d+)?)")), 6.0, 22.0) for k in keys]
    titled = between(number(group(title, r"(\d{1,2}(?:\.\d)?)\s*(?:\"|''|”|-?\s*inch(?:es)?\b)")), 6.0, 22.0)

    def resolution(text: Column, pattern: str) -> Column:
        w, h = number(group(text, pattern, 1)), number(group(text, pattern, 2))
        return F.when(w.between(640, 7680) & h.between(400, 4800), F.struct(w.alias("w"), h.alias("h")))

    keys = ("Max Screen Resolution", "Screen Resolution", "Resolution", "Display Resolution Maximum")
    size = r"(\d{3,4})\s*(?:x|by|-by-|\*)\s*(\d{3,4})"
    plain = r"\(?(\d{3,4})\s*x\s*(\d{3,4})\)?"
    by_name = None
    for pattern, w, h in V.RESOLUTIONS:
        by_name = (F.when if by_name is None else by_name.when)(title.rlike(ci(pattern)), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))
    # a size in the title that is out of range still keeps class names from being read
    from_title = F.when(has(title, plain), resolution(title, plain)).otherwise(by_name)
    best = F.coalesce(*[resolution(detail(details, k), size) for k in keys], from_title)
    return {"screen_in": F.coalesce(*noted, titled), "screen_w": best["w"], "screen_h": best["h"]}


def os_family(details: Column, title: Column) -> Column:
    return F.coalesce(ladder(detail(details, "Operating System"), V.OS_FAMILIES), ladder(title, V.OS_FAMILIES), F.lit("Unknown"))


def weight_floor(screen_in: Column) -> Column:
    return F.when(screen_in < 12, 1.5).when(screen_in < 14, 1.8).when(screen_in < 16, 2.2).when(screen_in >= 16, 3.0).otherwise(0.5)


def weight(details: Column, title: Column, screen_in: Column) -> Column:
    pattern = r"(\d+(?:\.\d+)?)\s*(pounds|lbs?|ounces|oz|kilograms|kg|grams|g)\b"

    def pounds(text: Column) -> Column:
        v, unit = number(group(text, pattern, 1)), F.lower(group(text, pattern, 2))
        v = F.when(unit.isin("ounces", "oz"), v / 16.0).when(unit.isin("kilograms", "kg"), v * 2.20462).when(unit.isin("grams", "g"), v * 0.00220462).otherwise(v)
        return between(v, 0.5, 18.0)

    titled = between(number(group(title, r"(\d+(?:\.\d+)?)\s*(?:lbs?|pounds)\b")), 0.5, 18.0)
    found = F.coalesce(*[pounds(detail(details, k)) for k in ("Item Weight", "Weight", "Product Weight")], titled)
    return F.when(found >= weight_floor(screen_in), found)


# ---------------------------------------------------------------- segment and variants


def _words(words: Iterable[str]) -> str:
    return "|".join(words)


def segment(row: dict[str, Column]) -> Column:
    """row: title, brand, series_raw, os_family, is_discrete_gpu, gpu_model, ram_gb, cpu_family, weight_lb, screen_in, price."""
    text = F.concat_ws(" ", row["brand"], row["series_raw"], row["title"])
    discrete = F.coalesce(row["is_discrete_gpu"], F.lit(False))
    gaming = has(text, rf"\b(gaming|gamer|{_words(V.GAMING_HINTS)})\b") | has(row["gpu_model"], r"\b(rtx|gtx)\b")
    light = F.coalesce(row["weight_lb"] <= 3.3, F.lit(False))
    dear = F.coalesce(row["price"] >= 900, F.lit(False)) | (row["cpu_family"].isin(*V.PREMIUM_CPUS) & F.coalesce(row["ram_gb"] >= 8, F.lit(False)))
    small = F.coalesce(row["screen_in"] <= 15.0, F.lit(True))
    cheap = F.coalesce(row["price"] < 400, F.lit(False)) | row["cpu_family"].isin(*V.BUDGET_CPUS) | F.coalesce(row["ram_gb"] <= 4, F.lit(False))
    return (
        F.when((row["os_family"] == "ChromeOS") | has(text, "chromebook"), "chromebook")
        .when(discrete & gaming, "gaming")
        .when(has(text, rf"\b({_words(V.BUSINESS_HINTS)})\b"), "business")
        .when(has(text, rf"({_words(V.ULTRABOOK_HINTS)}|\bultrabook\b|\bultra ?slim\b)"), "ultrabook")
        .when(light & dear & small & ~discrete, "ultrabook")
        .when(cheap, "budget")
        .otherwise("mainstream")
    )


def model_signature(title: Column, brand: Column) -> Column:
    """"brand|up to four words" of a title without specifications, '' when nothing distinctive is left."""
    t = F.substring_index(F.lower(F.coalesce(title, F.lit(""))), "(", 1)
    t = F.split(t, r"\||,|\s-\s|:", 2)[0]
    for pattern in (r"\d+(?:\.\d+)?\s*(?:gb|tb|mb|ghz|mhz|hz|wh|nits?)\b", r"\b(?:19|20)\d{2}\b", r"\d+(?:\.\d+)?\s*(?:\"|''|”|inch(?:es)?)", r"\bi[3579][- ]?\d{3,5}[a-z]{0,2}\b", r"[^a-z0-9]+"):
        t = F.regexp_replace(t, pattern, " ")
    own = F.split(F.regexp_replace(F.lower(brand), r"[^a-z0-9 ]", " "), " +")
    stop = F.array(*[F.lit(w) for w in V.MODEL_STOPWORDS])
    words = F.filter(F.split(t, " +"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w) & ~F.array_contains(own, w))
    words = F.slice(words, 1, 4)
    lone = F.try_element_at(words, F.lit(1))
    generic = (F.size(words) == 1) & (lone.isin(*V.GENERIC_MODEL) | (F.length(lone) < 3))
    return F.when((F.size(words) == 0) | generic, "").otherwise(F.concat(F.lower(brand), F.lit("|"), F.array_join(words, " ")))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits, halves to even."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def dedup_key(row: dict[str, Column]) -> Column:
    sig = row["model_sig"]
    key = F.concat_ws(
        "|",
        sig,
        F.coalesce(fixed(row["screen_in"], 1), F.lit("na")),
        row["cpu_family"],
        F.coalesce(fixed(row["cpu_tier"], 0), F.lit("na")),
        row["gpu_model"],
        F.when(row["is_discrete_gpu"], "d").otherwise("i"),
        row["os_family"],
        F.when(row["is_renewed"], "R").otherwise("N"),
    )
    return F.when(sig == "", F.concat(F.lit("__uniq__"), row["parent_asin"])).otherwise(key)
