"""Map freely typed values to a reference list: symmetric deletes, then a weighted Damerau-Levenshtein ranking.

Each typed value is folded (accents, look-alike letters, marks, case), stripped of the decorations that sellers put around a name,
and reduced to its letters and digits. The dictionary holds every entry with up to ``max_edits`` characters deleted; a value
probes it with its own deletes, so every entry within that Damerau-Levenshtein distance is among the candidates (a common
delete exists for each). Candidates whose digit runs differ are vetoed: another number is another thing. The rest are ranked
by weighted distance, then by how often the entry itself is typed in the data, then by ref_id. A value without a candidate may still be
a short form that stands for one entry only (leading words, initials, a number spelt otherwise, a maker's name put in front of an
entire entry); else it is reported as -1.

Defined cases: a null, blank or placeholder value is missing and gives no row; a value that literally is an entry gives no row from
``unresolved`` (``literal`` in ``resolve``), one that only folds onto an entry (other case, decorations, look-alikes) gives one, with distance 0;
a value of which nothing remains after folding is -1; a very long value (over ``max_edits`` folded characters beyond the longest entry) cannot
be within the bound, so only its short forms are looked up; repeated rows resolve alike; an empty reference list gives -1 for every value; extra columns are not read.

Scale: the rows are mapped where they lie, with a memo per task, so there is no shuffle of rows and no skew from a hot value. The
dictionary is broadcast in blocks of at most ``block_entries`` reference entries, a bound that is checked here: with more
entries the value set meets one block after another and the best of all blocks is kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.missing import text_missing
from cataloom.session import staged

MAX_EDITS = 2
BLOCK_ENTRIES = 20_000

# Cyrillic and Greek letters that look like a Latin one.
LOOKALIKES = str.maketrans(
    "авеёкмнорстухіјѕԁһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοι",
    "abeekmhopctyxijsdh" + "abezhikmnoptyxaoi",
)

# Decorations around a typed name, by field, removed when something else remains.
DECORATIONS: dict[str, tuple[str, ...]] = {
    "": (r"[®™©]", r"\((?:r|tm|c)\)", r"^[\"'“”]+|[\"'“”]+$", r"[ .]+$"),
    "brand": (r"^visit the (?=.+ store$)", r"(?<=\w) store$", r"^by ", r"^brand ?: ?", r" ?\(official\)$", r",? inc\.?$", r",? usa$", r" corp(?:oration)?\.?$", r" (?:computers|laptops)$"),
    "cpu_family": (r"^(?:quad|dual|hexa|octa)[- ]core ", r" cpu @ [\d.]+ ?ghz$", r" ?\(\d+-core\)$", r"-\d{3,5}[a-z]{0,3}$", r" (?:series|processor|cpu)$"),
    "gpu_model": (r" ?\(\d+ ?gb\)$", r" \d+ ?gb gddr\d\w?$", r" laptop gpu$", r" max-q$", r" graphics$"),
}

# Number words and Roman numerals.
NUMBER_WORDS = {"one": ("1", "i"), "two": ("2", "ii"), "three": ("3", "iii"), "four": ("4", "iv"), "five": ("5", "v"), "six": ("6", "vi"), "seven": ("7", "vii"), "eight": ("8", "viii"), "nine": ("9", "ix"), "ten": ("10", "x")}

_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def _neighbours() -> dict[str, frozenset[str]]:
    at = {ch: (r, i + r * 0.5) for r, row in enumerate(_ROWS) for i, ch in enumerate(row)}
    return {a: frozenset(b for b, (s, y) in at.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1) for a, (r, x) in at.items()}


NEAR_KEYS = _neighbours()


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and repeated blanks."""
    plain = unicodedata.normalize("NFKD", text.replace("™", " ").replace("®", " "))
    plain = "".join(c for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(plain.translate(LOOKALIKES).lower().translate(LOOKALIKES).split())


def strip_decorations(folded: str, field: str) -> str:
    """``folded`` without decorations, each removed only when letters or digits remain."""
    again = True
    while again:
        again = False
        for pattern in (*DECORATIONS[""], *DECORATIONS.get(field, ())):
            shorter = re.sub(pattern, "", folded).strip(" -_")
            if shorter != folded and re.search(r"[^\W_]", shorter):
                folded, again = shorter, True
    return folded


def compact(folded: str) -> str:
    return re.sub(r"[\W_]+", "", folded)


def digits(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"\d+", text))


def deletes(text: str, edits: int) -> set[str]:
    """``text`` with up to ``edits`` characters removed."""
    found, layer = {text}, {text}
    for _ in range(edits):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        found |= layer
    return found


def aliases(form: str) -> set[str]:
    """Shorter and respelt forms of a folded entry: leading words, initials, numbers as figures or Roman numerals."""
    words = [w for w in form.split() if w not in ("&", "and")]
    found = {compact(" ".join(words))}
    if len(words) > 1:
        found |= {compact(" ".join(words[:n])) for n in range(1, len(words))}
        found.add("".join(w[0] for w in words))
    for word, others in NUMBER_WORDS.items():
        if word in words:
            found |= {compact(" ".join(o if w == word else w for w in words)) for o in others}
    return {a for a in found if len(a) > 1}


def distance(a: str, b: str) -> tuple[int, float]:
    """Unrestricted Damerau-Levenshtein distance of a typed ``a`` to an entry ``b``: (edits, weighted cost along a cheapest path).

    Neighbouring keys, doubled letters and swapped letters, the commonest slips, weigh less.
    """
    inf = (len(a) + len(b), float(len(a) + len(b)))
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = (i, float(i))
    for j in range(len(b) + 1):
        d[1][j + 1] = (j, float(j))
    last: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                step, match = (0, 0.0), j
            else:
                step = (1, 0.7 if y in NEAR_KEYS.get(x, ()) else 1.0)
            extra = 0.7 if i > 1 and a[i - 2] == x else 0.9
            options = [
                (d[i][j][0] + step[0], d[i][j][1] + step[1]),
                (d[i][j + 1][0] + 1, d[i][j + 1][1] + extra),
                (d[i + 1][j][0] + 1, d[i + 1][j][1] + 1.0),
            ]
            if k and m:
                swap = (i - k - 1) + 1 + (j - m - 1)
                options.append((d[k][m][0] + swap, d[k][m][1] + swap - 0.2))
            d[i + 1][j + 1] = min(options)
        last[x] = i
    return d[len(a) + 1][len(b) + 1]


class Dictionary:
    """Symmetric-delete dictionary of one block of reference entries."""

    def __init__(
        self,
        entries: Iterable[tuple[int, str, str, int]],
        max_edits: int = MAX_EDITS,
        shared: Iterable[tuple[str, str]] = (),
        longest: dict[str, int] | None = None,
    ):
        """entries: (ref_id, field, canonical value, frequency of the literal value).

        Of a block of a longer list: the (field, alias) that entries of several blocks share, and the length of a field's longest entry in the list.
        """
        self.max_edits = max_edits
        self.literal: dict[tuple[str, str], int] = {}
        self.index: dict[tuple[str, str], list[int]] = {}
        self.longest: dict[str, int] = {}
        self.alias: dict[tuple[str, str], int] = {}
        self.whole: dict[tuple[str, str], int] = {}
        self.entries: list[tuple[int, str, tuple[str, ...], int, int]] = []
        for ref_id, field, value, frequency in sorted(entries):
            form = fold(value)
            key = compact(form)
            self.literal.setdefault((field, value), ref_id)
            self.longest[field] = max(self.longest.get(field, 0), len(key))
            at = len(self.entries)
            self.entries.append((ref_id, key, digits(key), frequency, len(form.split())))
            known = self.whole.setdefault((field, key), at)
            if frequency > self.entries[known][3]:
                self.whole[field, key] = at
            for t in deletes(key, max_edits):
                self.index.setdefault((field, t), []).append(at)
            for t in aliases(form):
                # an alias that two entries share stands for neither
                self.alias[field, t] = at if (field, t) not in self.alias else -1
        self.alias |= dict.fromkeys(shared, -1)
        self.longest |= longest or {}

    def lookup(self, field: str, typed: str) -> tuple[int, int, float, int]:
        """(ref_id, edits, weighted cost, frequency); ref_id -1 for a miss."""
        best = self.ranked(field, typed)
        return (-1, -1, -1.0, 0) if best is None else (best[5], best[6], best[2], -best[4])

    def ranked(self, field: str, typed: str) -> tuple[int, int, float, int, int, int, int] | None:
        """(form, step, weighted cost, words apart, -frequency, ref_id, edits): of several blocks' hits the least is that of the whole list."""
        best = None
        form = fold(typed)
        forms = dict.fromkeys((strip_decorations(form, field), form))
        for number, text in enumerate(forms):
            key = compact(text)
            if not key:
                continue
            seen: set[int] = set()
            own = digits(key)
            near = len(key) <= self.longest.get(field, 0) + self.max_edits
            for t in deletes(key, self.max_edits) if near else ():
                for at in self.index.get((field, t), ()):
                    if at in seen:
                        continue
                    seen.add(at)
                    ref_id, entry, numbers, frequency, words = self.entries[at]
                    if numbers != own:
                        continue
                    edits, cost = distance(key, entry)
                    # an edit for every three characters at most, so that short names don't meet each other
                    if edits > min(self.max_edits, max(1, len(entry) // 3)):
                        continue
                    rank = (number, 0, round(cost, 6), abs(words - len(text.split())), -frequency, ref_id, edits)
                    if best is None or rank < best:
                        best = rank
            if best is None:
                words = text.split()
                short = compact(" ".join(w for w in words if w != "and"))
                # a short form that stands for one entry only; or, with a maker's one or two words left out in front, an entire entry
                found = [self.alias.get((field, short), -1), *(self.whole.get((field, compact(" ".join(words[n:]))), -1) for n in (1, 2) if n < len(words))]
                for step, at in enumerate(found, 1):
                    if at >= 0:
                        best = (number, step, float(self.max_edits + 1), 0, -self.entries[at][3], self.entries[at][0], self.max_edits + 1)
                        break
            if best is not None:
                break
        return best


def _shared_aliases(reference: DataFrame) -> DataFrame:
    """``reference`` with the aliases of each entry that another entry of the whole list shares, and the length of its field's longest entry."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in reference.schema)}, aliases array<string>, length int"

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [fold(v) for v in pdf["canonical_value"]]
            yield pdf.assign(aliases=[sorted(aliases(f)) for f in own], length=[len(compact(f)) for f in own])

    # numbered, so that a row that repeats counts as often as it stands there
    entries = staged(reference.mapInPandas(forms, schema).withColumn("at", F.monotonically_increasing_id()), "canonical-aliases")
    each = entries.select("at", "field_name", F.explode("aliases").alias("alias"))
    several = each.groupBy("field_name", "alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(several, ["field_name", "alias"]).groupBy("at").agg(F.collect_list("alias").alias("shared"))
    longest = entries.groupBy("field_name").agg(F.max("length").alias("longest"))
    return entries.drop("aliases", "length").join(shared, "at", "left").join(longest, "field_name").drop("at")


Block = tuple[list[tuple[int, str, str, int]], set[tuple[str, str]], dict[str, int]]


def _blocks(reference: DataFrame, frequency: DataFrame, block_entries: int) -> Iterator[Block]:
    """The reference list in bounded blocks, streamed to the driver: entries, aliases that stand for no single entry of the whole list, longest entries."""
    known = reference.where(F.col("canonical_value").isNotNull() & F.col("field_name").isNotNull()).select("ref_id", "field_name", "canonical_value")
    if known.limit(block_entries + 1).count() > block_entries:
        known = _shared_aliases(known)
    else:
        known = known.select("*", F.lit(None).cast("array<string>").alias("shared"), F.lit(0).alias("longest"))
    rows = known.join(frequency, ["field_name", "canonical_value"], "left").select(
        "ref_id", "field_name", "canonical_value", F.coalesce("frequency", F.lit(0)).alias("frequency"), "shared", "longest"
    )
    block: Block = ([], set(), {})
    for r in rows.toLocalIterator():
        block[0].append((r.ref_id, r.field_name, r.canonical_value, r.frequency))
        block[1].update((r.field_name, a) for a in r.shared or ())
        if r.longest:
            block[2][r.field_name] = r.longest
        if len(block[0]) == block_entries:
            yield block
            block = ([], set(), {})
    if block[0]:
        yield block


#: What orders the hits of blocks as one dictionary of the whole list would: literal entries have form -1, misses form 2.
LITERAL, MISS = -1, 2
_RANK = {"form": "int", "step": "int", "cost": "double", "words": "int", "rarity": "long", "ref_id": "long", "edits": "int"}


def resolve(values: DataFrame, reference: DataFrame, fields: list[str], key: str, block_entries: int = BLOCK_ENTRIES, max_edits: int = MAX_EDITS) -> DataFrame:
    """(key, field_name, value, ref_id, edits, cost, literal) of every cell of ``fields`` that isn't missing.

    ``literal``: the value is an entry as it stands; ref_id -1 marks a miss. ``reference`` has ref_id, field_name and canonical_value.
    """
    spark = values.sparkSession
    cells = values.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("c")).select(
        key, "c.field_name", "c.value"
    )
    cells = cells.where(~text_missing(F.col("value")))
    literals = reference.select("field_name", F.col("canonical_value").alias("value")).distinct()
    frequency = cells.join(literals, ["field_name", "value"]).groupBy("field_name", F.col("value").alias("canonical_value")).agg(F.count(F.lit(1)).alias("frequency"))
    schema = f"{cells.schema[key].simpleString().replace(':', ' ')}, field_name string, value string, {', '.join(f'{c} {t}' for c, t in _RANK.items())}"

    def against(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            entries, shared, longest = sent.value
            words = Dictionary(entries, max_edits, shared=shared, longest=longest)
            memo: dict[tuple[str, str], tuple[int, int, float, int, int, int, int]] = {}
            for pdf in batches:
                found = []
                for pair in zip(pdf["field_name"], pdf["value"]):
                    hit = memo.get(pair)
                    if hit is None:
                        ref = words.literal.get(pair)
                        hit = (LITERAL, 0, 0.0, 0, 0, ref, 0) if ref is not None else words.ranked(*pair) or (MISS, 0, -1.0, 0, 0, -1, -1)
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[pair] = hit
                    found.append(hit)
                yield pdf.assign(**dict(zip(_RANK, [list(x) for x in zip(*found)] if found else [[] for _ in _RANK])))

        return cells.mapInPandas(mapped, schema)

    parts = [against(b) for b in _blocks(reference, frequency, block_entries)] or [against(([], set(), {}))]
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        rank = F.struct(*_RANK)
        out = out.groupBy(key, "field_name", "value").agg(*[F.min_by(c, rank).alias(c) for c in ("form", "ref_id", "edits", "cost")])
    return out.select(key, "field_name", "value", "ref_id", "edits", "cost", (F.col("form") == LITERAL).alias("literal"))


def unresolved(values: DataFrame, reference: DataFrame, fields: list[str], key: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(key, field_name, ref_id) of each cell that holds a value but isn't literally an entry; -1 where there is none."""
    return resolve(values, reference, fields, key, block_entries).where(~F.col("literal")).select(key, "field_name", "ref_id")
