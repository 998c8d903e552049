"""Pages of stuffed keywords, links, codes or tags, found by a suffix automaton per page and by missing clause structure.

A page is cut into words (a link is one word, its anchor text comes beside it; a hashtag is one word) and units (lines, and sentences inside lines).

1. Clause structure: a unit of some words that ends as a sentence ends, in whatever script, and isn't a row of short separated items. No word list is used.
2. The page's suffix automaton reads its tokens, separators and line ends included, by shape: links, hashtags, numbers, codes and capitalised words stand for
   their kind, lower-case words for themselves. The characters under its repeated maximal substrings (two tokens and more, or a lower-case
   word three times) are the page's repeat coverage. A unit without clause structure of whose characters at least half are covered is a list: of links, tags,
   codes or keywords. Without such coverage it's a heading, a scrap of prose, a blob.
3. In a unit with clause structure another automaton, over its own words, finds phrases that repeat *inside* it. A phrase for which that holds in
   several units is stuffed; a unit is stuffed where such phrases or repeats cover a quarter of its characters.

Records, rows of ``key: value`` and rows of a table are never lists. A page is stuffed when more than half of its words stand in lists or stuffed units. Without the automata nothing
is covered, so no page would be found.

Defined cases: a null, empty or blank text isn't stuffed; a very long text is judged whole (the automaton is linear in its words); repeated rows
each get their own verdict; an empty table gives no rows; extra columns are not read.

Scale: a map over the rows without any shuffle; memory is that of one page's automaton. A page all of whose units have clause structure needs no page automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_LINK = re.compile(
    r"""<a\b[^<>]*>(?P<html>[^<]*)</a>|<a\b[^<>]*>|\[(?P<mark>[^\[\]]*)\]\((?:https?://|www\.)[^\s()]*\)|(?:https?://|www\.)[^\s<>"'()\[\]]+""", re.IGNORECASE
)
_TAG = re.compile(r"<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h\d)\b[^<>]*>", re.IGNORECASE)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"\x00|#[^\W_]\w*|[^\W_]+(?:['’.-][^\W_]+)*")
#: A word, a run of a blob, a separator.
_TOKEN = re.compile(r"\x00\d+|#[^\W_]\w*|[A-Za-z0-9+/=_-]{60,}|[^\W_]+(?:['’.-][^\W_]+)*|[,;|•·،、:/»→>~*–—-]")
_LINES = re.compile(r"[\r\n\u2028\u2029]+")
_SENTENCES = re.compile(r"(?<=[.!?؟])(?=\s)|(?<=[。！？])")
_END = re.compile(r"[.!?؟。！？…][\"'”’)\]]*(?:\s*\([^()]*\))?\s*$")
_SEPARATOR = re.compile(r"\s[-–—|/·•»>*~→]+\s|[,;|•·،、]|::|>>|»|→")
_PAIR = re.compile(r"^[\s>*•-]*[^\W\d_][\w /()-]{0,28}[:=]\s*\S")
_RECORD = re.compile(r"""^\s*[\[{]\s*["'{\[]""")
_CELLS = re.compile(r"[;|\t]")

BLOB = 60  # letters and digits without a break from this length on are no word
COVERED = 0.5  # share of a unit's characters under the page's repeats
INSIDE = 0.25  # share of a unit's characters under phrases that repeat inside it
SHORT = 3  # words up to this length are mostly closed-class words
LINK_SIZE = 6  # characters that a link, or a word of its anchor, counts for


class SuffixAutomaton:
    """Of a sequence of integers, with the number of end positions of each state."""

    def __init__(self, sequence: list[int]):
        nexts: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last, prefix = 0, []
        for c in sequence:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
            prefix.append(cur)
        count = [0] * len(nexts)
        for s in prefix:
            count[s] = 1
        for s in sorted(range(1, len(nexts)), key=length.__getitem__, reverse=True):
            count[link[s]] += count[s]
        self.link, self.length, self.count, self.prefix = link, length, count, prefix

    def repeated(self, times: int = 2) -> list[int]:
        """For each position, the length of the longest substring that ends there and occurs at least ``times`` times."""
        found = []
        # an ancestor's count is never less, so the answer of a state is its own or that of its link
        best = [-1] * len(self.link)
        best[0] = 0
        for s in self.prefix:
            path = []
            while best[s] < 0:
                if self.count[s] >= times:
                    best[s] = self.length[s]
                else:
                    path.append(s)
                    s = self.link[s]
            for p in path:
                best[p] = best[s]
            found.append(best[s])
        return found


def covered(lengths: list[int], least: int = 1) -> np.ndarray:
    """Which positions lie under the repeats of at least ``least`` words that end at or after them."""
    n = len(lengths)
    marks = np.zeros(n + 1, dtype=np.int64)
    for i, size in enumerate(lengths):
        if size >= least:
            marks[i - size + 1] += 1
            marks[i + 1] -= 1
    return np.cumsum(marks[:n]) > 0


def _units(text: str) -> list[str]:
    found = []
    for line in _LINES.split(text):
        parts = [p for p in _SENTENCES.split(line) if p.strip()]
        # scraps of up to three words, as in "X! X! Only X", go with what follows them
        scrap = ""
        for p in parts:
            scrap += p
            if len(_WORD.findall(scrap)) > 3:
                found.append(scrap)
                scrap = ""
        if scrap.strip():
            if found and parts and len(parts) > 1:
                found[-1] += scrap
            else:
                found.append(scrap)
    return found


def _shape(token: str, at: int) -> str | tuple[str, int]:
    """What the page's automaton reads for a token: its kind, or a lower-case word itself; nothing equals a blob."""
    if token[0] == "\x00":
        return "link"
    if token[0] == "#":
        return "tag"
    if not token[0].isalnum():
        return token
    if len(token) >= BLOB:
        return "blob", at
    if any(c.isdecimal() for c in token):
        return "number" if token.replace(".", "").isdecimal() else "code"
    if not token.isascii() and unicodedata.name(token[0], "").split(" ")[0] != unicodedata.name(token[-1], "").split(" ")[0]:
        return "blob", at  # scripts mixed in a token
    return "name" if token[0].isupper() and len(token) > 1 else token


def _is_word(token: str) -> bool:
    return token[0] in "\x00#" or token[0].isalnum() and len(token) < BLOB


def _size(word: str) -> int:
    return LINK_SIZE * _words(word) if word[0] == "\x00" else len(word)


def _words(word: str) -> int:
    """A link counts as one word beside those of its anchor."""
    return 1 + int(word[1:] or 0) if word[0] == "\x00" else 1


def _inside(words: list[str]) -> tuple[float, set[tuple[str, ...]]]:
    """Share of a unit's characters under phrases that repeat inside it (two words twice, or a word three times), and those phrases.

    A short word belongs to a phrase only if it never stands outside it, which parts "usb hub" from "and the".
    """
    seen = Counter(words)
    if len(set(zip(words, words[1:]))) == len(words) - 1 and not any(n > 2 and len(w) > SHORT for w, n in seen.items()):
        return 0.0, set()  # no repeat of two words, none of a long one
    ids: dict[str, int] = {}
    automaton = SuffixAutomaton([ids.setdefault(w, len(ids)) for w in words])
    marks, phrases = np.zeros(len(words), bool), set()
    for lengths, least in ((automaton.repeated(2), 2), (automaton.repeated(3), 1)):
        for end, n in enumerate(lengths, 1):
            if n >= least:
                phrase = words[end - n : end]
                times = sum(words[k : k + n] == phrase for k in range(len(words) - n + 1))
                keep = [len(w) > SHORT or (n > 1 and seen[w] <= times) for w in phrase]
                if any(keep):
                    phrases.add(tuple(w for w, k in zip(phrase, keep) if k))
                    marks[end - n : end] |= keep
    sizes = np.array([len(w) for w in words])
    return float(sizes[marks].sum() / sizes.sum()), phrases


def _under(words: list[str], phrases: set[tuple[str, ...]], longest: int) -> float:
    """Share of the characters under any of the phrases."""
    marks = np.zeros(len(words), bool)
    for i in range(len(words)):
        for n in range(1, longest + 1):
            if tuple(words[i : i + n]) in phrases:
                marks[i : i + n] = True
    sizes = np.array([len(w) for w in words])
    return float(sizes[marks].sum() / sizes.sum())


def _clause(unit: str, words: int) -> bool:
    separators = len(_SEPARATOR.findall(unit))
    return words >= 4 and bool(_END.search(unit)) and not (separators >= 5 and words / (separators + 1) <= 5)


def judge(text: str | None) -> dict[str, float]:
    """words, listed (words in lists), phrases (words in stuffed units), coverage (share of the page's characters in units without clause structure under repeats)."""
    none = {"words": 0, "listed": 0, "phrases": 0, "coverage": 0.0}
    if not text or not text.strip():
        return none
    # a link stands as one token that keeps the number of its anchor's words
    text = _LINK.sub(lambda m: f" \x00{len(_WORD.findall(m['html'] or m['mark'] or ''))} ", text.replace("\x00", " "))
    text = _INLINE.sub(" ", _TAG.sub("\n", text)) if "<" in text else text
    units = _units(text)
    tokens = [[t for t in _TOKEN.findall(u)] for u in units]
    by_unit = [[t for t in ts if _is_word(t)] for ts in tokens]
    numbers = [sum(map(_words, ws)) for ws in by_unit]
    total = sum(numbers)
    if not total:
        return none
    clause = [_clause(u, n) for u, n in zip(units, numbers)]
    listed, hidden, characters = 0, 0, sum(_size(w) for ws in by_unit for w in ws)
    cells = [len(_CELLS.findall(u)) if any(c.isdecimal() for c in u) else 0 for u in units]
    if not all(c or not n for c, n in zip(clause, numbers)):
        ids: dict = {}
        sequence, plain = [], []
        for ts in tokens:
            for t in (*ts, "\n"):
                kind = _shape(t, len(sequence))
                sequence.append(ids.setdefault(kind, len(ids)))
                plain.append(kind == t and t.isalnum())
        automaton = SuffixAutomaton(sequence)
        repeat = covered(automaton.repeated(2), 2) | covered(automaton.repeated(3), 1) & np.array(plain)
        at = 0
        for i, (unit, ts, n) in enumerate(zip(units, tokens, numbers)):
            here = repeat[at : at + len(ts)]
            at += len(ts) + 1
            if not n or clause[i] or _RECORD.match(unit):
                continue
            sizes = np.array([_size(t) if _is_word(t) else 0 for t in ts])
            under = int(sizes[here].sum())
            hidden += under
            row = cells[i] >= 2 and cells[i] in (cells[i - 1 : i] + cells[i + 1 : i + 2])
            pair = n <= 12 and _PAIR.match(unit) and "\x00" not in unit
            if under >= COVERED * sizes.sum() and not row and not pair:
                listed += n
    # phrases that repeat inside several units are stuffed, and count wherever they stand
    prose = [([t.casefold() for t in ws], n) for ws, n, c in zip(by_unit, numbers, clause) if c and ws]
    inside = [_inside(words) for words, _ in prose]
    spread = Counter(p for share, found in inside if share >= INSIDE for p in found)
    stuffing = {p for p, n in spread.items() if n >= 2}
    longest = max(map(len, stuffing), default=0)
    phrases = sum(n for (words, n), (share, _) in zip(prose, inside) if stuffing and (share >= INSIDE or _under(words, stuffing, longest) >= INSIDE))
    return {"words": total, "listed": listed, "phrases": phrases, "coverage": hidden / max(1, characters)}


def stuffed(measures: dict[str, float]) -> bool:
    return measures["listed"] + measures["phrases"] > 0.5 * measures["words"]


def stuffing(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, listed, phrases, coverage, stuffed) of each row."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, words int, listed int, phrases int, coverage double, stuffed boolean"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([m[c] for m in found], pa.float64() if c == "coverage" else pa.int32()) for c in ("words", "listed", "phrases", "coverage")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([stuffed(m) for m in found], pa.bool_())], names=[key, "words", "listed", "phrases", "coverage", "stuffed"]
            )

    return df.select(key, text).mapInArrow(mapped, schema)
