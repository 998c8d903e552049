"""Words of a text and their hashes, the same on every machine."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|mark|small|sup|sub)(?:\s[^<>]*)?>", re.IGNORECASE)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z!][^<>]*>", re.DOTALL)
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")

MEMO = 500_000


class Hasher:
    """64-bit word hashes with a memo of bounded size."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in set(words) - memo.keys():
                memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            return np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` (at most 5) consecutive words; entry i starts at word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = hashes[:n] * _MULTIPLIERS[0]
    for k in range(1, size):
        acc = mix(acc) + hashes[k : k + n] * _MULTIPLIERS[k]
    return mix(acc)


def plain(text: str) -> str:
    """Lower case without markup, entities, invisible characters, accents and compatibility forms."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Mn", "Cf"))
    if "-" in text:
        text = _BROKEN.sub("", text)
    return text.casefold()


def plain_words(text: str | None) -> list[str]:
    return WORD.findall(plain(text)) if text else []
