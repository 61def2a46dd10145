"""Vectorised word and word-run hashing of whole text batches.

Words of a text: HTML entities decoded, NFKC, lower case, punctuation and symbols taken as spaces, split at white space;
in zh and ja every remaining character is a word. A batch of texts is joined, normalised once by the C library and
then handled as one NumPy array of code points, so no Python object is made per word. Word hashes are polynomial
hashes modulo 2**64, taken from prefix sums; they are equal in every process.
"""

from __future__ import annotations

import functools
import html
import sys
import unicodedata

import numpy as np

SEP = "\x1e"  # white space for str.split, so replacing it inside texts changes no word
CJK_LANGS = ("zh", "ja")
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd: invertible modulo 2**64
_CHUNK = 400_000


@functools.lru_cache(1)
def _space() -> np.ndarray:
    """1 for white space, punctuation and symbols; all of them lie below U+20000."""
    t = np.zeros(0x20000, np.bool_)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            t[c] = ch.isspace() or unicodedata.category(ch)[0] in "PS"
    return t


@functools.lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, np.uint64)
    p, q = one.copy(), one.copy()
    p[1:], q[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    return np.cumprod(p), np.cumprod(q)


def _grown(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    p, q = _powers(base, size)
    return p[:n], q[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x


def _prefix(v: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _grown(base, len(v) + 1)
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * p[:-1], out=total[1:])
    return total, q


def clean(text: str | None) -> str:
    """The one text's part of the normalisation that must not cross text borders."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    return text.replace(SEP, " ") if SEP in text else text


def _chunk(texts: list[str], cjk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = SEP.join(texts)
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    cp = np.frombuffer(s.lower().encode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass"), np.uint32)
    word = ~_space()[np.minimum(cp, 0x1FFFF)]
    doc = np.cumsum(cp == 0x1E)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    single = cjk[doc] if cjk.any() else False
    start = np.flatnonzero(word & (~before | single))
    end = np.flatnonzero(word & (~after | single)) + 1
    v = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(_Q)
    v ^= v >> np.uint64(29)
    total, inv = _prefix(v, _P)
    return mix((total[end] - total[start]) * inv[start]), np.bincount(doc[start], minlength=len(texts))


def word_hashes(texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, offsets of the texts in them); a null text has no words."""
    texts = [clean(t) for t in texts]
    cjk = np.fromiter((x in CJK_LANGS for x in langs), np.bool_, len(texts))
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < _CHUNK):
            size += len(texts[to])
            to += 1
        h, n = _chunk(texts[at:to], cjk[at:to])
        hashes.append(h)
        counts.append(n)
        at = to
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.concatenate(counts), out=offsets[1:])
    return np.concatenate(hashes), offsets


def runs(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `width` consecutive words, offsets); run i of a text starts at its word i."""
    n = len(hashes)
    count = np.maximum(np.diff(offsets) - (width - 1), 0)
    to = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=to[1:])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    total, inv = _prefix(hashes, _Q)
    first = np.repeat(offsets[:-1] - to[:-1], count) + np.arange(to[-1])
    return mix((total[first + width] - total[first]) * inv[first], n * 0 + width), to


def text_class(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit value for each text's whole word sequence, as signed integers (for Spark)."""
    if not len(hashes):
        return np.zeros(len(offsets) - 1, np.int64)
    total, inv = _prefix(hashes, _P)
    n = np.diff(offsets).astype(np.uint64)
    a, b = offsets[:-1], offsets[1:]
    return mix((total[b] - total[a]) * inv[a] + n * np.uint64(_Q), 77).view(np.int64)


def groups_by_width(langs: list[str | None], width: int, width_cjk: int) -> list[tuple[int, np.ndarray]]:
    cjk = np.fromiter((x in CJK_LANGS for x in langs), np.bool_, len(langs))
    return [(w, i) for w, i in ((width, np.flatnonzero(~cjk)), (width_cjk, np.flatnonzero(cjk))) if len(i)]


def take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some rows of a ragged array."""
    n = offsets[rows + 1] - offsets[rows]
    to = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=to[1:])
    return values[np.repeat(offsets[rows] - to[:-1], n) + np.arange(to[-1])], to
