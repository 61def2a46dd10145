"""Byte-level BPE encoding of a corpus without the merge loop.

Bytes are mapped to Latin-1 characters, so one Aho-Corasick automaton holds all tokens. A word is encoded by taking, at each
place, the longest token that matches and stepping back to the next shorter one wherever two neighbours would not stay apart
under the merges; whether two tokens may stand next to each other is decided once and kept. An encoding in which
every neighbouring pair is compatible is the encoding the merges produce, so ids are exact, in time linear in the text.
Words of the vocabulary's split pattern recur, so each worker keeps the ids of recent words in a table of bounded size.
"""

from __future__ import annotations

import base64
import functools
import json
import os
from itertools import chain

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrowmap import map_arrow, ragged

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN).findall
FOLDER = "/opt/tokenizers"
CACHE = 400_000
CACHED_LENGTH = 48


def _json_bytes() -> dict[str, int]:
    """The printable stand-ins of bytes in JSON vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """{token bytes: id} of a .tiktoken file or of a byte-level .json file (without its special tokens)."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(path, encoding="utf8") as f:
        j = json.load(f)
    to = _json_bytes()
    special = {t["content"] for t in j.get("added_tokens", ()) if t.get("special")}
    return {bytes(to[c] for c in t): i for t, i in j["model"]["vocab"].items() if t not in special}


class _Words(dict):
    """word -> its ids, filled on demand and emptied when it holds CACHE words; long words are never kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encode(word.encode("utf8").decode("latin-1")))
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class ByteBPE:
    """Exact encoder of one byte-level vocabulary whose ids are merge ranks (earlier merges have lower ids)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest_token = max(map(len, self.ranks))
        self.trie = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.trie.add_word(t, i)
        self.parts = functools.cache(self._parts)
        self.shorter = functools.cache(self._shorter)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = _Words(self.encode_word)
        self.find = SPLIT

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, found by the merges of lower rank; None for a single byte."""
        piece = list(self.tokens[token])
        while len(piece) > 2:
            ranked = [(self.ranks.get(a + b, token), k) for k, (a, b) in enumerate(zip(piece, piece[1:]))]
            least, k = min(ranked)
            if least >= token:
                return None
            piece[k : k + 2] = [piece[k] + piece[k + 1]]
        return (self.ranks[piece[0]], self.ranks[piece[1]]) if len(piece) == 2 else None

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        t = self.tokens[token]
        return next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), None)

    def longest(self, s: str, at: int) -> int:
        part = s[at : at + self.longest_token]
        k = self.trie.longest_prefix(part)
        while part[:k] not in self.ranks:
            k -= 1
        return self.ranks[part[:k]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart when they stand side by side.

        Merges are undone from the latest to the earliest on both sides of the border. Whenever the two tokens then at
        the border have a merge that ranks before the one undone last, it would have come first and joined them.
        """
        left, right, before = a, b, float("inf")
        while True:
            whole = self.ranks.get(self.tokens[left] + self.tokens[right])
            if whole is not None and whole < before and self.parts(whole) == (left, right):
                return False
            pl, pr = self.parts(left), self.parts(right)
            if pl and (left > right or not pr):
                before, left = left, pl[1]
            elif pr:
                before, right = right + 1, pr[0]  # of equal merges the one further left comes first
            else:
                return True

    def _fit(self, a: int, b: int) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) >= 8 * CACHE:
                self.fits.clear()
            ok = self.fits[a, b] = self.compatible(a, b)
        return ok

    def encode_word(self, s: str) -> list[int]:
        whole = self.ranks.get(s)
        if whole is not None:
            return [whole]
        out: list[int] = []
        dead: set[int] = set()
        at, n = 0, len(s)
        token: int | None = self.longest(s, 0) if n else None
        while at < n:
            end = at + len(self.tokens[token])
            if end not in dead and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = self.longest(s, at)
                continue
            token = self.shorter(token)
            if token is None:  # nothing starts here: take back the token before
                dead.add(at)
                token = out.pop()
                at -= len(self.tokens[token])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text without special tokens; none for a null or empty one."""
        if not text:
            return np.zeros(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, self.find(text))), np.int32)


@functools.lru_cache(4)
def load(name: str, folder: str = FOLDER) -> ByteBPE:
    """The encoder of a vocabulary by name, once per worker process."""
    path = next(p for e in ("tiktoken", "json") if os.path.exists(p := os.path.join(folder, f"{name}.{e}")))
    return ByteBPE(load_ranks(path))


def encode_texts(df: DataFrame, id_col: str, text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(id_col, ids): each row's token ids; null and empty texts have the empty list, null ids and repeats stay rows."""
    kind = dict(df.dtypes)[id_col]

    def fn(c: dict) -> dict:
        bpe = load(tokenizer, folder)
        ids = [bpe.encode(t) for t in c["text"].to_pylist()]
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return {id_col: c["id"], "ids": ragged(np.concatenate([*ids, np.zeros(0, np.int32)]), offsets, "int32")}

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, f"`{id_col}` {kind}, ids array<int>")
