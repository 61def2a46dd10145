"""Template residue and error pages: trusted patterns, spread to near-duplicates found with partitioned SimHash tables.

A document is cut into lines and sentences. A segment a trusted pattern matches is a seed. Segments, with codes, numbers
and names masked, get a 64-bit SimHash; it is cut into 6 blocks, so two within Hamming distance 3 share 3 blocks and
meet in one of the 20 tables keyed by 3 blocks (32 bits). Pairs from the tables are verified by Hamming distance and by the similarity of their words, and
the seeds' label spreads through the connected components of the verified pairs, until nothing new is labelled.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bitmap
from corpusloom.llm.arrowmap import map_arrow
from corpusloom.llm.components import connected_components
from corpusloom.llm.residue_patterns import LOREM, MESSAGES, SLOTS
from corpusloom.llm.segment_join import _lists
from corpusloom.llm.wordkernel import mix, word_hashes
from corpusloom.session import cut

BLOCKS, RADIUS, SIMILAR_PCT, LEAST_WORDS, LEAST_CJK = 6, 3, 80, 4, 8
TABLES = list(itertools.combinations(range(BLOCKS), BLOCKS - RADIUS))

_CUT = re.compile(r"[\n\r  ]+|(?<=[.!?])\s+|(?<=[。！？])")
_CODE = re.compile(r"`[^`\n]{1,120}`|<code>.{1,200}?</code>", re.S)
_QUOTED = re.compile(r"“[^“”\n]{0,160}”|«[^«»\n]{0,160}»|„[^„“”\n]{0,160}[“”]|\"[^\"\n]{0,160}\"|‘[^‘’\n]{0,160}’|「[^「」\n]{0,160}」|『[^『』\n]{0,160}』")
_MASK = re.compile(r"(?<!\S)(?:\S*?\d\S*|/\S+)")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_TITLE = r"[A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΫА-Я][a-zà-öø-ÿā-žά-ώа-я]\w*"
_NAME = re.compile(rf"(?<=[^\s.!?…]) {_TITLE}(?: {_TITLE})*")
_SLOT_SIGNS = ("{", "}", "<", "[", "$$", "%%", "%(", "@@", "__", "|", "««", "TK TK", "XXX", "undefined")


@functools.lru_cache(1)
def _rules() -> tuple:
    fold = lambda p: "".join(c for c in unicodedata.normalize("NFKD", p) if not unicodedata.combining(c))
    some = r".{0,60}?"
    messages = "|".join(f"(?:{fold(p).replace('{{', '{').replace('}}', '}').replace('{x}', some)})" for p in MESSAGES)
    slots = "|".join(f"(?:{p})" for p in SLOTS)
    alone = re.compile(rf"[“«„\"‘']\s?(?:{slots})\s?[”»“\"’']")
    return re.compile(messages), re.compile(slots), alone, frozenset(LOREM)


def fold(text: str) -> str:
    """Lower case without accents; equal for upper and lower case spellings of one text."""
    text = text.replace("İ", "i").lower().replace("ı", "i")
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def has_slot(text: str) -> bool:
    """Whether a template slot stands in the text outside code quotes; one that is quoted by itself is talked about."""
    _, slots, alone, _ = _rules()
    if not any(x in text for x in _SLOT_SIGNS) or not slots.search(text):
        return False
    return bool(slots.search(alone.sub(" ", _CODE.sub(" ", text))))


def segments(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _CUT.split(text)) if s]


def is_filler(words: list[str]) -> bool:
    lorem = _rules()[3]
    n = len(words)
    return n >= 8 and sum(w.strip(".,;:") in lorem for w in words) >= 0.6 * n


def messages(text: str) -> list[str]:
    """The folded segments, quoted spans left out, that start as a known message or are filler text."""
    match, out = _rules()[0].match, []
    for s in segments(fold(_QUOTED.sub("◌", text))):
        s = s.lstrip(" -–—*•#>|\t")
        if match(s) or (("lorem" in s or "dolor" in s or "ipsum" in s or "veniam" in s or "magna" in s) and is_filler(s.split())):
            out.append(s)
    return out


def masked(text: str) -> str:
    """The folded text without what varies between copies of one template: numbers, codes, paths, inner capitalised names."""
    return fold(_NAME.sub(" ", _MASK.sub("", text)))


def is_cjk(segment: str) -> bool:
    """Whether most of the segment is Chinese or Japanese, where each character is compared as a word."""
    return not segment.isascii() and 2 * len(_CJK.findall(segment)) > len(segment)


def simhash(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each list of word hashes; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    for lo in range(0, len(full), 512):
        at = full[lo : lo + 512]
        a, b = offsets[at[0]], offsets[at[-1] + 1]
        bits = np.unpackbits(hashes[a:b].view(np.uint8)).reshape(-1, 64).astype(np.int32)
        ones = np.add.reduceat(bits, offsets[at] - a, axis=0)
        n = np.diff(offsets)[at]
        out[at] = np.packbits(2 * ones > n[:, None], axis=1).view(np.uint64).ravel()
    return out


def table_keys(sims: np.ndarray) -> np.ndarray:
    """(segments, TABLES) keys: the blocks of the SimHash that a table is keyed by, with its number, hashed."""
    edge = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    kept = [sum(((1 << edge[b + 1]) - (1 << edge[b])) for b in t) for t in TABLES]
    return np.stack([mix(mix(sims & np.uint64(m), 9), i) for i, m in enumerate(kept)], 1)


def _scan(df: DataFrame, id_type: str, bits) -> DataFrame:
    """Without bits: (id, slot, and the seeds' masked segments) of documents with residue. With bits: the segments of
    other documents that share a table key with a labelled one."""

    def fn(c: dict) -> dict:
        rows, segs = [], []
        for i, t in enumerate(c["text"].to_pylist()):
            if "&" in t:
                t = html.unescape(t)
            if bits is None:
                found = messages(t)
                if found:  # once more with names masked, as the other documents' segments are compared
                    found = [s for s in segments(masked(_QUOTED.sub("◌", t))) if _rules()[0].match(s.lstrip(" -–—*•#>|\t"))] or [""]
                elif has_slot(t):
                    found = [""]
                rows.extend([i] * len(found))
                segs.extend(found)
            else:
                found = [s for s in segments(masked(_QUOTED.sub("◌", t)))]
                rows.extend([i] * len(found))
                segs.extend(found)
        cjk = [is_cjk(s) for s in segs]
        h, o = word_hashes(segs, ["zh" if x else None for x in cjk])
        n = np.diff(o)
        sims = simhash(h, o)
        keys = table_keys(sims)
        fit = n >= np.where(cjk, LEAST_CJK, LEAST_WORDS)
        if bits is not None:
            fit &= bitmap.contains(bits.value, keys.ravel()).reshape(keys.shape).any(1)
            keep = np.flatnonzero(fit)
        else:
            keep = np.arange(len(segs))
        return {
            "id": c["id"].take(np.asarray(rows, np.int64)[keep]),
            "fit": fit[keep],
            "sim": sims[keep].view(np.int64),
            "words": _lists([np.unique(h[o[k] : o[k + 1]]) for k in keep]),
            "keys": _lists([keys[k] for k in keep]),
        }

    return map_arrow(df.where("id is not null and text is not null"), fn, f"id {id_type}, fit boolean, sim bigint, words array<bigint>, keys array<bigint>")


def residue_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 60) -> DataFrame:
    """(id_col): documents that are, or hold, template slots, filler text, error messages or script notices.

    Null ids, null and empty texts give no row; repeated ids one. Quoted and code-quoted mentions are no cases.
    """
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seeds = cut(_scan(src, kind, None))
    node = F.xxhash64("words").alias("node")
    flagged = seeds.select("id").distinct()
    label = cut(seeds.where("fit").select(node, "sim", "words", "keys").dropDuplicates(["node"]))
    fresh = label
    for _ in range(most_rounds):
        if fresh.isEmpty():
            break
        bits = bitmap.build(fresh.select(F.explode("keys").alias("k")).distinct(), "k")
        seen = cut(_scan(src, kind, bits).withColumn("node", F.xxhash64("words")))
        nodes = seen.dropDuplicates(["node"]).select("node", "sim", "words", "keys")
        side = lambda d, s: d.select(F.col("node").alias(f"node{s}"), F.col("sim").alias(f"sim{s}"), F.col("words").alias(f"words{s}"), F.explode("keys").alias("k"))
        pairs = side(fresh, "a").join(side(nodes, "b"), "k").where("nodea <> nodeb").where(F.bit_count(F.col("sima").bitwiseXOR(F.col("simb"))) <= RADIUS)
        both = F.size(F.array_intersect("wordsa", "wordsb"))
        edges = cut(pairs.where(both * 100 >= SIMILAR_PCT * (F.size("wordsa") + F.size("wordsb") - both)).select("nodea", "nodeb").distinct())
        roots = connected_components(edges, "nodea", "nodeb")
        known = label.select("node")
        spread = roots.join(roots.join(known, "node", "left_semi").select("root").distinct(), "root", "left_semi").select("node").union(known).distinct()
        flagged = flagged.union(seen.join(spread, "node", "left_semi").select("id")).distinct()
        fresh = cut(nodes.join(spread, "node", "left_semi").join(known, "node", "left_anti"))
        label = cut(label.unionByName(fresh))
    else:
        raise RuntimeError("labels did not settle")
    return flagged.select(F.col("id").alias(id_col))
