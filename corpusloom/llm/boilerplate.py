"""Main content of web pages, by wrappers inferred from pages of one site and of one language.

A page is a stream of line tokens: words that few pages of the language have become text slots, numbers number slots, and lines that then are
equal are one token. The pages of one host and language are aligned one after another with the wrapper found so far, a union-free
regular expression: tokens both have stay, a token that some pages lack becomes optional, one that comes several times in a row
repeated, and what a single page has is a text slot (`align`). Large hosts are cut into chunks that are aligned by themselves; as a wrapper's tokens
come with how often each page's alignment met them, and where (before the headline, between the first and the last paragraph, or after it), chunks
add up in any order. Tokens that stand in the frame are the host's wrapper. The wrapper of a language, which also serves hosts
of few pages, is the tokens that the frames of several hosts share; as no order of lines holds across hosts, these are counted, not aligned.
"""

from __future__ import annotations

import difflib
import functools
import html
import itertools
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpusloom.llm.arrowmap import map_arrow
from corpusloom.session import cut, ship

#: Characters: a paragraph has at least LONG; a line of TEASER or more is no headline of another article.
LONG, TEASER = 110, 240
#: A teaser's lead-in has at most so many words.
LEAD_WORDS = 8
#: A word is text, not a slot, from these shares of the language's pages on: a fine and a coarse reading of each line.
WORD_SHARE, WORD_SHARE_COARSE = 0.004, 0.03
LEAST_PAGES, LONG_SHARE = 3, 0.0005
FRAME_SHARE, HOST_PAGES, HOST_SHARE, SHAPE_SHARE = 0.6, 8, 0.15, 0.02
#: Pages of a host that are aligned together.
CHUNK_PAGES = 64
#: Hosts' wrappers of up to so many tokens in all are sent to the workers; more are joined by host.
MOST_OWN = 1_000_000
#: Lines whose readings a worker keeps: lines of frames recur.
CACHED = 1 << 16
#: Old language codes.
LEGACY = {"in": "id", "iw": "he", "ji": "yi", "mo": "ro", "sh": "sr"}
#: Marks of advertising and interruptions, which stand inside articles and so cannot be told by place.
MARKS = frozenset(
    unicodedata.normalize("NFKC", x).casefold()
    for x in """advertisement|advert|ad|advertising|sponsored|sponsored content|paid content|paid post|promoted|partner content|story continues below|article continues below
continue reading|continue reading below|read more|publicidad|anuncio|contenido patrocinado|patrocinado|continúa leyendo|sigue leyendo|la noticia continúa abajo|publicité|annonce|contenu sponsorisé|sponsorisé
la suite après la publicité|la suite après cette publicité|suite de l'article|anzeige|werbung|gesponsert|gesponserter inhalt|bezahlter inhalt|artikel wird unten fortgesetzt|weiterlesen|pubblicità|annuncio
contenuto sponsorizzato|sponsorizzato|continua a leggere|l'articolo continua sotto|reklam|ilan|sponsorlu içerik|sponsorlu|haberin devamı aşağıda|haberin devamı|iklan|konten bersponsor|advertorial|berita berlanjut di bawah
lanjutkan membaca|scroll untuk melanjutkan|reklama|artykuł sponsorowany|treść sponsorowana|dalsza część artykułu pod reklamą|реклама|спонсорский материал|на правах рекламы|продолжение ниже|διαφήμιση|χορηγούμενο|χορηγούμενο περιεχόμενο
विज्ञापन|प्रायोजित|广告|赞助内容|推广|広告|スポンサー|pr|提供""".replace("\n", "|").split("|")
)

_NUMBER = re.compile(r"\d(?:[\d.,:  ]*\d)?")
_WORD = re.compile(r"[^\W\d_](?:[\w'’\-]*[^\W_])?")
_WORD_CUT = re.compile(rf"({_WORD.pattern})").split
_SLOTS = re.compile(r"◇(?:[ \-]◇)+")
_LEAD = re.compile(r"^\s*(?:(?:\d{1,2}|[ivx]{1,4})[.)]?|[•·▪►▶»›→*–—-]+)\s+")
_TAGS = re.compile(r"^\s*(?:#[\w-]+[\s,;·|]*)+$")
_TRAIL = re.compile(r"\s[»›>/·|•—]\s")
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)|copyright\b)", re.I)


class _All:
    def __contains__(self, word: str) -> bool:
        return True


_ALL = _All()


def key(token: str) -> int:
    """The signed 64-bit hash that stands for a token outside this process."""
    return xxhash.xxh3_64_intdigest(token.encode()) - (1 << 63)


@functools.lru_cache(CACHED)
def plain(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", html.unescape(text or "")).split()).casefold()


def page_lines(text: str) -> list[str]:
    return text.split("\n")


def _cut(line: str) -> tuple[list[str], list[str]]:
    """The line's parts, every second one a word, and its words in lower case."""
    parts = _WORD_CUT(_NUMBER.sub("0", unicodedata.normalize("NFKC", html.unescape(line)).strip()))
    return parts, [w.casefold() for w in parts[1::2]]


def _render(parts: list[str], low: list[str], common) -> str:
    parts[1::2] = [w if w in common else "◇" for w in low]
    return _SLOTS.sub("◇", " ".join("".join(parts).split())).casefold()


@functools.lru_cache(CACHED)
def token(line: str, common: frozenset | _All) -> str:
    """The line with rare words and numbers as slots; runs of slots are one."""
    return _render(*_cut(line), common)


@functools.lru_cache(CACHED)
def readings(line: str, known: tuple) -> tuple[int, int, str]:
    """The keys of the line's token in the fine and, marked, in the coarse reading; "=" if the fine one has no slot, else "~", with its first word."""
    parts, low = _cut(line)
    fine = _render(list(parts), low, known[0])
    first = fine.partition(" ")[0]
    return key(fine), key("~ " + _render(parts, low, known[1])), ("~" if "◇" in fine else "=") + (first if first != "◇" else "")


@functools.lru_cache(CACHED)
def shape(line: str, common: frozenset | set) -> str:
    """The order of slots, known words, numbers and signs of a line."""
    s = _WORD.sub("w", token(line, common).replace("◇", "\0"))
    s = re.sub(r"w(?:[ \-]w)+", "w", s)
    return s.replace("\0", "◇")


def lang_of(row_lang: str | None) -> str:
    x = (row_lang or "").lower()
    return LEGACY.get(x, x)


def headline_at(lines: list[str], headline: str | None) -> int:
    h = plain(headline)
    return next((i for i, x in enumerate(lines) if plain(x) == h), -1) if h else -1


def _rows(c: dict):
    for page, lang, host, head, text in zip(c["id"].to_pylist(), *(c[k].to_pylist() for k in ("lang", "host", "headline", "text"))):
        if text and text.strip():
            yield page, lang_of(lang), host or "", head, page_lines(text)


def _counted(counts: Counter, names: list[str]) -> dict:
    keys = list(counts)
    out = {n: [k[i] for k in keys] for i, n in enumerate(names)}
    return out | {"n": np.fromiter((counts[k] for k in keys), np.int64, len(keys))}


def _known(spark, rows) -> object:
    """Broadcast {lang: frozenset of values}; the callers bound the number of values by a share of the pages."""
    d = defaultdict(set)
    for lang, value in rows:
        d[lang].add(value)
    return spark.sparkContext.broadcast({k: frozenset(v) for k, v in d.items()})


def _is_long(line: str) -> bool:
    return len(line) >= LONG and not _RIGHTS.match(line)


def zones(lines: list[str], tokens: list[tuple[str, str]], head: int, frame_long: set) -> str:
    """For each line one of: H before the headline, h the headline, M up to the last paragraph, T after it, - blank."""
    last = max((i for i, x in enumerate(lines) if i > head and _is_long(x) and not frame_long.intersection(tokens[i])), default=None)
    out = []
    for i, x in enumerate(lines):
        if not x.strip():
            out.append("-")
        elif head >= 0 and i <= head:
            out.append("h" if i == head else "H")
        elif last is None:
            out.append("?")
        else:
            out.append("M" if i <= last else "T")
    return "".join(out)


class Node:
    """A token of a wrapper: in how many pages' alignments it was met in each zone, and whether some pages lack or repeat it."""

    __slots__ = ("token", "at", "optional", "repeated")

    def __init__(self, token: int, optional: bool):
        self.token, self.at, self.optional, self.repeated = token, dict.fromkeys("HMT", 0), optional, False

    def meet(self, zone: str, times: int) -> None:
        self.at[zone] += 1
        self.repeated |= times > 1


def align(pages: list[tuple[list[int], str]]) -> list[Node]:
    """The wrapper of some pages, given as tokens and their zones: pages are aligned in turn with what the pages before gave.

    Tokens of a single page are text slots and left out first. A run of one token is a repeated group. Where a page and the wrapper differ, the wrapper's
    tokens become optional and the page's are added as optional ones. Nodes met once only are no part of the result.
    """
    in_pages = Counter(t for tokens, _ in pages for t in set(tokens))
    wrapper: list[Node] = []
    for number, (tokens, place) in enumerate(pages):
        runs = [(t, z, len(list(g))) for (t, z), g in itertools.groupby(zip(tokens, place)) if in_pages[t] > 1]
        new: list[Node] = []
        for what, i, j, k, m in difflib.SequenceMatcher(None, [n.token for n in wrapper], [r[0] for r in runs], autojunk=False).get_opcodes():
            for node in wrapper[i:j]:
                node.optional |= what != "equal"
            new += wrapper[i:j]
            added = wrapper[i:j] if what == "equal" else [Node(r[0], number > 0) for r in runs[k:m]]
            new += [] if what == "equal" else added
            for node, (_, zone, times) in zip(added, runs[k:m]):
                node.meet(zone, times)
        wrapper = new
    return [n for n in wrapper if sum(n.at.values()) > 1]


def boilerplate_lines(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, line_no): the lines that are not blank and not part of the article; lines count from 1, blank ones included.

    Needs the columns lang, domain, headline and text. Null ids and null or blank texts give no row; of rows that repeat an id
    one counts. A page without its headline in the text, or with none given, takes the first line shaped as the
    language's headlines are above its first paragraph; without such a line it is judged by the wrapper alone. A page whose language has too few
    pages to infer a wrapper from keeps all lines but tags, rights and marks of advertising and those above its headline.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    ship(spark)
    src = pages.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("id"), "lang", F.col("domain").alias("host"), "headline", "text")
    one = src.groupBy("id").agg(F.min(F.struct("text", "lang", "host", "headline")).alias("r"))
    src = cut(one.select("id", "r.lang", "r.host", "r.headline", "r.text"))

    def words(c: dict) -> dict:
        n: Counter = Counter()
        for _, lang, _, _, lines in _rows(c):
            n[lang, ""] += 1
            n.update({(lang, w) for x in lines for w in (m.casefold() for m in _WORD.findall(unicodedata.normalize("NFKC", html.unescape(x))))})
        return _counted(n, ["lang", "word"])

    df = map_arrow(src, words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    df = cut(df)
    total = df.where("word = ''").select("lang", F.col("n").alias("pages"))
    langs = {r.lang: r.pages for r in total.collect()}  # one row per language code
    vocab = df.where("word <> ''").join(F.broadcast(total), "lang").where(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * WORD_SHARE))
    rows = vocab.select("lang", "word", (F.col("n") >= F.col("pages") * WORD_SHARE_COARSE).alias("coarse")).collect()  # at most words a page / WORD_SHARE a language
    fine, coarse = _known(spark, ((r.lang, r.word) for r in rows)), _known(spark, ((r.lang, r.word) for r in rows if r.coarse))
    none = frozenset()
    common = lambda lang: (fine.value.get(lang, none), coarse.value.get(lang, none))

    def long_lines(c: dict) -> dict:
        n: Counter = Counter()
        for _, lang, _, head, lines in _rows(c):
            known = common(lang)
            n.update({(lang, t, None) for x in lines if _is_long(x) for t in readings(x, known)[:2]})
            if head and head.strip():
                n[lang, 0, shape(head, known[0])] += 1
        return _counted(n, ["lang", "token", "shape"])

    seen = map_arrow(src, long_lines, "lang string, token bigint, shape string, n bigint").groupBy("lang", "token", "shape").agg(F.sum("n").alias("n")).join(F.broadcast(total), "lang")
    least = F.greatest(F.lit(LEAST_PAGES), F.col("pages") * F.when(F.col("shape").isNull(), LONG_SHARE).otherwise(SHAPE_SHARE))
    seen = seen.where(F.col("n") >= least).select("lang", "token", "shape").collect()  # at most lines a page / LONG_SHARE a language
    frame_long = _known(spark, ((r.lang, r.token) for r in seen if r["shape"] is None))
    shapes = _known(spark, ((r.lang, r["shape"]) for r in seen if r["shape"] and re.search(r"[^\w\s◇]", r["shape"])))

    def places(c: dict) -> dict:
        n: Counter = Counter()
        for _, lang, host, head, lines in _rows(c):
            known = common(lang)
            tokens = [readings(x, known) for x in lines]
            z = zones(lines, tokens, headline_at(lines, head), frame_long.value.get(lang, frozenset()))
            n.update({(lang, host, t, m, p) for (a, b, mark), p in zip(tokens, z) if p in "HMT" for t, m in ((a, mark), (b, None))})
        return _counted(n, ["lang", "host", "token", "mark", "place"])

    at = map_arrow(src, places, "lang string, host string, token bigint, mark string, place string, n bigint")
    at = cut(at.groupBy("lang", "host", "token", "mark").agg(*[F.sum(F.when(F.col("place") == z, F.col("n")).otherwise(0)).alias(z) for z in "HMT"]))
    frame = (F.col("H") + F.col("T")) >= FRAME_SHARE * (F.col("H") + F.col("M") + F.col("T"))
    often = F.col("H") + F.col("T")
    by_lang = at.groupBy("lang", "token", "mark").agg(*[F.sum(z).alias(z) for z in "HMT"], F.count_distinct("host").alias("hosts")).join(F.broadcast(total), "lang")
    by_lang = by_lang.where(frame & (often >= F.greatest(F.lit(4), F.col("pages") * LONG_SHARE)) & (F.col("hosts") > 1)).select("lang", "token", "mark")
    rows = by_lang.collect()  # at most lines a page / LONG_SHARE a language
    wrapper = _known(spark, ((r.lang, r.token) for r in rows))

    starts = _known(spark, ((r.lang, r.mark[1:]) for r in rows if r.mark and r.mark[1:]))
    literal = _known(spark, (("", r.token) for r in rows if r.mark and r.mark[0] == "="))
    code = F.lower(F.coalesce("lang", F.lit("")))
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv]), code), code)
    src = src.withColumn("code", code)
    size = src.groupBy(F.col("code").alias("lang"), "host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= HOST_PAGES)
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("host_pages") / CHUNK_PAGES)).cast("int")
    part = src.withColumnRenamed("lang", "raw").join(size.withColumnRenamed("lang", "code"), ["code", "host"]).select("id", F.col("raw").alias("lang"), "host", "headline", "text", chunk.alias("chunk"), "host_pages")

    def streams(c: dict) -> dict:
        keys = {k: v for k, v in zip(c["id"].to_pylist(), zip(c["chunk"].to_pylist(), c["host_pages"].to_pylist()))}
        out: dict[str, list] = {k: [] for k in ("lang", "host", "chunk", "host_pages", "tokens", "zones")}
        for page, lang, host, head, lines in _rows(c):
            known = common(lang)
            tokens = [readings(x, known) for x in lines]
            z = zones(lines, tokens, headline_at(lines, head), frame_long.value.get(lang, none))
            at = [i for i, p in enumerate(z) if p in "HMT"]
            for k, v in zip(out, (lang, host, *keys[page], [tokens[i][0] for i in at], "".join(z[i] for i in at))):
                out[k].append(v)
        return out

    def aligned(t: pa.Table) -> pa.Table:
        found = align(list(zip(t["tokens"].to_pylist(), t["zones"].to_pylist())))
        one = lambda k: [t[k][0].as_py()] * len(found)
        columns = {"lang": one("lang"), "host": one("host"), "host_pages": one("host_pages"), "token": [n.token for n in found]} | {z: [n.at[z] for n in found] for z in "HMT"}
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in to}, schema=to)

    nodes = "lang string, host string, host_pages bigint, token bigint, H bigint, M bigint, T bigint"
    to = to_arrow_schema(_parse_datatype_string(nodes))
    paged = map_arrow(part, streams, "lang string, host string, chunk int, host_pages bigint, tokens array<bigint>, zones string")
    by_host = paged.groupBy("lang", "host", "chunk").applyInArrow(aligned, nodes).groupBy("lang", "host", "host_pages", "token").agg(*[F.sum(z).alias(z) for z in "HMT"])
    by_host = by_host.where(frame & (often >= F.greatest(F.lit(LEAST_PAGES), HOST_SHARE * F.col("host_pages"))))
    by_host = cut(by_host.groupBy(F.col("lang").alias("code"), "host").agg(F.collect_list("token").alias("own")))  # at most lines a page / HOST_SHARE
    few = by_host.limit(MOST_OWN + 1).withColumn("size", F.size("own"))
    sent = None
    if (few.agg(F.sum("size")).first()[0] or 0) <= MOST_OWN:
        sent = spark.sparkContext.broadcast({(r.code, r.host): frozenset(r.own) for r in by_host.collect()})
        with_own = src.withColumn("own", F.lit(None).cast("array<bigint>"))
    else:
        with_own = src.join(by_host, ["code", "host"], "left")

    def classify(c: dict) -> dict:
        ids, nos = [], []
        plain_lines = literal.value.get("", none)
        own = sent.value if sent else {k: frozenset(o) for k, o in zip(zip(c["code"].to_pylist(), c["host"].to_pylist()), c["own"].to_pylist()) if o}
        for page, lang, host, head, lines in _rows(c):
            known = common(lang)
            wrap = wrapper.value.get(lang, none), own.get((lang, host), none), plain_lines, starts.value.get(lang, none)
            for i in removed(lines, head, known, wrap, frame_long.value.get(lang, none), shapes.value.get(lang, none)):
                ids.append(page)
                nos.append(i + 1)
        return {id_col: ids, "line_no": np.asarray(nos, np.int32)}

    return map_arrow(with_own.select("id", "lang", "host", "headline", "text", "code", "own"), classify, f"`{id_col}` {kind}, line_no int")


def removed(lines: list[str], headline: str | None, known, wrapper: tuple, frame_long, shapes) -> list[int]:
    """Places of the lines of one page to remove."""
    head = headline_at(lines, headline)
    tokens = [readings(x, known) for x in lines]
    if head < 0:  # the first line shaped like a headline above the first paragraph
        for i, x in enumerate(lines):
            if _is_long(x) and not frame_long.intersection(tokens[i]):
                break
            if x.strip() and shape(x, known[0]) in shapes:
                head, headline = i, x
                break
    z = zones(lines, tokens, head, frame_long)
    own = plain(headline)
    general, special, literal, starts = wrapper
    fine = known[0]
    in_frame = lambda x: bool(general.intersection(readings(x, known))) or key(token(x, _ALL)) in literal
    out, tail = [], False
    for i, x in enumerate(lines):
        if z[i] in "-h":
            continue
        if z[i] == "H":
            out.append(i)
            continue
        framed = in_frame(x) or bool(special.intersection(tokens[i]))
        bare = _LEAD.sub("", x)
        gone = framed or bool(_TAGS.match(x)) or bool(_RIGHTS.match(x)) or plain(x).strip(" .:…-–—[]()") in MARKS or (bare != x and in_frame(bare))
        if not gone and len(x) < TEASER and plain(bare) != own:
            parts = [k for k in _TRAIL.split(x) if k.strip()]
            gone = shape(bare, fine) in shapes or len(parts) > 1 and all(plain(k) == own or in_frame(k.strip()) for k in parts)
            if not gone:  # a teaser's lead-in and its headline on one line
                cuts = itertools.islice((m.start() for m in re.finditer(r"(?<=[\w:])\s", x)), LEAD_WORDS) if plain(x).partition(" ")[0] in starts else ()
                gone = any((in_frame(x[:k]) or in_frame(x[:k].rstrip(":") + ":")) and shape(x[k + 1 :], fine) in shapes for k in cuts)
        if z[i] == "T" and framed:
            tail = True
        if gone or (tail and z[i] == "T" and not _is_long(x)):
            out.append(i)
    return out
