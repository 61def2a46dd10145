"""Free-entered values brought to a reference list by a symmetric-delete dictionary.

Every form of the reference list is stored under each string got by deleting up to its distance bound of characters
(SymSpell). A value's own deletes meet it there if their Damerau-Levenshtein distance is within the bound; candidates
are ranked by weighted distance, then by the frequency of the entry. As words may stand in any order, what is indexed are
the first letters of a name in sorted order, which no order of its words changes. The dictionary is broadcast in blocks of bounded size.
"""

from __future__ import annotations

import functools
import html
import itertools
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrowmap import map_arrow
from corpusloom.session import ship

UNMATCHED = "(unmatched)"
#: The forms of a block of the dictionary; a longer list is looked up block by block.
MOST_FORMS = 20_000
#: Sorted letters of a form that its deletes are made of.
PREFIX = 10
PER_SLIP = 7
#: Words that join two names and words that name no subject.
JOINERS = frozenset("and e ed y et und ve dan en i και и及 和 与 與 と the of".split())
GENERIC = frozenset(
    "news latest all top home homepage page section sections category categories topic tag archive breaking more rubric channel desk "
    "noticias noticia seccion categoria inicio portada ultimas nachrichten startseite rubrik kategorie aktuell "
    "actualites actualite rubrique accueil notizie sezione ultime haber haberler haberleri anasayfa kategori son berita terbaru beranda rubrik "
    "wiadomosci strona dzial kategoria новости раздел рубрика главная νεα ειδησεις κατηγορια समाचार ताजा 新闻 新聞 首页 栏目 频道 ニュース トップ 最新".split()
)


@functools.lru_cache(100_000)
def normal_words(name: str) -> tuple[str, ...]:
    """Words without case, accents, width, entities and punctuation; joining words and signs are left out."""
    s = name
    for _ in range(2):
        s = html.unescape(s)
    s = s.replace("&", " and ").replace("+", " and ")
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).replace("İ", "i").lower().replace("ı", "i").replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe"))
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = "".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else "" if c in "'’" else " " for c in s)
    return tuple(s.replace("ς", "σ").split())


def _plain(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w for w in words if w not in JOINERS) or words


def deletes(s: str, most: int) -> set[str]:
    """Every string got by deleting up to `most` characters."""
    out, edge = {s}, {s}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))} - out
        out |= edge
    return out


def weighted_distance(a: str, b: str, bound: int) -> tuple[int, float]:
    """(edits, weighted edits) of the optimal-alignment Damerau-Levenshtein distance; (bound + 1, inf) beyond it.

    A swap of neighbours or a doubled letter is a likelier slip than another change and weighs less.
    """
    if abs(len(a) - len(b)) > bound:
        return bound + 1, float("inf")
    two, one = None, [(j, float(j)) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            best = (one[j - 1][0], one[j - 1][1]) if x == y else (one[j - 1][0] + 1, one[j - 1][1] + 1.0)
            drop = 0.7 if i > 1 and a[i - 2] == x else 1.0
            add = 0.7 if j > 1 and b[j - 2] == y else 1.0
            best = min(best, (one[j][0] + 1, one[j][1] + drop), (row[-1][0] + 1, row[-1][1] + add))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, (two[j - 2][0] + 1, two[j - 2][1] + 0.6))
            row.append(best)
        if min(r[0] for r in row) > bound:
            return bound + 1, float("inf")
        two, one = one, row
    return one[-1] if one[-1][0] <= bound else (bound + 1, float("inf"))


class Dictionary:
    """Symmetric-delete index of (form, entry, frequency); an entry of None marks a form that must not be mapped.

    A form is stored without spaces, with and without its joining words; its bound is one slip for every `per_slip` of its characters
    as written. Within k slips, at most k letters of either name are not in the other, whatever the order of the words, so the sorted letters of both, or any
    prefix of them, meet in a string with at most k deleted from each.
    """

    def __init__(self, forms: list[tuple[str, str | None, int]], per_slip: int = PER_SLIP):
        self.forms: list[tuple[str, str | None, int, int]] = []
        self.index: dict[str, list[int]] = defaultdict(list)
        for form, entry, often in forms:
            words = normal_words(form)
            for text in dict.fromkeys(("".join(words), "".join(_plain(words)))):
                if text:
                    bound = len(form.strip()) // per_slip
                    for d in deletes("".join(sorted(text))[:PREFIX], bound):
                        self.index[d].append(len(self.forms))
                    self.forms.append((text, entry, often, bound))
        self.most = max((f[3] for f in self.forms), default=0)
        self.exact: dict[str, tuple] = {}
        for text, entry, often, _ in self.forms:
            found = (0.0, 0, -often, entry is not None, entry or "")
            self.exact[text] = min(found, self.exact.get(text, found))
        self.letters = [Counter(f[0]) for f in self.forms]
        self.known = functools.lru_cache(200_000)(self._lookup)

    def _near(self, text: str) -> list[int]:
        """Forms that some order of this text's words may be within the bound of."""
        own, out = Counter(text), []
        for k in {k for d in deletes("".join(sorted(text))[:PREFIX], self.most) for k in self.index.get(d, ())}:
            form, _, _, bound = self.forms[k]
            if abs(len(form) - len(text)) <= bound and (own - self.letters[k]).total() <= bound and (self.letters[k] - own).total() <= bound:
                out.append(k)
        return out

    def _candidates(self, text: str, near: list[int]) -> list[tuple]:
        out = []
        for k in near:
            form, entry, often, bound = self.forms[k]
            edits, weight = weighted_distance(text, form, bound)
            if edits <= bound:
                out.append((weight, edits, -often, entry is not None, entry or ""))
        return out

    def _word_sets(self, name: str) -> list[tuple[str, ...]]:
        """The words with any of the words that name no subject left out, each with and without joining words."""
        words = normal_words(name)
        generic = [k for k, w in enumerate(words) if w in GENERIC]
        if len(generic) > MOST_ORDERED:  # many generic words: none, any one, or all of them are left out
            few = [(), *((k,) for k in generic), tuple(generic)]
        else:
            few = [c for n in range(len(generic) + 1) for c in itertools.combinations(generic, n)]
        out: dict[tuple[str, ...], None] = {}
        for gone in few:
            kept = tuple(w for k, w in enumerate(words) if k not in gone)
            if kept:
                out[kept] = out[_plain(kept)] = None
        return list(out)

    def _lookup(self, name: str | None) -> tuple | None:
        tries = []
        for words in self._word_sets(name) if name else ():
            near = self._near("".join(words))
            if near:
                tries.append((words, near))
        best = min((self.exact[t] for words, near in tries for t in orders(words, [self.forms[k][0] for k in near]) if t in self.exact), default=None)  # nothing is closer
        if best is None:
            best = min((c for words, near in tries for t in orders(words, [self.forms[k][0] for k in near]) for c in self._candidates(t, near)), default=None)
        return best

    def rank(self, name: str | None) -> tuple | None:
        """(weighted edits, edits, minus frequency, whether it may be mapped, entry) of the closest form; None for no match."""
        return self.known(name)

    def lookup(self, name: str | None) -> str | None:
        """The closest entry; None for no match, a null or blank name, or a form that must not be mapped."""
        best = self.known(name)
        return (best[4] or None) if best else None


#: Names of up to so many words are tried in all orders.
MOST_ORDERED = 5


def orders(words: tuple[str, ...], forms: list[str]) -> set[str]:
    """The words joined in the orders that are tried: all of a few; of more their own, the sorted one, and the orders their places in a form suggest."""
    if len(words) <= MOST_ORDERED:
        return {"".join(p) for p in itertools.permutations(words)}
    out = {"".join(words), "".join(sorted(words))}
    for f in forms:
        at = [f.find(w) for w in words]
        for w, k in zip(words, range(len(words))):  # a misspelt word goes where the form has room for it
            if at[k] < 0:
                at[k] = next((f.find(w[j : j + 3]) - j for j in range(max(len(w) - 2, 0)) if w[j : j + 3] in f), len(f))
        out.add("".join(w for _, w in sorted(zip(at, words), key=lambda x: x[0])))
    return out


def reference_forms(mapping: DataFrame, glosses: DataFrame) -> DataFrame:
    """(form, entry, often) of a mapping table (label, section_names) and its glosses; entry is null for ambiguous names.

    `often` is in how many rows of the reference an entry stands.
    """
    entries = mapping.select("label", F.explode(F.split("section_names", r";\s+")).alias("entry")).select(F.when(~F.col("label").startswith("("), F.trim("entry")).alias("to"), F.trim("entry").alias("entry")).where("entry <> ''")
    counted = entries.groupBy("entry").agg(F.min("to").alias("to"), F.count(F.lit(1)).alias("often"))
    second = glosses.where("gloss_en is not null and section_name is not null").select(F.trim("section_name").alias("entry"), F.col("gloss_en").alias("form"))
    return counted.select(F.col("entry").alias("form"), F.col("to").alias("entry"), "often").union(second.join(counted, "entry").select("form", "to", "often"))


def map_values(values: DataFrame, forms: DataFrame, id_col: str, name_col: str, per_slip: int = PER_SLIP, most_forms: int = MOST_FORMS) -> DataFrame:
    """(id_col, entry) of each distinct id whose name is neither null nor blank; '(unmatched)' where nothing fits.

    One slip for every `per_slip` characters of the form is forgiven. An id with several names takes the first of
    them in order; a null id gives no row. Equal names are looked up once. An empty reference matches nothing.
    """
    spark = values.sparkSession
    ship(spark)
    kind = dict(values.dtypes)[id_col]
    blank = F.regexp_replace(F.col(name_col), r"(?U)[\s​﻿]+", "") == ""
    ids = values.where(F.col(name_col).isNotNull() & ~blank & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(name_col).alias("name"))
    blocks = max(-(-forms.count() // most_forms), 1)
    forms = forms.select("form", "entry", "often", F.pmod(F.xxhash64("form"), F.lit(blocks)).alias("block"))

    def looked_up(block: int) -> DataFrame:
        rows = forms.where(F.col("block") == block).collect()  # about MOST_FORMS
        sent = spark.sparkContext.broadcast(sorted(((r[0], r[1], r[2]) for r in rows), key=repr))

        def fn(c: dict) -> dict:
            found = [_dictionary(sent, per_slip).rank(x) for x in c["name"].to_pylist()]
            columns = {k: pa.array([None if r is None else r[i] for r in found], t) for i, (k, t) in enumerate((("weight", pa.float64()), ("edits", pa.int32()), ("rare", pa.int64()), ("mapped", pa.bool_()), ("entry", pa.string())))}
            return {"name": c["name"]} | columns

        return map_arrow(names, fn, "name string, weight double, edits int, rare bigint, mapped boolean, entry string")

    # few bytes but much work a row: spread by a number of partitions of its own, so that the planner neither takes the
    # step for a repetition of the shuffle before nor merges its partitions
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    names = ids.select("name").distinct().repartition(spread, "name")
    best = functools.reduce(DataFrame.union, map(looked_up, range(blocks)))
    if blocks > 1:
        best = best.where("weight is not null").groupBy("name").agg(F.min(F.struct("weight", "edits", "rare", "mapped", "entry")).alias("b")).select("name", "b.*")
    entry = F.coalesce(F.nullif("entry", F.lit("")), F.lit(UNMATCHED))
    return ids.join(best.select("name", "entry"), "name", "left").select(F.col("id").cast(kind).alias(id_col), entry.alias("entry"))


_built: dict[tuple, Dictionary] = {}


def _dictionary(sent, per_slip: int) -> Dictionary:
    key = (hash(tuple(sent.value)), per_slip)
    if key not in _built:
        _built.clear()
        _built[key] = Dictionary(sent.value, per_slip)
    return _built[key]
