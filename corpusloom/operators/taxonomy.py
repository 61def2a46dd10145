"""Mapping section names to labels: normaliser, lookup with language overrides, article labels, validation and tree paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: The 17 labels, their id is their place.
LABELS = [
    "arts, culture, entertainment and media", "conflict, war and peace", "crime, law and justice", "disaster, accident and emergency incident",
    "economy, business and finance", "education", "environment", "health", "human interest", "labour", "lifestyle and leisure", "politics",
    "religion", "science and technology", "society", "sport", "weather",
]
#: Affixes that leave a name's subject as it is, applied to normalised names.
AFFIX = r"(latest |top |breaking |berita |noticias de |news |haberleri$|haber$|news$|berita$| news| nachrichten| новости|^новости |^اخبار |^أخبار )"
#: Names whose articles are rejected whatever else they map to.
REJECT_TERMS = (
    "राशिफल", "ज्योतिष", "अंक ज्योतिष", "वास्तु", "horoscope", "horoscopes", "horóscopo", "horoscopo", "oroscopo", "horoskop", "burç", "burçlar", "гороскоп", "гороскопы",
    "astrology", "astrología", "astrologia", "tarot", "zodiac", "zodiak", "ramalan", "星座", "占星", "الأبراج", "abraj", "astro",
)
MOST_CHARS = 40
#: Signs that count as spaces, and what is cut from both ends of a name.
SPACES, TRIMMED = r"[\"“”«»()\[\]|/\\]+", r"^[ \-–—:·.,]+|[ \-–—:·.,]+$"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(name: Column) -> Column:
    """Unicode NFKC, which has no built-in: a vectorised UDF."""
    return F.pandas_udf(_nfkc, "string")(name)


def normalise_ascii(name: Column | str) -> Column:
    """normalise() for names that are in NFKC already; stays in the JVM."""
    s = F.col(name) if isinstance(name, str) else name
    s = F.trim(F.lower(s))
    s = F.replace(F.replace(s, F.lit("&amp;"), F.lit("&")), F.lit("’"), F.lit("'"))
    s = F.regexp_replace(s, SPACES, " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), TRIMMED, "")
    return F.replace(s, F.lit("̇"), F.lit(""))


def normalise(name: Column | str) -> Column:
    """NFKC, lower case, entities and quotes replaced, brackets and slashes as spaces, trimmed of spaces and joining signs."""
    return normalise_ascii(nfkc(F.col(name) if isinstance(name, str) else name))


def term_table(mapping: DataFrame) -> DataFrame:
    """(label, node, term) of a mapping table; rows whose label starts with '(' have a null label: ambiguous terms."""
    t = mapping.select("label", F.col("iptc_node_id").alias("node"), F.explode(F.split("section_names", r";\s+")).alias("term"))
    return t.select(F.when(~F.startswith("label", F.lit("(")), F.col("label")).alias("label"), "node", F.trim("term").alias("term"))


def map_sections(df: DataFrame, terms: DataFrame, overrides: DataFrame | None, name: str, lang: str, normalised: bool = False) -> DataFrame:
    """Adds label. Names over 40 characters map to none; an override of the language decides, also if it is null; else the exact
    term; else the exact term of the name without affixes. Null names map to none. `terms` and `overrides` are taxonomies
    of bounded size and are broadcast."""
    s = F.col(name) if normalised else normalise(name)
    d = df.withColumn("_s", F.when(F.length(s).between(1, MOST_CHARS), s))
    d = d.withColumn("_a", F.trim(F.regexp_replace("_s", AFFIX, " ")))
    known = F.broadcast(terms.where("label is not null").groupBy("term").agg(F.min("label").alias("label")))
    d = d.join(known.toDF("_s", "_exact"), "_s", "left").join(known.toDF("_a", "_affix"), "_a", "left")
    label = F.coalesce("_exact", F.when(F.col("_a") != F.col("_s"), F.col("_affix")))
    if overrides is not None:
        o = F.broadcast(overrides.select(F.col("lang").alias(lang), F.col("term").alias("_s"), F.col("label").alias("_o"), F.lit(True).alias("_has")))
        d = d.join(o, [lang, "_s"], "left")
        label = F.when(F.col("_has"), F.col("_o")).otherwise(label)
    return d.withColumn("label", label).select(*df.columns, "label")


def label_articles(df: DataFrame, terms: DataFrame, id_col: str, sections: str, breadcrumb: str, lang: str, overrides: DataFrame | None = None) -> DataFrame:
    """(id_col, label, reason): rejected_term first (in every breadcrumb element), then unmapped, then conflict, else the one label, from section or breadcrumb.

    The first breadcrumb element, the home page, is not mapped. Null and empty lists give unmapped.
    """
    empty = F.array().cast("array<string>")
    sec, crumb = F.coalesce(F.col(sections), empty), F.coalesce(F.col(breadcrumb), empty)
    named = df.select(id_col, F.col(lang).alias("lang"), F.explode_outer(F.concat(F.transform(sec, lambda x: F.struct(x.alias("name"), F.lit(True).alias("use"), F.lit(True).alias("sec"))), F.transform(crumb, lambda x, i: F.struct(x.alias("name"), (i > 0).alias("use"), F.lit(False).alias("sec"))))).alias("x"))
    named = named.select(id_col, "lang", "x.name", F.coalesce("x.use", F.lit(False)).alias("use"), F.coalesce("x.sec", F.lit(False)).alias("sec"))
    m = map_sections(named, terms, overrides, "name", "lang").withColumn("reject", F.coalesce(normalise("name").isin(*REJECT_TERMS), F.lit(False)))
    g = m.groupBy(id_col).agg(F.bool_or("reject").alias("reject"), F.array_sort(F.collect_set(F.when(F.col("use"), F.col("label")))).alias("labels"), F.coalesce(F.bool_or(F.col("sec") & F.col("label").isNotNull()), F.lit(False)).alias("by_section"))
    reason = F.when(F.col("reject"), "rejected_term").when(F.size("labels") == 0, "unmapped").when(F.size("labels") > 1, "conflict").when(F.col("by_section"), "section").otherwise("breadcrumb")
    return g.select(id_col, F.when(reason.isin("section", "breadcrumb"), F.try_element_at("labels", F.lit(1))).alias("label"), reason.alias("reason"))


def validate_terms(terms: DataFrame, nodes: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """(problem, term): terms mapped to two labels, ambiguous terms that are mapped, terms not in normal form. Empty if all is well.

    With `nodes` (id, name, parent, top_name, retired) also mapped nodes that are missing or retired and, with `tops` (label, top_name), those
    under another top node than their label's; the node's id then stands for the term.
    """
    t = terms.withColumn("s", normalise("term"))
    twice = t.where("label is not null").groupBy("term").agg(F.count_distinct("label").alias("n")).where("n > 1").select(F.lit("mapped twice").alias("problem"), "term")
    ambiguous = t.where("label is null").select("term").join(t.where("label is not null").select("term"), "term", "left_semi").distinct().select(F.lit("ambiguous and mapped").alias("problem"), "term")
    rough = t.where("s <> term").select(F.lit("not normalised").alias("problem"), "term").distinct()
    out = twice.union(ambiguous).union(rough)
    if nodes is None:
        return out
    used = terms.where("label is not null and node is not null").select("label", "node").distinct()
    live = nodes.where("not coalesce(retired, false)").select(F.col("id").cast("string").alias("node"), "top_name")
    out = out.union(used.join(live, "node", "left_anti").select(F.lit("node missing or retired"), F.col("node").cast("string")).distinct())
    if tops is not None:
        other = used.join(live, "node").join(tops.toDF("label", "wanted"), "label").where("top_name is distinct from wanted")
        out = out.union(other.select(F.lit("node under another top"), F.col("node").cast("string")).distinct())
    return out


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, depth): names from the root to each node of (id, name, parent), joined by ' > '. Roots have a null parent.

    As deep as the tree goes. Nodes that no root leads to, such as those of a cycle, have no path; taxonomies have bounded size, so each
    level is a step of its own, written so that plans stay short.
    """
    nodes = cut(nodes.select("id", "name", "parent"))
    level = cut(nodes.where("parent is null").select("id", F.col("name").alias("path"), F.lit(1).alias("depth")))
    out, rest, d = level, nodes.where("parent is not null"), 1
    while not level.isEmpty():
        d += 1
        level = cut(rest.join(level.select(F.col("id").alias("parent"), F.col("path").alias("up")), "parent").select("id", F.concat_ws(" > ", "up", "name").alias("path"), F.lit(d).alias("depth")))
        out = out.union(level)
    return out
