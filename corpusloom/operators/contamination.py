"""N-gram contamination of documents by a reference text collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import char_tokens, is_no_space, tokens
from corpusloom.session import cut


#: Distinct grams that are broadcast: 8 bytes each, about 100 MB as a hash relation.
MOST_BROADCAST = 4_000_000


def grams(df: DataFrame, id_col: str, text: str = "text", lang: str = "lang", n: int = 8, n_chars: int = 16) -> DataFrame:
    """(id_col, gram): distinct word n-grams, or character n-grams of languages without spaces, as 64-bit hashes.

    Texts shorter than n have none.
    """
    chars = is_no_space(lang)
    t = df.select(id_col, F.when(chars, char_tokens(text)).otherwise(tokens(text)).alias("t"), F.when(chars, n_chars).otherwise(n).alias("n"))
    count = F.coalesce(F.size("t"), F.lit(0)) - F.col("n") + 1
    g = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice("t", i, F.col("n")), " ")))
    return t.where(count > 0).select(id_col, F.explode(F.array_distinct(g)).alias("gram"))


def overlap(docs: DataFrame, reference: DataFrame, id_col: str, ref_id: str, text: str = "text", lang: str = "lang", n: int = 8, n_chars: int = 16) -> DataFrame:
    """(id_col, n_grams, overlap): share of a document's distinct n-grams that the reference has; 0 for shorter texts.

    Up to MOST_BROADCAST distinct grams of the reference are sent to the documents, whose grams then never leave their task; more are joined by
    gram. Null texts have overlap 0.
    """
    seen = cut(grams(reference, ref_id, text, lang, n, n_chars).select("gram").distinct()).withColumn("hit", F.lit(1))
    if seen.count() <= MOST_BROADCAST:
        seen = F.broadcast(seen)
    g = grams(docs, id_col, text, lang, n, n_chars).join(seen, "gram", "left").groupBy(id_col).agg(F.count(F.lit(1)).alias("n_grams"), F.count("hit").alias("hits"))
    out = docs.select(id_col).join(g, id_col, "left")
    return out.select(id_col, F.coalesce("n_grams", F.lit(0)).alias("n_grams"), F.coalesce(F.col("hits") / F.col("n_grams"), F.lit(0.0)).alias("overlap"))
