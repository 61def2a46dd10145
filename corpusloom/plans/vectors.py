"""Token tables, logits and document vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import vectors as vc
from corpusloom.plans.base import TOKENS, Registry, hash_int, r6, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
A = "a as (select distinct article_id, split, list_transform(teacher_logits, lambda v: v::double) as v from articles where teacher_logits is not null)"
TT = f"tok as (select doc_id, lang, unnest({TOKENS.format('text')}) as token from documents where text is not null)"
#: A token table of 4 columns of whole numbers, whose sums are exact, made from hashes of the token; 9 in 10 tokens have a row.
ROW = "[" + ", ".join(f"(('0x' || substr(md5('{k}|' || token), 1, 6))::bigint % 1000)::double" for k in range(4)) + "]"
HAS = "('0x' || substr(md5('has|' || token), 1, 6))::bigint % 10 > 0"


def _arrays(spark, d):
    return table(spark, d, "articles").where("teacher_logits is not null").select("article_id", "split", "lang", F.col("gpt_label_id").alias("y"), "teacher_logits").distinct()


def _num(prefix, width=6):
    return F.conv(F.substring(F.md5(F.concat(F.lit(prefix), F.col("token"))), 1, width), 16, 10).cast("bigint")


def _tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.explode(tokens("text")).alias("token"))


def _table(tok):
    t = tok.select("token").distinct().where(_num("has|") % 10 > 0)
    return t.select("token", F.array(*[(_num(f"{k}|") % 1000).cast("double") for k in range(4)]).alias("row"))


@R.query(f"with {A}, e as (select article_id, v, list_transform(v, lambda x: exp((x - list_max(v)) / 2.0)) as e from a) select article_id, round(list_max(e) / list_sum(e), 6) as top, round(e[3] / list_sum(e), 6) as third from e")
def softmax_temperature(spark, d):
    return _arrays(spark, d).select("article_id", vc.softmax("teacher_logits", 2.0).alias("s")).select("article_id", r6(F.array_max("s")).alias("top"), r6(F.element_at("s", 3)).alias("third"))


@R.query(f"with {A}, x as (select article_id, v, unnest(v) as z, generate_subscripts(v, 1) - 1 as i from a), r as (select article_id, i, row_number() over (partition by article_id order by z desc, i) as r from x) select article_id, max(i) filter (r = 1)::int as best, max(i) filter (r = 2)::int as second from r group by 1")
def argmax_and_second(spark, d):
    return _arrays(spark, d).select("article_id", vc.argmax("teacher_logits").alias("best"), vc.second_best("teacher_logits").cast("int").alias("second"))


@R.query(f"with {A}, x as (select split, unnest(v) as z, generate_subscripts(v, 1) - 1 as pos from a) select split, pos::int as pos, round(avg(z), 5) as x from x group by 1, 2")
def ensemble_mean(spark, d):
    m = vc.vector_mean(_arrays(spark, d), "teacher_logits", ["split"])
    return m.select("split", F.posexplode("teacher_logits").alias("pos", "x")).select("split", "pos", F.round("x", 5).alias("x"))


@R.query(f"with {TT}, n as (select doc_id, token, count(*) as n from tok where {HAS} group by 1, 2), x as (select doc_id, n, unnest({ROW}) as z, unnest([0, 1, 2, 3]) as pos from n) select doc_id, pos::int as pos, round(sum(n * z) / sum(n), 6) as x from x group by 1, 2")
def mean_pool_table(spark, d):
    t = _tokens(spark, d)
    return vc.pool(t, _table(t), "doc_id", "token", "row", 4).select("doc_id", "pos", r6("x").alias("x"))


@R.query(f"with {TT}, n as (select doc_id, token, count(*) * length(token) as n from tok where {HAS} group by 1, 2), x as (select doc_id, n, unnest({ROW}) as z, unnest([0, 1, 2, 3]) as pos from n) select doc_id, pos::int as pos, round(sum(n * z) / sum(n), 6) as x from x group by 1, 2")
def weighted_pool(spark, d):
    t = _tokens(spark, d).withColumn("w", F.length("token"))
    return vc.pool(t, _table(t), "doc_id", "token", "row", 4, "w").select("doc_id", "pos", r6("x").alias("x"))


@R.query(f"with g as (select doc_id, {TOKENS.format('text')} as t from documents where text is not null), tok as (select doc_id, unnest(t) as token, generate_subscripts(t, 1) as i from g), w as (select doc_id, token, case when i <= 50 then 1.0 else 0.25 end as w from tok where {HAS}), x as (select doc_id, w, unnest({ROW}) as z, unnest([0, 1, 2, 3]) as pos from w) select doc_id, pos::int as pos, round(sum(w * z) / sum(w), 6) as x from x group by 1, 2")
def position_pool(spark, d):
    """Tokens past the fiftieth weigh a quarter."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(tokens("text")).alias("i", "token")).withColumn("w", F.when(F.col("i") < 50, 1.0).otherwise(0.25))
    return vc.pool(t, _table(t), "doc_id", "token", "row", 4, "w").select("doc_id", "pos", r6("x").alias("x"))


HEAD = "h as (select l as label, [((l * 7 + i * 3) % 11 - 5) / 10.0 for i in range(0, 64)] as w from range(0, 10) t(l))"


def _head(spark):
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("label") * 7 + i * 3) % 11 - 5) / 10.0)
    return spark.range(10).withColumnRenamed("id", "label").withColumn("w", w)


@R.query(f"with {HEAD} select vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * w[i])), 6) as z from (select vec_id, embedding from embeddings), h")
def fold_head(spark, d):
    f = vc.fold_head(table(spark, d, "embeddings"), _head(spark), "vec_id", "embedding", "label", "w")
    return f.select("vec_id", F.posexplode("row").alias("label", "z")).select("vec_id", F.col("label").cast("bigint").alias("label"), r6("z").alias("z"))


@R.query(f"with {HEAD}, z as (select vec_id, label, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * w[i])) as z from (select vec_id, embedding from embeddings), h) select vec_id, round(sum(0.5 * z * (1 + tanh(0.7978845608028654 * (z + 0.044715 * z * z * z))) * (label - 4)), 6) as score from z group by 1")
def mlp_head_gelu(spark, d):
    f = vc.fold_head(table(spark, d, "embeddings"), _head(spark), "vec_id", "embedding", "label", "w")
    g = F.transform("row", lambda x, i: vc.gelu(x) * (i - 4))
    return f.select("vec_id", r6(F.aggregate(g, F.lit(0.0), lambda s, x: s + x)).alias("score"))


@R.query("with c as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by 1, 2), v as (select label, list(x order by i) as v from c group by 1) select a.label as a, b.label as b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 5) as cosine from v a join v b on a.label <= b.label")
def cosine_matrix(spark, d):
    v = vc.vector_mean(table(spark, d, "embeddings"), "embedding", ["label"])  # one row a label
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    return a.join(F.broadcast(b), F.col("a") <= F.col("b")).select("a", "b", F.round(vc.cosine("va", "vb"), 5).alias("cosine"))


@R.query("with m as (select vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::double))) as top from embeddings) select vec_id, round(case when top > 0 then top / 127 else 1 end, 6) as scale, list_sum(list_transform(embedding, lambda x: abs(round_even(x::double / case when top > 0 then top / 127 else 1 end, 0))))::bigint as total from m")
def quantise_rows(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", vc.quantise("embedding").alias("s"))
    return q.select("vec_id", r6("s.scale").alias("scale"), F.aggregate("s.q", F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x.cast("bigint"))).alias("total"))


@R.query(f"with {TT}, df as (select token, count(distinct doc_id) as df from tok group by 1), n as (select count(distinct doc_id) as n from tok) select token, df, round(ln((1 + n) / (1 + df)) + 1, 6) as idf from df, n where df >= 3")
def smoothed_idf(spark, d):
    t = _tokens(spark, d).select("doc_id", "token").distinct()
    n = t.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 3").crossJoin(F.broadcast(n))  # n is one row
    return df.select("token", "df", r6(vc.smoothed_idf(F.col("df"), F.col("n"))).alias("idf"))


@R.query(f"with {TT}, tf as (select doc_id, token, count(*) as tf from tok group by 1, 2), df as (select token, count(*) as df, sum(tf) as cf from tf group by 1 having count(*) >= 3 order by cf desc, token limit 2000), n as (select count(distinct doc_id) as n from tok), w as (select doc_id, token, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (token), n) select doc_id, token, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w")
def tfidf_l2(spark, d):
    return vc.tfidf(_tokens(spark, d), "doc_id", "token", 3, 2000).select("doc_id", "token", r6("weight").alias("weight"))


@R.query(f"with {TT}, c as (select token, count(*) as n from tok group by 1), k as (select *, row_number() over (order by token) - 1 as token_id from c) select token, (row_number() over (order by token_id) - 1)::bigint as new_id from k where n >= 10 or length(token) = 1 or token_id in (0, 1)")
def compact_vocab(spark, d):
    c = _tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    k = c.withColumn("token_id", F.row_number().over(Window.orderBy("token")) - 1)  # the vocabulary, one row a token
    return vc.compact_vocabulary(k, "token_id", "token", "n", 10).select("token", F.col("new_id").cast("bigint").alias("new_id"))


@R.query(f"with {A}, s as (select article_id, split, list_max(list_transform(v, lambda x: exp(x - list_max(v)))) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) as c from a) select article_id, round(c / avg(c) over (partition by split), 6) as weight from s")
def confidence_weights(spark, d):
    s = _arrays(spark, d).select("article_id", "split", F.array_max(vc.softmax("teacher_logits")).alias("c"))
    m = s.groupBy("split").agg(F.avg("c").alias("m"))  # one row a split
    return s.join(F.broadcast(m), s["split"].eqNullSafe(m["split"])).select("article_id", r6(F.col("c") / F.col("m")).alias("weight"))


@R.query(f"with g as (select doc_id, {TOKENS.format('text')} as t from documents where text is not null), e as (select doc_id, len(t) as n, unnest(range(1, len(t) + 1)) as i from g where len(t) > 0) select doc_id, count(*) filter (n <= 4 or i = 1 or ('0x' || substr(md5('1|' || doc_id || '|' || i), 1, 8))::bigint % 100 >= 20) as kept from e group by 1")
def token_dropout(spark, d):
    e = table(spark, d, "documents").where("text is not null").select("doc_id", tokens("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.posexplode("t").alias("i", "x"))
    keep = (F.col("n") <= 4) | (F.col("i") == 0) | (hash_int(F.concat_ws("|", F.lit("1"), F.col("doc_id").cast("string"), (F.col("i") + 1).cast("string"))) % 100 >= 20)
    return e.groupBy("doc_id").agg(F.count_if(keep).alias("kept"))


@R.query(f"with {TT}, t as (select distinct doc_id, token from tok where {HAS}), s as (select doc_id, token, {ROW} as r from t), p as (select doc_id, token, list_max(list_transform(range(1, 5), lambda i: r[i] - (list_sum(r) - r[i]) / 3)) as spec, r from s), k as (select *, row_number() over (partition by doc_id order by round(spec, 9) desc, token) as o, count(*) over (partition by doc_id) as n from p) select doc_id, count(*) as kept, round(sum(spec), 6) as specificity, min(token) as first_token from k where o <= greatest(1, round_even(0.2 * n, 0)) group by 1")
def specificity_topq(spark, d):
    t = _tokens(spark, d)
    s = t.select("doc_id", "token").distinct().join(_table(t), "token")
    total = F.aggregate("row", F.lit(0.0), lambda a, x: a + x)
    p = s.select("doc_id", "token", "row", total.alias("total")).withColumn("spec", F.array_max(F.transform("row", lambda x: x - (F.col("total") - x) / 3)))
    k = p.withColumn("o", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("spec", 9).desc(), "token"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return k.where(F.col("o") <= F.greatest(F.lit(1), F.bround(0.2 * F.col("n")))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), r6(F.sum("spec")).alias("specificity"), F.min("token").alias("first_token"))


@R.query(f"with {A}, m as (select article_id, v, list_transform(v, lambda x, i: x + ((article_id * 13 + i * 7 + 1) % 10 - 5) / 10.0) as b, list_transform(v, lambda x, i: x + ((article_id * 13 + i * 7 + 2) % 10 - 5) / 10.0) as c from a), e as (select article_id, list_position(v, list_max(v)) as p0, list_transform(range(1, 18), lambda i: round((v[i] + b[i] + c[i]) / 3, 6)) as m from m) select count(*) as n, round(avg((p0 = list_position(m, list_max(m)))::int), 6) as same from e")
def ensemble_curve(spark, d):
    a = _arrays(spark, d).select("article_id", vc.doubles("teacher_logits").alias("v")).distinct()
    noise = lambda k: F.transform("v", lambda x, i: x + ((F.col("article_id") * 13 + (i + 1) * 7 + k) % 10 - 5) / 10.0)
    m = F.zip_with(F.zip_with("v", noise(1), lambda x, y: x + y), noise(2), lambda x, y: F.round((x + y) / 3, 6))
    return a.select(vc.argmax("v").alias("p0"), m.alias("m")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("p0") == vc.argmax("m")).cast("double"))).alias("same"))


@R.query(f"with {A}, m as (select article_id, v, list_transform(v, lambda x: round(x, 1)) as w from a) select count(*) as n, round(avg((list_position(v, list_max(v)) = list_position(w, list_max(w)))::int), 6) as agreement, round(max(list_max(list_transform(range(1, 18), lambda i: abs(v[i] - w[i])))), 5) as max_diff from m")
def rescoring_check(spark, d):
    a = _arrays(spark, d).select("article_id", vc.doubles("teacher_logits").alias("v")).distinct().withColumn("w", F.transform("v", lambda x: F.round(x, 1)))
    diff = F.array_max(F.zip_with("v", "w", lambda x, y: F.abs(x - y)))
    return a.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((vc.argmax("v") == vc.argmax("w")).cast("double"))).alias("agreement"), F.round(F.max(diff), 5).alias("max_diff"))


@R.query()
def hashed_bigrams(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tokens("text").alias("t")).where(F.size("t") > 1)
    pairs = t.select("doc_id", F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))).alias("p"))
    return pairs.groupBy(vc.hashed_bigram(F.col("p.a"), F.col("p.b"), 12).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
