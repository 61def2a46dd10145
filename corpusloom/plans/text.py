"""Projections, predicates and scalar functions on text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.base import LOWER, NO_SPACE, TOKENS, WORDS, Registry, r6, table

R = Registry()
QUERIES, SQL = R.queries, R.sql
W, T, L = WORDS.format("text"), TOKENS.format("text"), LOWER.format("text")
HEAD_USE = "t <> '' and not coalesce(starts_with(b, t), false)"


@R.query(f"select doc_id, case when text is null then 0 else len({W}) end as n_words from documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count("text").alias("n_words"))


@R.query(f"select doc_id, array_to_string(({W})[1:512], ' ') as text from documents")
def truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate_words("text").alias("text"))


@R.query(f"select doc_id, md5(case when {NO_SPACE.format('lang')} then substr(text, 1, 2000) else array_to_string(({W})[1:512], ' ') end) as key from documents")
def truncate_for_lang(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.truncate_for_lang("text", "lang")).alias("key"))


@R.query(f"select doc_id, case when {NO_SPACE.format('lang')} then coalesce(length(text), 0) >= 200 else (case when text is null then 0 else len({W}) end) >= 75 end as keep from documents")
def length_predicate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.long_enough("text", "lang").alias("keep"))


@R.query(f"select distinct doc_id, md5(case when {HEAD_USE} and t <> 'None' then t || chr(10) || chr(10) || b else b end) as merged from (select doc_id, headline as t, text as b from unified_test)")
def title_body_merge(spark, d):
    return table(spark, d, "unified_test").select("doc_id", F.md5(tx.merge_title("headline", "text")).alias("merged")).distinct()


@R.query(f"select distinct page_id, md5(case when {HEAD_USE} then t || chr(10) || chr(10) || b else b end) as merged from (select page_id, headline as t, text as b from extracted_pages)")
def headline_merge(spark, d):
    return table(spark, d, "extracted_pages").select("page_id", F.md5(tx.merge_title("headline", "text", skip_none=False)).alias("merged")).distinct()


@R.query(rf"select doc_id, md5(substr(regexp_replace({L}, '[^\p{{L}}\p{{N}}_]+', '', 'g'), 1, 2000)) as key from documents")
def dup_key_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.dup_key("text").alias("key"))


@R.query(f"select doc_id, sha1(array_to_string({W}, ' ')) as key from documents")
def collapsed_sha1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.collapsed_sha1("text").alias("key"))


@R.query("select md5(substr(text, 1, 300)) as key, count(*) as n from documents where text is not null group by 1")
def prefix_key(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5(tx.prefix_key("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@R.query(f"select doc_id, len({T}) as n_tokens, len(list_distinct({T})) as n_distinct from documents where text is not null")
def word_tokens(spark, d):
    t = tx.tokens("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@R.query(rf"select doc_id, md5(regexp_replace({L}, '[ \t\n\r\f\v]+', '', 'g')) as key from documents where lang in ('zh', 'ja')")
def char_token_join(spark, d):
    return table(spark, d, "documents").where("lang in ('zh', 'ja')").select("doc_id", F.md5(F.array_join(tx.char_tokens("text"), "")).alias("key"))


@R.query(f"with g as (select doc_id, {T} as t from documents where text is not null), e as (select doc_id, array_to_string(t[i:i+7], ' ') as gram from (select doc_id, t, unnest(range(1, len(t) - 6)) as i from g where len(t) >= 8)) select doc_id, count(*) as n_grams, count(distinct gram) as n_distinct, min(gram) as first_gram from e group by 1")
def ngrams8(spark, d):
    g = table(spark, d, "documents").select("doc_id", tx.tokens("text").alias("t")).select("doc_id", F.explode(tx.ngrams(F.col("t"), 8)).alias("gram"))
    return g.groupBy("doc_id").agg(F.count("gram").alias("n_grams"), F.count_distinct("gram").alias("n_distinct"), F.min("gram").alias("first_gram"))


@R.query(rf"with c as (select doc_id, regexp_replace({L}, '[ \t\n\r\f\v]+', '', 'g') as s from documents where lang in ('zh', 'ja')), e as (select doc_id, substr(s, i, 16) as gram from (select doc_id, s, unnest(range(1, length(s) - 14)) as i from c where length(s) >= 16)) select doc_id, count(*) as n_grams, count(distinct gram) as n_distinct from e group by 1")
def ngrams16_chars(spark, d):
    g = table(spark, d, "documents").where("lang in ('zh', 'ja')").select("doc_id", tx.char_tokens("text").alias("t")).select("doc_id", F.explode(tx.ngrams(F.col("t"), 16, "")).alias("gram"))
    return g.groupBy("doc_id").agg(F.count("gram").alias("n_grams"), F.count_distinct("gram").alias("n_distinct"))


@R.query(f"with t as (select doc_id, min(headline) as h, min(text) as b from unified_test group by 1), x as (select doc_id, list_distinct({TOKENS.format('h')}) as a, list_distinct({TOKENS.format('b')}) as c from t) select doc_id, round(len(list_intersect(a, c)) / greatest(1, least(len(a), len(c)))::double, 6) as overlap from x")
def token_overlap_coefficient(spark, d):
    t = table(spark, d, "unified_test").groupBy("doc_id").agg(F.min("headline").alias("h"), F.min("text").alias("b"))
    return t.select("doc_id", r6(tx.overlap_coefficient(tx.tokens("h"), tx.tokens("b"))).alias("overlap"))


@R.query(r"select distinct page_id, nullif(regexp_extract(date_published, '(\d{4}-\d{2}-\d{2})', 1), '') as day from extracted_pages")
def iso_date(spark, d):
    return table(spark, d, "extracted_pages").select("page_id", tx.iso_date("date_published").alias("day")).distinct()


@R.query(r"select lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '')) as host, count(*) as n from documents group by 1")
def url_host(spark, d):
    return table(spark, d, "documents").groupBy(tx.url_authority("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@R.query("select html_lang as tag, lower(nullif(regexp_extract(html_lang, '^([A-Za-z]{2,3})([-_].*)?$', 1), '')) as code, count(distinct page_id) as n from extracted_pages group by 1, 2")
def lang_code(spark, d):
    return table(spark, d, "extracted_pages").groupBy(F.col("html_lang").alias("tag"), tx.lang_code("html_lang").alias("code")).agg(F.count_distinct("page_id").alias("n"))


@R.query("with p as (select distinct page_id, '<!doctype html><HTML class=\"a\" lang = \"' || html_lang || '\"><head>' as html from extracted_pages) select page_id, lower(nullif(regexp_extract(substr(html, 1, 4000), '(?is)<html[^>]*\\slang\\s*=\\s*[\"'']?([A-Za-z]{2,3})', 1), '')) as lang from p")
def html_lang(spark, d):
    p = table(spark, d, "extracted_pages").select("page_id", F.concat(F.lit('<!doctype html><HTML class="a" lang = "'), "html_lang", F.lit('"><head>')).alias("html")).distinct()
    return p.select("page_id", tx.html_lang("html").alias("lang"))


@R.query("select distinct doc_id, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') as slug, regexp_extract(label, '^([^,]*)', 1) as short_label from unified_test")
def slug_and_short_label(spark, d):
    return table(spark, d, "unified_test").select("doc_id", tx.slug("label").alias("slug"), F.substring_index("label", ",", 1).alias("short_label")).distinct()


@R.query("select distinct doc_id, case when train_overlap is null then '--' else printf('%.3f', train_overlap) end as shown, case when train_overlap is null then '--' when train_overlap < 0.001 then '<0.001' else printf('%.3f', train_overlap) end as shown_p from unified_test")
def number_format(spark, d):
    return table(spark, d, "unified_test").select("doc_id", tx.format_value("train_overlap").alias("shown"), tx.format_p("train_overlap").alias("shown_p")).distinct()


@R.query("select article_id, case when domain is null or domain in ('', 'unknown') then 'src:' || source else domain end as cluster from articles")
def cluster_key(spark, d):
    known = F.col("domain").isNotNull() & ~F.col("domain").isin("", "unknown")
    return table(spark, d, "articles").select("article_id", F.when(known, F.col("domain")).otherwise(F.concat(F.lit("src:"), "source")).alias("cluster"))


@R.query("select distinct page_id, case when in_language is not null and in_language <> '' then case when code = lid_lang then code end when lid_conf >= 0.7 then lid_lang end as lang, case when in_language is not null and in_language <> '' then case when code = lid_lang then 'ok' else 'lang_conflict' end when lid_conf >= 0.7 then 'ok' else 'lang_low_conf' end as reason from (select *, case lower(in_language) when 'in' then 'id' when 'iw' then 'he' when 'ji' then 'yi' else lower(in_language) end as code from extracted_pages)")
def language_resolution(spark, d):
    low = F.lower("in_language")
    code = F.when(low == "in", "id").when(low == "iw", "he").when(low == "ji", "yi").otherwise(low)
    declared, agree = F.col("in_language").isNotNull() & (F.col("in_language") != ""), F.coalesce(code == F.col("lid_lang"), F.lit(False))
    lang = F.when(declared, F.when(agree, code)).when(F.col("lid_conf") >= 0.7, F.col("lid_lang"))
    reason = F.when(declared, F.when(agree, "ok").otherwise("lang_conflict")).when(F.col("lid_conf") >= 0.7, "ok").otherwise("lang_low_conf")
    return table(spark, d, "extracted_pages").select("page_id", lang.alias("lang"), reason.alias("reason")).distinct()


@R.query(r"select count(distinct page_id) as n from extracted_pages where try_cast(nullif(regexp_extract(date_published, '(\d{4}-\d{2}-\d{2})', 1), '') as date) between date '2024-01-01' and try_cast(substr(warc_date, 1, 10) as date)")
def date_window(spark, d):
    p = table(spark, d, "extracted_pages").withColumn("day", F.try_to_date(tx.iso_date("date_published"), "yyyy-MM-dd"))
    return p.where(F.col("day").between(F.lit("2024-01-01").cast("date"), F.try_to_date(F.substring("warc_date", 1, 10), "yyyy-MM-dd"))).agg(F.count_distinct("page_id").alias("n"))


@R.query("select distinct page_id from extracted_pages where coalesce(lower(is_free::varchar), '') not in ('false', '0')")
def paywall_filter(spark, d):
    return table(spark, d, "extracted_pages").where(~F.coalesce(F.lower(F.col("is_free").cast("string")), F.lit("")).isin("false", "0")).select("page_id").distinct()


@R.query("select lang, count(*) as n from documents group by 1 having count(*) >= 30")
def min_group(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")


@R.query("select distinct doc_id, lid_checked = false or lang in ('en', 'de', 'fr') as passes, case when label_origin like 'human%' then 1 when label_origin like '%category' then 2 else 3 end as priority from unified_test")
def lid_and_priority(spark, d):
    origin = F.col("label_origin")
    return table(spark, d, "unified_test").select("doc_id", ((~F.col("lid_checked")) | F.col("lang").isin("en", "de", "fr")).alias("passes"), F.when(F.startswith(origin, F.lit("human")), 1).when(F.endswith(origin, F.lit("category")), 2).otherwise(3).alias("priority")).distinct()
