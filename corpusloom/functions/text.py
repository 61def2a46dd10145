"""Column functions on text: words, tokens, n-grams, truncation, keys and parsers. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the corpus conventions.
MAX_WORDS, MIN_WORDS = 512, 75
NO_SPACE_LANGS = ("ja", "zh", "th", "my", "km", "lo")
MIN_CHARS_NO_SPACE, MAX_CHARS_NO_SPACE = 200, 2000
SPACE = r"[ \t\n\r\f\x0B]+"
TOKEN = r"[\p{L}\p{N}_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower_stable(text: Column | str) -> Column:
    """Lower case that does not depend on an engine's rules for the dotted I and the final sigma. Null stays null."""
    return F.lower(F.replace(F.replace(_c(text), F.lit("İ"), F.lit("i̇")), F.lit("Σ"), F.lit("σ")))


def words(text: Column | str) -> Column:
    """White-space words in order; none for an empty text, null for a null one."""
    return F.filter(F.split(_c(text), SPACE), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.when(_c(text).isNull(), F.lit(0)).otherwise(F.size(words(text)))


def truncate_words(text: Column | str, most: int = MAX_WORDS) -> Column:
    """The first `most` words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, most), " ")


def is_no_space(lang: Column | str) -> Column:
    return F.coalesce(_c(lang).isin(*NO_SPACE_LANGS), F.lit(False))


def truncate_for_lang(text: Column | str, lang: Column | str) -> Column:
    """By characters in languages written without spaces, else by words."""
    return F.when(is_no_space(lang), F.substring(_c(text), 1, MAX_CHARS_NO_SPACE)).otherwise(truncate_words(text))


def long_enough(text: Column | str, lang: Column | str) -> Column:
    """At least 200 characters or, elsewhere, 75 words; false for a null text."""
    return F.when(is_no_space(lang), F.coalesce(F.length(_c(text)), F.lit(0)) >= MIN_CHARS_NO_SPACE).otherwise(word_count(text) >= MIN_WORDS)


def merge_title(title: Column | str, body: Column | str, skip_none: bool = True) -> Column:
    """Title, blank line and body, unless the title is empty (or the word None) or the body starts with it already."""
    t, b = _c(title), _c(body)
    use = t.isNotNull() & (t != "") & ~F.startswith(b, t)
    if skip_none:
        use = use & (t != "None")
    return F.when(use, F.concat(t, F.lit("\n\n"), b)).otherwise(b)


def tokens(text: Column | str) -> Column:
    """Letters-digits-underscore tokens of the lower-cased text."""
    return F.regexp_extract_all(lower_stable(text), F.lit(f"({TOKEN})"))


def char_tokens(text: Column | str) -> Column:
    """The characters that are not white space."""
    return F.filter(F.split(lower_stable(text), ""), lambda x: (x != "") & ~F.rlike(x, F.lit(SPACE)))


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """Runs of n consecutive items; none if there are fewer.

    `items` should be a column and not an expression: it is used in a lambda and would be computed for every run.
    """
    count = F.coalesce(F.size(items), F.lit(0)) - (n - 1)
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(items, i, n), sep)))


def shingles(items: Column, n: int, sep: str = " ") -> Column:
    """n-grams; the whole sequence as one shingle if it is shorter than n."""
    return F.when((F.size(items) < n) & (F.size(items) > 0), F.array(F.array_join(items, sep))).otherwise(ngrams(items, n, sep))


def dup_key(text: Column | str) -> Column:
    """MD5 of the first 2,000 letters and digits of the lower-cased text."""
    return F.md5(F.substring(F.regexp_replace(lower_stable(text), r"[^\p{L}\p{N}_]+", ""), 1, 2000))


def collapsed_sha1(text: Column | str) -> Column:
    return F.sha1(F.array_join(words(text), " "))


def prefix_key(text: Column | str, n: int = 300) -> Column:
    return F.substring(_c(text), 1, n)


def iso_date(text: Column | str) -> Column:
    """The first yyyy-mm-dd in the text as a string, null if there is none."""
    found = F.regexp_extract(_c(text), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def url_authority(url: Column | str) -> Column:
    """Lower-cased authority (host with port and user info) of an absolute URL; null if it has none."""
    found = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(found != "", F.lower(found))


def lang_code(tag: Column | str) -> Column:
    """Primary language of a tag such as en-US; null if it is none."""
    found = F.regexp_extract(_c(tag), r"^([A-Za-z]{2,3})([-_].*)?$", 1)
    return F.when(found != "", F.lower(found))


def html_lang(html: Column | str) -> Column:
    """The two or three letters of the html element's language in the first 4,000 characters, in lower case; null if there are none."""
    tag = F.regexp_extract(F.substring(_c(html), 1, 4000), r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared distinct items over the smaller number of distinct items; 0 if one has none."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "")


def format_value(x: Column | str, decimals: int = 3) -> Column:
    """Fixed decimals; '--' for null and NaN."""
    v = _c(x)
    return F.when(v.isNull() | F.isnan(v), F.lit("--")).otherwise(F.format_string(f"%.{decimals}f", v))


def format_p(p: Column | str) -> Column:
    v = _c(p)
    return F.when(v.isNull() | F.isnan(v), F.lit("--")).when(v < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", v))
