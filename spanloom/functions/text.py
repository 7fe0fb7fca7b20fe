"""Text functions as column expressions; everything here runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of Unicode-aware strip and \\s, spelt out because regex engines differ on it.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TERM = "[a-z0-9]+"
PARAGRAPH_BREAK = rf"\n{WS}*\n"


def first_filled(*names: str) -> Column:
    """First of the columns that is neither null nor empty (an empty string falls through)."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{WS}+", ""), rf"{WS}+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; accented letters part words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Set of lower-cased character n-grams; empty for shorter texts."""
    none = F.array().cast("array<string>")

    def grams(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - n)
        return F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])))

    # the characters are bound by a lambda, so that they are made once and not for every place
    bound = F.transform(F.array(F.split(F.lower(text), "")), lambda chars: F.when(F.size(chars) >= n, grams(chars)).otherwise(none))
    return F.when(F.length(text) >= n, F.get(bound, F.lit(0))).otherwise(none)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; 0 where a side is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.greatest(F.lit(1), F.size(a) + F.size(b) - common)).otherwise(0.0)


def pair_jaccard(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, jaccard) of the character trigrams of both texts of each pair.

    Only texts travel: a set of n-grams is many times its text, so it is made where the two sides have met.
    """
    needed = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").alias("_doc"))
    q = queries.select("qid", char_ngrams(F.col("text")).alias("x"))
    met = pairs.join(needed, "doc_id").join(q, "qid").select("qid", "doc_id", "x", char_ngrams(F.col("_doc")).alias("y"))
    return met.select("qid", "doc_id", F.round(jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


def prefix(text: Column, n: int) -> Column:
    """First n code points; 0 leaves the text as it is."""
    return F.substring(text, 1, n) if n else text


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with zero for zero vectors."""
    norm = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norm > 0, inner_product(a, b) / norm).otherwise(0.0)


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, idf_: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf_ * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over union of two character spans; 0 for disjoint or empty ones."""
    overlap = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - overlap
    return F.when(union > 0, overlap / union).otherwise(0.0)


def stable_id(kind: str, corpus: str, split: Column, name: Column) -> Column:
    """``kind-`` and the first 16 hex digits of the SHA-1 of ``corpus:split:name``."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha1(F.concat_ws(":", F.lit(corpus), split, name)), 1, 16))


def source_key(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, value)


def parse_source_url(url: Column) -> Column:
    """struct(type, value): an ``?id=`` names an archived page, an ``?href=`` a doubly encoded address, else unknown."""
    query = F.parse_url(url, F.lit("QUERY"))
    pick = lambda key: F.regexp_extract(query, rf"(?:^|&){key}=([^&]*)", 1)
    value = (
        F.when(F.contains(url, F.lit("?id=")), F.try_url_decode(pick("id")))
        .when(F.contains(url, F.lit("?href=")), F.try_url_decode(F.try_url_decode(pick("href"))))
        .otherwise(url)
    )
    kind = F.when(F.contains(url, F.lit("?id=")), "clueweb_id").when(F.contains(url, F.lit("?href=")), "source_url").otherwise("unknown")
    return F.struct(kind.alias("type"), value.alias("value"))


def text_name(name: Column) -> Column:
    """Name of the text file that belongs to a page: ``x.html`` gives ``x.txt``."""
    return F.concat(F.regexp_replace(name, r"\.html\z", ""), F.lit(".txt"))


def document_number(name: Column) -> Column:
    """Number in a suspicious document's file name, else null."""
    return F.regexp_extract(name, r"suspicious-document(\d+)-batch", 1).try_cast("int")


def clean_html(html: Column) -> Column:
    """Visible text of simple HTML: no scripts and styles, tags to blanks, six entities, other ones to blanks.

    ``&amp;`` is decoded first, so a doubly escaped entity is decoded twice.
    """
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"&[a-z]+;", " ")
    return strip(F.regexp_replace(x, rf"{WS}+", " "))


def repair_json(text: Column) -> Column:
    """Drop commas before closing braces and brackets."""
    return F.regexp_replace(F.regexp_replace(text, r",\s*\}", "}"), r",\s*\]", "]")
