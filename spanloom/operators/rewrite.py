"""Rewriting of long queries into shorter ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import WS, prefix, strip
from spanloom.operators.segment import SENTENCE_BREAK_PLAIN

#: English words that carry no topic; our own choice of the most frequent function words.
STOP_WORDS = (
    "a about after all also an and any are as at be been before being between both but by can could did do does down during each few for from further had has have "
    "he her here him his how i if in into is it its itself just me more most my no nor not of off on once only or other our out over own same she should so some such "
    "than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
WORD = r"(?U)\b\w\w+\b"


def _words(text: Column) -> Column:
    """Lower-case words of at least two letters or digits that are not stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def truncate(queries: DataFrame, max_chars: int = 3000) -> DataFrame:
    return queries.select("qid", prefix(F.coalesce("text", F.lit("")), max_chars).alias("text"))


def tfidf_sentences(queries: DataFrame, n: int = 20, max_chars: int = 3000) -> DataFrame:
    """The ``n`` sentences most like the whole document, in their order; texts of at most ``n`` sentences are cut.

    Weights are term frequency times smoothed inverse frequency over the document's sentences and itself, normalised;
    similarity is the cosine to the document. Ties keep the earlier sentence.
    """
    parts = queries.select("qid", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts.select("qid", "text", F.split("text", SENTENCE_BREAK_PLAIN).alias("sents"))
    short = parts.where(F.size("sents") <= n).select("qid", prefix(F.col("text"), max_chars).alias("text"))
    long = parts.where(F.size("sents") > n)
    sents = long.select("qid", F.size("sents").alias("n_sents"), F.posexplode("sents").alias("no", "sent"))
    units = sents.select("qid", "n_sents", "no", F.col("sent").alias("text")).union(long.select("qid", F.size("sents"), F.lit(-1), "text"))
    tf = units.select("qid", "n_sents", "no", F.explode(_words(F.col("text"))).alias("w")).groupBy("qid", "n_sents", "no", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("qid", "w").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log((F.col("n_sents") + 2.0) / (F.col("df") + 1.0)) + 1.0)
    weighted = tf.join(df, ["qid", "w"]).select("qid", "no", "w", weight.alias("x"))
    norms = weighted.groupBy("qid", "no").agg(F.sqrt(F.sum((F.col("x") * F.col("x")).cast("decimal(24,12)")).cast("double")).alias("norm"))
    whole = weighted.where("no = -1").select("qid", "w", F.col("x").alias("y"))
    dots = weighted.where("no >= 0").join(whole, ["qid", "w"]).groupBy("qid", "no").agg(F.sum((F.col("x") * F.col("y")).cast("decimal(24,12)")).cast("double").alias("dot"))
    sims = dots.join(norms, ["qid", "no"]).select("qid", "no", F.round(F.col("dot") / F.col("norm"), 9).alias("sim"))
    w = W.partitionBy("qid").orderBy(F.desc(F.coalesce("sim", F.lit(0.0))), "no")
    kept = sents.join(sims, ["qid", "no"], "left").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    lists = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("no", "sent"))).alias("s"))
    return lists.select("qid", prefix(F.array_join(F.transform("s", lambda s: s["sent"]), " "), max_chars).alias("text")).union(short)


def tfidf_keywords(queries: DataFrame, n: int = 500, max_chars: int = 3000) -> DataFrame:
    """The ``n`` most frequent words of a document in alphabetical order; without any, its beginning.

    Over one document all inverse frequencies are equal, so frequency alone chooses; ties go by the alphabet.
    """
    text = F.coalesce("text", F.lit(""))
    words = queries.select("qid", F.explode(_words(text)).alias("w")).groupBy("qid", "w").agg(F.count("*").alias("tf"))
    w = W.partitionBy("qid").orderBy(F.desc("tf"), "w")
    kept = words.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    joined = kept.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("k"))
    out = queries.select("qid", text.alias("text")).join(joined, "qid", "left")
    return out.select("qid", prefix(F.coalesce("k", "text"), max_chars).alias("text"))


#: What counts as an abstract and as a section line.
ABSTRACT = rf"(?is)abstract\b[:\t-\r ]*\n*(.*?)\n{WS}*(?:\d+\.?{WS}*)?(?:introduction|chapter|section|\bI\b\.)"
SECTION = rf"(?:^|\n){WS}*(?:\d+\.?{WS}*)?([A-Z](?:[A-Za-z]|{WS}){{3,40}})(?:\n|\z|{WS}*\.)"


def structured(text: Column, max_chars: int = 3000) -> Column:
    """Title line, abstract (or the first paragraph over 100 characters) and section names, joined by blanks.

    The title is the first of the first five lines with more than 10 characters; section names have more than 5. A result
    of less than 200 characters gives way to the document's beginning.
    """
    title = F.try_element_at(F.filter(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.length(strip(x)) > 10), F.lit(1))
    first = F.try_element_at(F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 100), F.lit(1))
    abstract = F.when(text.rlike(ABSTRACT), F.concat(F.lit("Abstract: "), prefix(strip(F.regexp_extract(text, ABSTRACT, 1)), 1000)))
    heads = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(1)), strip), lambda h: F.length(h) > 5)
    marks = F.transform(heads, lambda h: F.concat(F.lit("[Section: "), h, F.lit("]")))
    joined = prefix(F.array_join(F.concat(F.array_compact(F.array(title, F.coalesce(abstract, prefix(first, 1000)))), marks), " "), max_chars)
    return F.when(F.length(joined) < 200, prefix(text, max_chars)).otherwise(joined)


def structured_extract(queries: DataFrame, max_chars: int = 3000) -> DataFrame:
    return queries.select("qid", structured(F.coalesce("text", F.lit("")), max_chars).alias("text"))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"truncate": truncate, "tfidf_sentences": tfidf_sentences, "structured": structured_extract, "keywords": tfidf_keywords}


def rewrite(queries: DataFrame, strategy: str, max_chars: int = 3000) -> DataFrame:
    """(qid, text) by the named strategy."""
    return STRATEGIES[strategy](queries, max_chars=max_chars)
