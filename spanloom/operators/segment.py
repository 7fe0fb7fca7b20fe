"""Segmenters: column expressions from a text to an array of segments, and the table functions around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import PARAGRAPH_BREAK, WS, prefix, strip, tokens

#: Fixed value: a line that holds nothing but a section name, with an optional number.
SECTION_LINE = (
    rf"(?i)\n{WS}*(?:\d+\.?{WS}*)?(?:abstract|introduction|related{WS}*work|method|experiment|result|discussion|conclusion|reference|acknowledg){WS}*\n"
)
#: Where sentences are parted, in two versions and a plain one.
SENTENCE_BREAK_V1 = rf"(?<=[.!?]){WS}+(?=[A-Z])|\n\n+"
SENTENCE_BREAK_V2 = SENTENCE_BREAK_V1 + r"|\n(?=[A-Z][a-z])"
SENTENCE_BREAK_PLAIN = rf"(?<=[.!?]){WS}+"


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, PARAGRAPH_BREAK), strip), lambda p: p != "")


def pack_paragraphs(text: Column, min_chars: int = 800, max_chars: int = 3000) -> Column:
    """Greedy packing of paragraphs into chunks.

    A chunk is closed when the next paragraph would take it over ``max_chars`` and it is itself over ``min_chars``; so
    ``max_chars`` is a target, a longer paragraph stays whole. A tail of at most ``min_chars`` is dropped; a text
    without any chunk gives its first ``max_chars`` code points.
    """
    empty = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        buf = acc["buf"]
        close = (F.length(buf) + F.length(p) > max_chars) & (F.length(buf) > min_chars)
        joined = F.when(buf == "", p).otherwise(F.concat(buf, F.lit("\n\n"), p))
        return F.struct(
            F.when(close, F.array_append(acc["chunks"], buf)).otherwise(acc["chunks"]).alias("chunks"),
            F.when(close, p).otherwise(joined).alias("buf"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.length(acc["buf"]) > min_chars, F.array_append(acc["chunks"], acc["buf"])).otherwise(acc["chunks"])

    packed = F.aggregate(paragraphs(text), empty, step, finish)
    return F.when(F.size(packed) > 0, packed).otherwise(F.array(prefix(text, max_chars)))


def fixed_windows(text: Column, size: int = 2000, stride: int = 1000, at_most: int = 20) -> Column:
    """Character windows, the first ``at_most`` of them or, with 0, all; a text of at most ``size`` is one window."""
    starts = F.sequence(F.lit(0), F.length(text) - stride - 1, F.lit(stride))
    cut = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    if at_most:
        cut = F.slice(cut, 1, at_most)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(cut)


def sections(text: Column, min_chars: int = 500, at_most: int = 15) -> Column:
    """Parts between lines that are section names; parts of at most ``min_chars`` are dropped; without any, chunks."""
    parts = F.slice(F.filter(F.transform(F.split(text, SECTION_LINE), strip), lambda s: F.length(s) > min_chars), 1, at_most)
    return F.when(F.size(parts) > 0, parts).otherwise(pack_paragraphs(text))


def token_windows(text: Column, size: int = 256, stride: int = 128, raw_chars: int = 3000) -> Column:
    """Windows of tokens at every stride; up to ``size`` tokens the raw text's first ``raw_chars`` are the only one."""
    tok = tokens(text)
    starts = F.sequence(F.lit(0), F.size(tok) - 1, F.lit(stride))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(tok, i + 1, F.lit(size)), " "))
    return F.when(F.size(tok) <= size, F.array(prefix(text, raw_chars))).otherwise(cut)


def length_gated(text: Column, gate: int = 20000) -> Column:
    """Chunks for texts over ``gate`` code points, the whole text otherwise."""
    return F.when(F.length(text) > gate, pack_paragraphs(text)).otherwise(F.array(text))


def capped(segment: Callable[[Column], Column], at_most: int = 20) -> Callable[[Column], Column]:
    return lambda text: F.slice(segment(text), 1, at_most)


def sentence_spans(text: Column, breaks: str = SENTENCE_BREAK_V1) -> Column:
    """array of struct(start, end, text), offsets in code points, 0-based and end-exclusive.

    Each part is looked up from the end of the one before, so repeated sentences get their own places.
    """
    parts = F.filter(F.transform(F.split(text, breaks), strip), lambda p: p != "")
    kind = "struct<spans:array<struct<start:int,end:int,text:string>>,pos:int>"
    first = F.struct(F.array().alias("spans"), F.lit(0).alias("pos")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, text, acc["pos"] + 1) - 1
        start = F.when(at < 0, acc["pos"]).otherwise(at)
        end = start + F.length(p)
        return F.struct(F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), p.alias("text"))).alias("spans"), end.alias("pos")).cast(kind)

    return F.aggregate(parts, first, step, lambda acc: acc["spans"])


def paragraph_spans(text: Column, max_chars: int = 500) -> Column:
    """Paragraphs with offsets; one over ``max_chars`` falls into its sentences."""
    whole = sentence_spans(text, PARAGRAPH_BREAK)

    def fall(p: Column) -> Column:
        inner = F.transform(
            sentence_spans(p["text"]), lambda s: F.struct((s["start"] + p["start"]).alias("start"), (s["end"] + p["start"]).alias("end"), s["text"].alias("text"))
        )
        return F.when(F.length(p["text"]) > max_chars, inner).otherwise(F.array(p))

    return F.flatten(F.transform(whole, fall))


def segment_rows(df: DataFrame, segments: Column, no: str = "chunk_no", out: str = "chunk", keep: tuple[str, ...] = ("qid",)) -> DataFrame:
    """One row for each segment, numbered from 0, with the number of segments of its text."""
    listed = df.select(*keep, segments.alias("_s"))
    return listed.select(*keep, F.size("_s").alias("n_chunks"), F.posexplode("_s").alias(no, out))
