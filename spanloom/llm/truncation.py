"""Problem 9: texts that were broken off inside a word, a sentence or a piece of markup.

In this order:

1. Near copies of every text are found by min-hash banding over five-word shingles (15 code points where words are not parted): texts
   with a common band key. Every text is aligned with its copies at its end: the last anchor (a substring of ``ANCHOR`` code
   points, chosen by its hash) before the break, and all that follows it, must stand in the copy. The text whose
   alignment ends early, where the copy goes on inside the sentence on the same line, is cut. What may have been put after a
   break (dots, a bracketed note) is tried without, too.
2. Texts that no copy settles are scored by the terminality of their closing words: what the last line ends with (sentence mark,
   ellipsis glued to a word, open markup, half a character) and what kind of line it is. Whether a full stop ends a sentence or an
   abbreviation is asked from the hidden-event model of ``sentences``, counted over all texts.
3. Where closing words leave it open: exact lengths at which far more texts end than around them, counted over all texts; and
   for prose without sentence marks, whether its closing letters end a sentence in another text.

Alignment makes no pairs. Texts ask with (anchor, length and hash of what follows it); a text that has an asked anchor answers for
each length asked there, at most one answer for each of its own places; questions meet answers by equality and the band keys of
both sides by key. So a group of copies costs in proportion to its texts, whatever its size, and no member is left out.

Cases: null, empty and blank texts are not cut; a text that breaks off exactly after a complete sentence is no case; texts of
fewer than ``ANCHOR`` code points are judged by closing words only, as so short a match says nothing; ids are kept as they are, also
where texts repeat; a null source is a group of its own in the report.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_batches
from .hashing import Rolling, code_points, mix
from .sentences import Model, counted_model

COMPLETE, CUT, BY_LIMIT, BY_ENDING = range(4)

#: Minima over shingles: bands of ``BAND_ROWS`` symbols, one block for each.
BANDS, BAND_ROWS = 24, 2
_MULTIPLIERS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)]
#: Code points of an anchor, which an alignment needs at least before the break, and one of how many places is an anchor.
ANCHOR, ANCHOR_EVERY = 60, 128
#: Closing letters of a text in a script without sentence marks.
ENDING = 7

END_MARK = re.compile(r"[.!?。！？।॥؟…][\"'”’»“」』)）\]]*\s*[\"'”’»“」』)）\]]*\Z")
GLUED = re.compile(r"(?<![\s.…])(?:…|\.{3})\Z")
SPACED = re.compile(r"\s(?:…|\.{3})\Z")
OPEN_MARKUP = re.compile(r"<(?:[A-Za-z/!][^<>\n]{0,200})?\Z|&#?\w{0,8}\Z|\[[^\[\]\n]{0,80}\]\([^()\s]{0,200}\Z|<(?:a|img|div|span|p|td|li)\b[^<>]{0,300}\Z")
LIST_ITEM = re.compile(r"(?:[-•–*]|\d{1,3}[.)])\s+\S")
REFERENCE = re.compile(r"\[\d+\](?:\s|\Z)")
CAPITALISED = re.compile(r"(?<![\w'’])[A-ZÀ-ÞА-ЯЁ\d][\w'’.-]*")
CAPTION = re.compile(r"(?:Fig(?:ure|\.)?|Abb(?:ildung|\.)?|Tab(?:le|elle|\.)?|Image|Photo|Рис\.?|图|図|表)\s*\d+", re.I)
ORNAMENT = re.compile(r"[\W_]+\Z|(?:END|FIN|ENDE|FINIS|The End|###)\Z|```.*", re.I)
PARENTHESIS = re.compile(r"[(\[（【][^()\[\]]*[)\]）】]\Z")
THAI = re.compile(r"[฀-๿]")
SPACELESS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
QUOTE_PAIRS = (("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）"))
#: Below these log odds of a sentence end a closing full stop belongs to an abbreviation.
ABBREVIATION = -2.5
#: A deliberate ellipsis closes a short line of its own.
SHORT_LINE_WORDS = 4
TOKEN = re.compile(r"[^\W_]+")
NOT_BLANK = re.compile(r"\S")


def _open_quote(line: str) -> bool:
    for a, b in QUOTE_PAIRS:
        if a in line and line.rfind(a) > line.rfind(b):
            return not ("„" in line and a == "“")
    if "„" in line and line.rfind("„") > max(line.rfind("“"), line.rfind("”")):
        return True
    return False


#: Role and place, as articles are signed.
SIGNATURE = re.compile(r"[A-ZÀ-ÞА-ЯЁ]\w+ [a-zà-þа-яё]{3,}, [A-ZÀ-ÞА-ЯЁ][\w'’-]*(?: [A-ZÀ-ÞА-ЯЁ][\w'’-]*){0,3}\Z")


def _is_address(line: str) -> bool:
    """Whether a line ends with a web or mail address."""
    last = line.rsplit(None, 1)[-1]
    return "://" in last or "www." in last or "." in last.rpartition("@")[2] and 0 < last.find("@") < last.rfind(".") < len(last) - 1


def _is_title_line(line: str, words: int) -> bool:
    """A short line of its own most of whose words are capitalised: a signature, a place, a heading."""
    return words <= 8 and not line[0].islower() and not SPACELESS.search(line) and len(CAPITALISED.findall(line)) * 4 > words * 3


def closing(text: str | None, model: Model) -> tuple[int, str]:
    """(verdict, closing letters) of a text by its closing words alone; the model knows what a full stop ends."""
    if not text:
        return COMPLETE, ""
    t = text.rstrip()
    while t and (t[-1] in "​‌‍﻿\x00" or t[-1].isspace()):
        t = t[:-1].rstrip()
    if not t:
        return COMPLETE, ""
    if t[-1] == "�":
        return CUT, ""
    cut_at = t.rfind("\n") + 1
    line = t[cut_at:].lstrip()
    if OPEN_MARKUP.search(t[-320:]):
        return CUT, ""
    if t.count("```") % 2 and not line.startswith("```"):
        return CUT, ""
    words = len(TOKEN.findall(line))
    if GLUED.search(line):
        before = line[: line.rfind("…" if line[-1] == "…" else "...")]
        if END_MARK.search(before) or SPACELESS.search(before[-1:]) and words <= 1 and not before:
            return COMPLETE, ""
        return (CUT if words > SHORT_LINE_WORDS or SPACELESS.search(before[-1:]) else BY_LIMIT), ""
    if SPACED.search(line):
        sentence = re.split(r"[.!?](?=\s)(?!\.)", line[: -1 if line[-1] == "…" else -3].rstrip())[-1]
        return (COMPLETE if len(TOKEN.findall(sentence)) <= SHORT_LINE_WORDS else BY_LIMIT), ""
    if END_MARK.search(line):
        if _open_quote(line):
            return CUT, ""
        if line[-1] == "." and not line.endswith("...") and words > 1 and model.stop_odds(t, len(t) - 1, cut_at) < ABBREVIATION:
            return CUT, ""
        return COMPLETE, ""
    if PARENTHESIS.match(line) or ORNAMENT.match(line) or _is_address(line):
        return COMPLETE, ""
    if LIST_ITEM.match(line) or REFERENCE.match(line) or CAPTION.match(line) or cut_at and (_is_title_line(line, words) or SIGNATURE.match(line)):
        return COMPLETE, ""
    if THAI.match(t[-1]):
        return BY_ENDING, t[-ENDING:]
    if not cut_at and words <= 3:
        return COMPLETE, ""
    return CUT, ""


def _shingle_minima(text: str) -> np.ndarray:
    """BANDS * BAND_ROWS symbols over shingles of five words (all words of a shorter text); of 15 code points in scripts without blanks."""
    if SPACELESS.search(text):
        points, _ = code_points([re.sub(r"\s+", " ", text)])
        hashes = Rolling(points).every(15)
    else:
        hashes = np.array([_WORDS[w] for w in TOKEN.findall(text)], dtype=np.uint64)
        if len(hashes):
            size = min(len(hashes), 5)
            n = len(hashes) - size + 1
            x = np.zeros(n, dtype=np.uint64)
            for j in range(size):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
            hashes = x
    out = np.zeros(BANDS * BAND_ROWS, dtype=np.uint64)
    if not len(hashes):
        return out
    hashes = np.unique(hashes)
    edges = (np.arange(BANDS, dtype=np.float64) * (2.0**64 / BANDS)).astype(np.uint64)
    for k in range(BAND_ROWS):
        x = hashes * _MULTIPLIERS[k]
        x ^= x >> np.uint64(32)
        x *= _MULTIPLIERS[k]
        x.sort()
        at = np.searchsorted(x, edges)
        at[at == len(x)] = 0
        out[k::BAND_ROWS] = x[at]
    return out


class _Words(dict):
    """Hash of a word by its code points; a worker forgets its words beyond a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def _band_keys(text: str) -> np.ndarray:
    """Keys of the blocks of a text, one for each band."""
    m = _shingle_minima(text).reshape(BANDS, BAND_ROWS)
    k = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
    return k.view(np.int64)


#: What may stand after a break: dots, a bracketed note.
PUT_AFTER = re.compile(r"\s*(?:\.{2,}|…+|[\[(（【][^\[\]()（）【】\n]{0,60}[\])）】]|�+)\Z")


def _breaks(text: str) -> list[int]:
    """Where a text may have been broken off: its end, and its end without what may have been put there."""
    ends = [len(text.rstrip())]
    m = PUT_AFTER.search(text, max(ends[0] - 80, 0), ends[0])
    if m and m.start() < ends[0]:
        ends.append(len(text[: m.start()].rstrip(" …")))
    return [e for e in ends if e >= ANCHOR]


def _anchors(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[tuple[int, int, int]]]]:
    """For each text the hashes and places of its anchors, and its questions (anchor, length and hash of what follows it)."""
    points, offsets = code_points(texts)
    rolling = Rolling(points)
    hashes = rolling.every(ANCHOR)
    chosen = np.flatnonzero(hashes % np.uint64(ANCHOR_EVERY) == 0)
    owner = np.searchsorted(offsets, chosen, side="right") - 1
    inside = chosen + ANCHOR <= offsets[owner + 1]
    chosen, owner = chosen[inside], owner[inside]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    all_hashes, all_places, questions = [], [], []
    for k, t in enumerate(texts):
        base = int(offsets[k])
        own = chosen[bounds[k] : bounds[k + 1]] - base
        if len(t) >= ANCHOR and (not len(own) or own[0] != 0):
            own = np.r_[0, own]  # the start of a text is always an anchor
        all_hashes.append(hashes[own + base].view(np.int64) if len(own) else np.zeros(0, dtype=np.int64))
        all_places.append(own)
        asked = []
        for e in _breaks(t):
            i = int(np.searchsorted(own, e - ANCHOR, side="right")) - 1
            a = int(own[i]) + ANCHOR
            h = rolling.spans(np.array([base + a]), np.array([base + e])).view(np.int64)[0]
            asked.append((int(all_hashes[-1][i]), e - a, int(h)))
        questions.append(asked)
    return all_hashes, all_places, questions


def _features(df: DataFrame, model) -> DataFrame:
    """(doc_id, verdict, ending, n, keys, anchors, places, asked) of (doc_id, text)."""
    asked_type = pa.list_(pa.struct([("anchor", pa.int64()), ("rest", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                judged = [closing(t, m) for t in texts]
                known = [t or "" for t in texts]
                anchors, places, asked = _anchors(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([v for v, _ in judged], pa.int32()),
                        pa.array([e for _, e in judged], pa.string()),
                        pa.array([len(t) for t in known], pa.int32()),
                        pa.array([_band_keys(t) if len(t) >= ANCHOR else [] for t in known], pa.list_(pa.int64())),
                        pa.array(anchors, pa.list_(pa.int64())),
                        pa.array([x.astype(np.int32) for x in places], pa.list_(pa.int32())),
                        pa.array([[{"anchor": x, "rest": y, "hash": z} for x, y, z in own] for own in asked], asked_type),
                    ],
                    names=["doc_id", "verdict", "ending", "n", "keys", "anchors", "places", "asked"],
                )

    schema = "doc_id bigint, verdict int, ending string, n int, keys array<bigint>, anchors array<bigint>, places array<int>, asked array<struct<anchor: bigint, rest: int, hash: bigint>>"
    return df.select("doc_id", "text").mapInArrow(run, schema)


def _joined(c: str) -> bool:
    """Whether a code point is part of a word: a letter, a digit, or a mark on one."""
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def goes_on(y: str, end: int) -> bool:
    """Whether ``y`` goes on after ``end`` inside the word, or inside the sentence on the same line."""
    rest = NOT_BLANK.search(y, end)
    if rest is None or "\n" in y[end : rest.start()]:
        return False
    before, after = y[end - 1], y[end]
    if _joined(before) and _joined(after):
        return True  # inside a word, or a script that does not part them
    if THAI.match(before):
        return False  # a blank between Thai letters ends a sentence
    if END_MARK.search(y[max(end - 8, 0) : end]):
        return rest[0].islower()
    return _joined(rest[0]) or rest[0] in ",;:，；、،"


def _answers(texts: DataFrame) -> DataFrame:
    """(anchor, rest, hash, other): what follows the asked anchors of (other, text, hits) where the text goes on after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits_of = batch.column(2)
            for i, (other, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                points, _ = code_points([text])
                rolling = Rolling(points)
                out: set[tuple[int, int, int]] = set()
                for hit in hits_of[i].as_py():
                    a = hit["place"] + ANCHOR
                    rests = [r for r in hit["rests"] if a + r < len(text) and goes_on(text, a + r)]
                    if rests:
                        ends = a + np.array(rests)
                        found = rolling.spans(np.full(len(ends), a), ends).view(np.int64)
                        out.update((hit["anchor"], r, h) for r, h in zip(rests, found.tolist()))
                cols = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array([other] * len(out), pa.int64())],
                    names=["anchor", "rest", "hash", "other"],
                )

    return texts.mapInArrow(run, "anchor bigint, rest int, hash bigint, other bigint")


def cut_by_copy(docs: DataFrame, features: DataFrame) -> DataFrame:
    """(doc_id) of the texts whose alignment with a near copy ends early."""
    asked = features.select("doc_id", F.explode("asked").alias("q")).select("doc_id", "q.*")
    # few lengths are asked at one anchor: none is longer than the way to the next one
    at = asked.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.collect_set("rest").alias("rests"))
    own = features.select("doc_id", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("doc_id", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    hits = own.join(at, "anchor").where("not (lo = hi and lo = doc_id)")
    wanted = hits.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "rests")).alias("hits"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select(F.col("doc_id").alias("other"), "text", "hits")
    answers = checkpointed(_answers(texts))
    # near copies only: both sides are in one block of the banding; a text does not testify against itself
    blocks = features.select("doc_id", "keys")
    met = answers.join(blocks.withColumnRenamed("doc_id", "other"), "other").select("anchor", "rest", "hash", "other", F.explode("keys").alias("key"))
    met = met.groupBy("anchor", "rest", "hash", "key").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    asking = asked.join(answers.select("anchor", "rest", "hash").distinct(), ["anchor", "rest", "hash"], "left_semi")
    asking = asking.join(blocks, "doc_id").select("doc_id", "anchor", "rest", "hash", F.explode("keys").alias("key"))
    return asking.join(met, ["anchor", "rest", "hash", "key"]).where("not (lo = hi and lo = doc_id)").select("doc_id").distinct()


def length_limits(features: DataFrame) -> DataFrame:
    """(n) of exact lengths that many more different texts have than the lengths up to 12 around; lengths are few."""
    counts = features.where("n >= 100 and size(keys) > 0").groupBy("n").agg(F.countDistinct(F.expr("keys[0]"), F.expr("keys[1]")).alias("count"))
    near = F.explode(F.sequence(F.col("n") - 12, F.col("n") + 12))
    around = counts.select(near.alias("n"), F.col("count").alias("c")).groupBy("n").agg(F.sum("c").alias("around"))
    return counts.join(around, "n").where("count >= 4 and count * 4 > (around - count)").select("n")


def _thai_sentence_ends(df: DataFrame) -> DataFrame:
    """(ending, doc_id) of all sentence ends in Thai prose: before a blank or line end that follows a Thai letter."""
    text = F.when(F.col("text").rlike("[฀-๿]"), F.col("text"))
    ends = F.expr(f"regexp_extract_all(t, '([\\\\u0E00-\\\\u0E7F]{{{ENDING}}})(?=[ \\\\n])', 1)")
    return df.select("doc_id", text.alias("t")).where("t is not null").select("doc_id", F.explode(F.array_distinct(ends)).alias("ending"))


def cut_documents(docs: DataFrame) -> DataFrame:
    """(doc_id) of the rows of (doc_id, text) whose text breaks off."""
    model = counted_model(docs.select(F.col("doc_id").alias("id"), "text"))
    features = checkpointed(_features(docs, model))
    by_copy = checkpointed(cut_by_copy(docs, features))
    unmatched = features.select("doc_id", "verdict", "ending", "n").join(by_copy, "doc_id", "left_anti")
    sure = unmatched.where(F.col("verdict") == CUT).select("doc_id")
    by_limit = unmatched.where(F.col("verdict") == BY_LIMIT).join(length_limits(features), "n", "left_semi").select("doc_id")
    doubtful = unmatched.where(F.col("verdict") == BY_ENDING).select("doc_id", "ending")
    # an ending is terminal if some other text ends a sentence with it
    known = _thai_sentence_ends(docs).groupBy("ending").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    by_ending = doubtful.join(known, "ending", "left").where("lo is null or (lo = hi and lo = doc_id)").select("doc_id")
    return by_copy.union(sure).union(by_limit).union(by_ending).distinct()


def cut_shares(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, share): how often each source truncates."""
    cut = cut_documents(docs).withColumn("cut", F.lit(1))
    joined = docs.select("doc_id", "source").join(cut, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_docs"))
