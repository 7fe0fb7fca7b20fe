"""Problem 6: oversized texts in pieces under a limit, by agglomerative merging of atomic segments.

Atoms are sentence units; a sentence that alone is too long falls into words, a word that alone is too long into equal
cuts. A heap holds the borders of neighbouring segments by strength (cut word, word, sentence, line, paragraph) and by the
joint size of the two sides. The weakest border is merged first, as long as the joint segment and its overlap with the
piece before it fit; what cannot be merged any more is a piece.

Cases: null and empty texts have no piece, texts within the limit one; all pieces together cover the text in order; each
piece after the first starts exactly ``overlap`` code points before the end of the one before; ties go to the left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .sentences import Model, counted_model, units

CUT, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_WORD_END = re.compile(r"(?<=\S)(?=\s)")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")


def _atoms(text: str, room: int, model: Model) -> tuple[list[int], list[int]]:
    """(ends of the atoms, strengths of these ends); the last end is the text's, and no atom is larger than ``room``."""
    ends: list[int] = []
    strengths: list[int] = []
    begin = 0
    sentence_ends = units(text, model)[1]
    n = len(text)
    for k, e in enumerate(sentence_ends):
        if k + 1 == len(sentence_ends):
            e, strength = n, PARAGRAPH
        else:
            line = text.find("\n", e)
            nxt = e
            while nxt < n and text[nxt].isspace():
                nxt += 1
            strength = SENTENCE if line < 0 or line >= nxt else (PARAGRAPH if _PARAGRAPH.search(text, e, nxt) else LINE)
        if e - begin > room:
            for m in _WORD_END.finditer(text, begin + 1, e):
                w = m.start()
                while w - (ends[-1] if ends else 0) > room:
                    ends.append((ends[-1] if ends else 0) + room)
                    strengths.append(CUT)
                if w > (ends[-1] if ends else 0) and w < e:
                    ends.append(w)
                    strengths.append(WORD)
            while e - (ends[-1] if ends else 0) > room:
                ends.append((ends[-1] if ends else 0) + room)
                strengths.append(CUT)
        ends.append(e)
        strengths.append(strength)
        begin = e
    if not ends:  # blanks only
        ends, strengths = list(range(room, n, room)) + [n], [CUT] * len(range(room, n, room)) + [PARAGRAPH]
    return ends, strengths


def pieces(text: str | None, limit: int = 3000, overlap: int = 200, model: Model | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; ``model`` knows its sentences, without one the priors decide."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    if not text:
        return []
    n = len(text)
    if n <= limit:
        return [(0, n)]
    room = limit - overlap
    ends, strengths = _atoms(text, room, model or Model())
    m = len(ends)
    start = [0] + ends[:-1]
    end = ends[:]
    left, right = list(range(-1, m - 1)), list(range(1, m)) + [-1]
    alive = [True] * m
    version = [0] * m
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = right[a]
        if b >= 0 and end[b] - start[a] <= (limit if start[a] == 0 else room):
            heapq.heappush(heap, (strength_at[a], end[b] - start[a], a, version[a], version[b]))

    strength_at = strengths[:]  # strength of the border at the end of a segment
    for a in range(m - 1):
        offer(a)
    while heap:
        _, _, a, va, vb = heapq.heappop(heap)
        b = right[a] if alive[a] else -1
        if b < 0 or version[a] != va or version[b] != vb:
            continue
        end[a], strength_at[a] = end[b], strength_at[b]
        alive[b] = False
        version[a] += 1
        version[b] += 1
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    out = []
    for a in range(m):
        if alive[a]:
            out.append((max(0, start[a] - overlap) if out else 0, end[a]))
    return out


def split_records(df: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """(id, piece_no, start_char, end_char) of (id, text); repeated records are made one over the offsets."""
    sent = counted_model(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                found = [pieces(t, limit, overlap, sent.value) for t in texts]
                starts, ends = [[a for a, _ in p] for p in found], [[b for _, b in p] for p in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, ints), pa.array(ends, ints)], names=["id", "starts", "ends"])

    cut = df.where("id is not null and text is not null").select("id", "text").mapInArrow(run, "id string, starts array<int>, ends array<int>")
    once = cut.groupBy("id").agg(F.first(F.struct("starts", "ends")).alias("u"))
    return once.select("id", F.posexplode(F.arrays_zip("u.starts", "u.ends")).alias("piece_no", "x")).select(
        "id", "piece_no", F.col("x.starts").alias("start_char"), F.col("x.ends").alias("end_char")
    )
