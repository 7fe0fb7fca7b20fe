"""Problem 7: byte-level BPE of whole tables by a backtracking encoder.

The encoder never replays the merge list. All vocabulary entries form one Aho-Corasick automaton; at each
position the longest entry is taken, and two neighbours are accepted only if the pair-compatibility test says that
plain BPE would leave that border alone. When a neighbour does not fit, the next shorter entry is tried, then
the entry before it is taken back. Each position is ruled out at most once, so the time is linear in the text.

Cases: null and empty texts give an empty list; special-token strings are plain text; ids decode to the exact bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: A worker forgets its cached pieces beyond this number, so that memory stays bounded.
CACHE_PIECES = 400_000


def _ranges(test, top: int) -> str:
    """Character class body of all code points below ``top`` that pass the test."""
    out, start = [], None
    for cp in range(top + 1):
        ok = cp < top and not 0xD800 <= cp < 0xE000 and test(chr(cp))
        if ok and start is None:
            start = cp
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


def split_patterns() -> tuple[str, str, str]:
    """The public splitting pattern for ASCII texts, texts without astral characters, and all texts.

    The standard ``re`` engine is faster than one with Unicode properties, so the classes are spelt out; it tests small
    classes faster, so each text gets the smallest that covers it. Letters and numbers come first, which changes
    nothing: no other alternative can begin where they match.
    """
    import regex

    letters, numbers = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    out = []
    for top in (0x80, 0x10000, 0x110000):
        a, n, w = _ranges(letters.match, top), _ranges(numbers.match, top), "".join(c for c in WHITE if ord(c) < top)
        out.append(f" ?[{a}]+| ?[{n}]+|'(?:[stmd]|re|ve|ll)| ?[^{w}{a}{n}]+|[{w}]+(?![^{w}])|[{w}]+")
    return tuple(out)


def read_ranks(path: str = VOCAB) -> list[bytes]:
    """Vocabulary entries by id from a rank file (base64 bytes and rank on each line)."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    out: list[bytes] = [b""] * len(pairs)
    for entry, rank in pairs:
        out[int(rank)] = base64.b64decode(entry)
    return out


class Vocabulary:
    """Tables of the backtracking encoder; ids are merge ranks, as in rank files."""

    def __init__(self, entries: list[bytes], splits: np.ndarray | None = None):
        self.entries = entries
        self.ids = {b: i for i, b in enumerate(entries)}
        self.lengths = [len(b) for b in entries]
        self.pairs: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(entries))), list(range(len(entries)))
        if splits is None:
            self._learn_splits()
        else:
            self.left, self.right = splits[0].tolist(), splits[1].tolist()
            self.pairs = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.shorter: list[int] | None = None

    def _learn_splits(self) -> None:
        """The pair whose merge makes each entry: the one split into two entries that plain BPE brings together."""
        ids = self.ids
        for i, b in enumerate(self.entries):
            if len(b) < 2:
                continue
            for k in range(1, len(b)):
                x, y = ids.get(b[:k]), ids.get(b[k:])
                if x is not None and y is not None and x < i and y < i and self.compatible(x, y):
                    self.left[i], self.right[i] = x, y
                    self.pairs[x, y] = i
                    break

    def splits(self) -> np.ndarray:
        return np.array([self.left, self.right], dtype=np.int32)

    def compatible(self, a: int, b: int) -> bool:
        """Whether plain BPE over the bytes of both entries yields exactly these two."""
        pairs, left, right = self.pairs, self.left, self.right
        limit = 1 << 31
        while True:
            made = pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:  # a was made later than b: open a first
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def _automaton(self) -> None:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for i, b in enumerate(self.entries):
            auto.add_word(b.decode("latin-1"), i)
        auto.make_automaton()
        self.auto = auto
        ids = self.ids
        self.shorter = [-1] * len(self.entries)
        for i, b in enumerate(self.entries):
            for k in range(len(b) - 1, 0, -1):
                p = ids.get(b[:k])
                if p is not None:
                    self.shorter[i] = p
                    break

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the splitting pattern, in time linear in its length."""
        whole = self.ids.get(piece)
        if whole is not None and (len(piece) < 2 or self.left[whole] != whole):
            return [whole]
        if self.shorter is None:
            self._automaton()
        n, lengths, shorter, compatible = len(piece), self.lengths, self.shorter, self.compatible
        longest = [-1] * (n + 1)
        best = [0] * (n + 1)
        for end, i in self.auto.iter(piece.decode("latin-1")):
            size = lengths[i]
            start = end + 1 - size
            if size > best[start]:
                best[start], longest[start] = size, i
        open_at = [True] * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + lengths[token]
                if open_at[end] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    pos, token = end, longest[end]
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_at[pos] = False
                token = out.pop()
                pos -= lengths[token]
                break
        return out

    def decode(self, ids) -> bytes:
        """Bytes of the ids by one offset table over the joined entries."""
        joined, offsets = self.decode_table()
        return b"".join(joined[offsets[i] : offsets[i + 1]] for i in ids)

    def decode_table(self) -> tuple[bytes, list[int]]:
        if not hasattr(self, "_table"):
            offsets = [0]
            for b in self.entries:
                offsets.append(offsets[-1] + len(b))
            self._table = b"".join(self.entries), offsets
        return self._table


class Encoder(dict):
    """Whole texts to ids. As a dict it remembers the id bytes of pieces already met, by piece."""

    def __init__(self, vocabulary: Vocabulary, patterns: tuple[str, str, str] | None = None):
        super().__init__()
        self.vocabulary = vocabulary
        self.narrow, self.middle, self.wide = (re.compile(p).findall for p in patterns or split_patterns())

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.vocabulary.encode_piece(piece.encode("utf-8", "replace")), dtype=np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def id_bytes(self, text: str | None) -> bytes:
        """Little-endian int32 ids; no bytes for null and empty texts."""
        if not text:
            return b""
        if len(self) > CACHE_PIECES:
            self.clear()
        if text.isascii():
            pieces = self.narrow(text)
        elif len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            pieces = self.middle(text)
        else:
            pieces = self.wide(text)
        return b"".join(map(self.__getitem__, pieces))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.id_bytes(text), dtype=np.int32).tolist()


_DRIVER: dict[str, tuple] = {}
_WORKER: dict[tuple, Encoder] = {}


def _tables(path: str) -> tuple[list[bytes], np.ndarray]:
    """Entries and splits, made once in the driver; their size is that of the vocabulary, not of the data."""
    if path not in _DRIVER:
        entries = read_ranks(path)
        _DRIVER[path] = entries, Vocabulary(entries).splits()
    return _DRIVER[path]


def worker_encoder(shared, key) -> Encoder:
    """The encoder of this Python worker, built once from the broadcast tables."""
    if key not in _WORKER:
        entries, splits, patterns = shared.value
        _WORKER[key] = Encoder(Vocabulary(entries, splits), patterns)
    return _WORKER[key]


def share_tables(spark, path: str = VOCAB):
    """Broadcast of the encoder's tables (about 2 MB, bounded by the vocabulary file)."""
    entries, splits = _tables(path)
    if "patterns" not in _DRIVER:
        _DRIVER["patterns"] = split_patterns()
    return spark.sparkContext.broadcast((entries, splits, _DRIVER["patterns"]))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCAB, out: str = "ids") -> DataFrame:
    """(id, ids) of every row: no shuffle, one pass over id and text; other columns are not read."""
    shared = share_tables(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, path)
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                blobs, size, stop = [], 0, start
                while stop < len(texts) and size < 8_000_000:
                    blobs.append(encoder.id_bytes(texts[stop]))
                    size += len(blobs[-1])
                    stop += 1
                offsets = np.zeros(len(blobs) + 1, dtype=np.int32)
                np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], names=[id_col, out])
                start = stop

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCAB, out: str = "n_tokens") -> DataFrame:
    """(id, number of ids) of every row, without building the lists."""
    shared = share_tables(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, path)
        for batch in batches:
            sizes = [len(encoder.id_bytes(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, `{out}` bigint")
