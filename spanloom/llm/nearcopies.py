"""Problem 4: near-duplicate records, by pivot distance tables over Hamming distances of fingerprints.

Texts that are equal after blanks are unified form one class; everything below works on classes. The fingerprint of a
class has 320 symbols (one-permutation minima of the hashes of all substrings of 10 code points in 64 bins, under five
permutations); two classes differ in a symbol with probability 1 - similarity. Groups of five symbols block the
collection. In each block a few members are the reference fingerprints: the pivot table holds the Hamming distance of
every member to them. By the triangle inequality two members whose distances to some common reference differ by more
than the limit cannot be near copies, so pairs are discarded by their maximum coordinate difference; the survivors
are checked by their own distance and then exactly, on the full sets of substrings.

A block is only ever streamed: a member meets at most ``REFERENCES`` references, so a hot block costs time and table rows
in proportion to its members. Pairs of members are made and measured where the members of a reference meet, so pairs that
only share the furniture of a site, which grow with the square of its pages, take time but no disk.

Cases: null texts, empty texts and texts under ``min_chars`` are in no pair; repeated rows of an id are one record;
records with equal text are pairs of similarity 1; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, only_with, text_batches
from .hashing import Rolling, code_points, mix

SHINGLE, BINS, PERMUTATIONS, ROWS = 10, 64, 5, 5
SYMBOLS = BINS * PERMUTATIONS
#: Distances are taken over so many symbols of the fingerprint, one byte of each, which is what travels with pairs.
COMPARED = 160
REFERENCES = 4
#: Members of one reference that a task compares with each other; more are compared in parts.
MEMBERS = 4000
_MULTIPLIERS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 6)


def distance_limit(threshold: float) -> int:
    """Largest Hamming distance that a pair above the threshold has, five standard deviations included."""
    return int(COMPARED * (1 - threshold) + 5 * (COMPARED * threshold * (1 - threshold)) ** 0.5)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the substrings of ``size`` code points of a text whose blanks are unified."""
    points, _ = code_points([text])
    return np.unique(Rolling(points).every(size))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Symbols (uint16) of a set of hashes; an empty bin takes the symbol of the next filled one."""
    out = np.empty(SYMBOLS, dtype=np.uint16)
    if not len(hashes):
        out[:] = 0
        return out
    for k, m in enumerate(_MULTIPLIERS):
        x = hashes * m
        x ^= x >> np.uint64(31)
        x *= m
        x.sort()
        at = np.searchsorted(x, _EDGES)
        at[at == len(x)] = 0
        out[k * BINS : (k + 1) * BINS] = mix(x[at]) & np.uint64(0xFFFF)
    return out


def band_keys(symbols: np.ndarray) -> np.ndarray:
    """Block keys (rows of symbols in, one key for each group of ``ROWS`` symbols out)."""
    groups = symbols.reshape(len(symbols), PERMUTATIONS, BINS).transpose(0, 2, 1).astype(np.uint64)  # one symbol of each permutation
    key = np.zeros(groups.shape[:2], dtype=np.uint64) + np.arange(BINS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def unified(text: str = "text"):
    return F.regexp_replace(F.col(text), "[ \t\r\n]+", " ")


def fingerprints(records: DataFrame, min_chars: int) -> DataFrame:
    """(id, cls, sketch) of (id, text); ``cls`` is the hash of the unified text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                rows = [sketch(shingles(t)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["id", "cls", "sketch"])

    long = records.where(F.col("id").isNotNull() & (F.length("text") >= min_chars)).select("id", unified().alias("text"))
    return long.select("id", F.xxhash64("text", F.length("text")).alias("cls"), "text").mapInArrow(run, "id string, cls bigint, sketch binary")


def _compared(prints: DataFrame) -> DataFrame:
    """(cls, fp): the compared bytes of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            short = np.ascontiguousarray(symbols[:, :: SYMBOLS // COMPARED].astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in short], pa.binary())], names=["cls", "fp"])

    return prints.select("cls", "sketch").mapInArrow(run, "cls bigint, fp binary").groupBy("cls").agg(F.first("fp").alias("fp"))


def _blocks(classes: DataFrame) -> DataFrame:
    """(key, cls): each class in the blocks of its symbol groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
                keys = band_keys(symbols)
                cls = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cls)], names=["key", "cls"])

    return classes.select("cls", "sketch").mapInArrow(run, "key bigint, cls bigint")


def _references(blocks: DataFrame) -> DataFrame:
    """(ref, cls): every member of a block with the block's references, from a stream sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_before, refs = None, []
        for batch in batches:
            keys, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            out_ref, out_cls = [], []
            # blocks of one that touch no edge of the batch need no look
            look = np.flatnonzero((sizes > 1) | (starts == 0) | (starts + sizes == len(keys)))
            for k in look.tolist():
                a, n = int(starts[k]), int(sizes[k])
                if keys[a] != key_before:
                    key_before, refs = keys[a], []
                members = cls[a : a + n]
                for r in refs:
                    out_ref.append(np.full(n, r))
                    out_cls.append(members)
                i = 0
                while len(refs) < REFERENCES and i < n:
                    rest = members[i + 1 :]
                    out_ref.append(np.full(len(rest), members[i]))
                    out_cls.append(rest)
                    refs.append(members[i])
                    i += 1
            if out_ref:
                r, c = np.concatenate(out_ref), np.concatenate(out_cls)
                keep = r != c
                yield pa.RecordBatch.from_arrays([pa.array(r[keep]), pa.array(c[keep])], names=["ref", "cls"])

    sorted_blocks = blocks.repartition("key").sortWithinPartitions("key", "cls")
    return sorted_blocks.mapInArrow(run, "ref bigint, cls bigint").distinct()


def _distances(pairs: DataFrame, classes: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the Hamming distance ``dist`` of the fingerprints of columns a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4000):
                part = batch.slice(s, 4000)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), dtype=np.uint8).reshape(-1, COMPARED) for k in (2, 3))
                dist = (x != y).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dist)], names=[a, b, "dist"])

    left = classes.select(F.col("cls").alias(a), F.col("fp").alias("x"))
    right = classes.select(F.col("cls").alias(b), F.col("fp").alias("y"))
    return pairs.join(left, a).join(right, b).select(a, b, "x", "y").mapInArrow(run, f"{a} bigint, {b} bigint, dist int")


def _near(table: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b, of members of a common reference of ``table`` whose fingerprints differ in at most ``limit`` symbols.

    Pairs are made, discarded by their coordinate difference and measured in the task that has the members of a reference; only
    near ones leave it. A reference with more than ``MEMBERS`` members is cut in parts, and each two parts meet in a task.
    """

    def measured(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(rows)
        dist, part, cls = (t.column(k).to_numpy() for k in ("dist", "part", "cls"))
        order = np.argsort(dist, kind="stable")
        dist, part, cls = dist[order], part[order], cls[order]
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), dtype=np.uint8).reshape(-1, COMPARED)[order]
        ends = np.searchsorted(dist, dist + limit, side="right")
        apart = t.column("lo")[0] != t.column("hi")[0]
        a, b = [], []
        for i in range(len(cls) - 1):
            at = np.arange(i + 1, ends[i])
            if apart:
                at = at[part[i + 1 : ends[i]] != part[i]]
            for s in range(0, len(at), 4000):
                some = at[s : s + 4000]
                some = some[np.count_nonzero(fps[some] != fps[i], axis=1) <= limit]
                a.append(np.minimum(cls[some], cls[i]))
                b.append(np.maximum(cls[some], cls[i]))
        return (np.concatenate(a), np.concatenate(b)) if a else (cls[:0], cls[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_before, rows = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for k, e in zip(starts, [*starts[1:], len(keys)]):
                key = tuple(keys[k].tolist())
                if key != key_before and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in measured(rows)], names=["a", "b"])
                    rows = []
                key_before = key
                rows.append(batch.slice(k, e - k))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in measured(rows)], names=["a", "b"])

    sizes = table.groupBy("ref").count().where("count > 1")
    hot = sizes.where(F.col("count") > MEMBERS).select("ref", F.ceil(F.col("count") / MEMBERS).alias("parts"))
    members = table.join(sizes.select("ref"), "ref", "left_semi").join(classes, "cls").join(F.broadcast(hot), "ref", "left").fillna(1, ["parts"])
    members = members.withColumn("part", F.expr("pmod(xxhash64(cls), parts)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    members = members.select("ref", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "cls", "dist", "part", "fp")
    return members.repartition("ref", "lo", "hi").sortWithinPartitions("ref", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact similarity is above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            out = []
            for a, b, x, y in zip(*cols):
                if a != last:
                    last, last_set = a, shingles(x)
                other = shingles(y)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                total = len(last_set) + len(other) - common
                similarity = common / total if total else 0.0
                if similarity > threshold:
                    out.append((a, b, similarity))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["a", "b", "similarity"]
            )

    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
    texts = only_with(texts, needed, "cls").groupBy("cls").agg(F.first("text").alias("text"))
    x = texts.select(F.col("cls").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("cls").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, similarity double")


def class_pairs(records: DataFrame, threshold: float = 0.6, min_chars: int = 400) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, cls) of all records in scope, and (a, b, similarity) of classes above the threshold."""
    limit = distance_limit(threshold)
    prints = checkpointed(fingerprints(records, min_chars))
    members = prints.select("id", "cls").distinct()
    classes = _compared(prints)
    table = checkpointed(_distances(_references(_blocks(prints)), classes, "ref", "cls"))
    # pairs with a reference itself are decided by their own distance
    direct = table.where(F.col("dist") <= limit).select(F.least("ref", "cls").alias("a"), F.greatest("ref", "cls").alias("b"))
    survivors = checkpointed(direct.union(_near(table, classes, limit)).distinct())
    texts = records.where(F.col("id").isNotNull() & (F.length("text") >= min_chars)).select(unified().alias("text"))
    texts = texts.select(F.xxhash64("text", F.length("text")).alias("cls"), "text")
    return members, _verify(survivors, texts, threshold)


def record_pairs(records: DataFrame, threshold: float = 0.6, min_chars: int = 400) -> DataFrame:
    """(doc_id_a, doc_id_b) of all pairs of different records above the threshold, ``doc_id_a < doc_id_b``."""
    members, links = class_pairs(records, threshold, min_chars)
    members = checkpointed(members)
    x, y = members.select(F.col("id").alias("i"), F.col("cls").alias("a")), members.select(F.col("id").alias("j"), F.col("cls").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select("i", "j")
    within = x.join(y, (F.col("a") == F.col("b")) & (F.col("i") < F.col("j"))).select("i", "j")
    both = across.union(within)
    return both.select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))
