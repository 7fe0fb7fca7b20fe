"""Problem 5: long exact spans shared between records, by window minimisers and hashes of windows.

A relative Lempel-Ziv parse of every document against every reference block would read all texts once for each block. In
its place windows are compared under their anchors. A factor of at least ``length`` code points contains a whole window of ``length``, and each window has one anchor: the
substring of ``ANCHOR`` code points with the least hash in it. Equal windows have equal anchors at equal places, so the
index of reference blocks is keyed by anchor: the block of an anchor is the text under all windows that chose it.

Records are factored block by block. Where the whole block stands in another record the factor runs through it, which
its hash shows; only at factor boundaries, where the anchor is known elsewhere but the block as a whole is not, the
texts of the blocks of that anchor are brought together and compared window by window; those of an anchor that very many
blocks share are compared by window hash instead, spread over all tasks. Touching and overlapping factors
are joined to maximal stretches.

Cases: null, empty and shorter texts have no rows; repeated rows of an id are one record, whose own repeats do not
count; the result does not depend on the order of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, text_batches
from .hashing import Rolling, code_points

#: Code points of an anchor. Longer anchors are rarer by chance, shorter ones make fewer blocks.
ANCHOR = 120
_LOW = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in three passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    y = np.concatenate([x, np.full(pad, top, dtype=np.uint64)]) if pad else x
    table = y.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(texts: list[str], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window start, last window start, anchor hash, block hash) of all blocks, in order.

    Starts are offsets in their text. The block of windows a..b is the text [a, b + length).
    """
    points, offsets = code_points(texts)
    empty = np.zeros(0, dtype=np.int64)
    if len(points) < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    rolling = Rolling(points)
    anchors = rolling.every(ANCHOR)
    place = np.arange(len(anchors), dtype=np.uint64)
    order = (anchors & ~_LOW) | (place & _LOW) if len(anchors) <= int(_LOW) else None
    width = length - ANCHOR + 1
    if order is not None:
        chosen = (_sliding_min(order, width) & _LOW).astype(np.int64)
    else:  # one huge text: rank the anchors instead, so that places need not fit beside the hash
        rank = np.empty(len(anchors), dtype=np.uint64)
        rank[np.lexsort((place, anchors))] = place
        back = np.empty(len(anchors), dtype=np.int64)
        back[rank.astype(np.int64)] = np.arange(len(anchors))
        chosen = back[_sliding_min(rank, width).astype(np.int64)]
    starts = np.arange(len(chosen), dtype=np.int64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + length <= offsets[owner + 1]
    starts, chosen, owner = starts[inside], chosen[inside], owner[inside]
    if not len(starts):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    a, b, who, anchor = starts[first], starts[last], owner[first], chosen[first]
    whole = rolling.spans(a, b + length)
    # where the anchor stands in the block is part of what makes blocks equal
    return who, a - offsets[who], b - offsets[who], anchors[anchor], whole


def _block_rows(records: DataFrame, length: int) -> DataFrame:
    """(anchor, whole, rec, a, b) of all blocks of (id, text); ``rec`` is a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(iter([batch])):
                rec = part.column(0).to_numpy(zero_copy_only=False)
                who, a, b, anchor, whole = blocks(texts, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rec[who]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                    names=["anchor", "whole", "rec", "a", "b"],
                )

    return records.select("rec", "text").mapInArrow(run, "anchor bigint, whole bigint, rec bigint, a int, b int")


def _boundary_windows(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, rec, a, open, block) for (rec, text, parts): the texts of blocks that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, all_texts in text_batches(iter([batch])):
                rows = []
                for rec, text, parts in zip(part.column(0).to_pylist(), all_texts, part.column(2).to_pylist()):
                    for p in parts:
                        rows.append((p["anchor"], rec, p["a"], p["open"], text[p["a"] : p["b"] + length]))
                cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())],
                    names=["anchor", "rec", "a", "open", "block"],
                )

    return texts.mapInArrow(run, "anchor bigint, rec bigint, a int, open boolean, block string")


#: Bytes of blocks of several anchors that are compared at once.
_ROUND = 4_000_000
#: An anchor with more blocks to compare is hot: its windows are compared by hash across tasks, so no task holds its blocks.
HOT_BLOCKS = 2_000


def _hot_windows(texts: DataFrame, length: int) -> DataFrame:
    """(hash, rec, start, open) of all windows of the blocks of (rec, text, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, all_texts in text_batches(iter([batch])):
                for rec, text, parts in zip(part.column(0).to_pylist(), all_texts, part.column(2).to_pylist()):
                    hashes = Rolling(code_points([text])[0]).every(length).view(np.int64)
                    for p in parts:
                        own = hashes[p["a"] : p["b"] + 1]
                        n = len(own)
                        columns = [pa.array(own), pa.array(np.full(n, rec)), pa.array(np.arange(p["a"], p["b"] + 1, dtype=np.int32)), pa.array(np.full(n, p["open"]))]
                        yield pa.RecordBatch.from_arrays(columns, names=["hash", "rec", "start", "open"])

    return texts.mapInArrow(run, "hash bigint, rec bigint, start int, open boolean")


def _compare_hot(texts: DataFrame, length: int) -> DataFrame:
    """(rec, start, end): windows of open blocks of hot anchors that another record has; counted before they are shuffled."""
    windows = checkpointed(_hot_windows(texts, length))
    known = windows.groupBy("hash").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("hash")
    return windows.where("open").join(known, "hash", "left_semi").select("rec", "start", (F.col("start") + length).alias("end"))


def _shared_runs(rec: np.ndarray, a: np.ndarray, is_open: np.ndarray, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rec, start, end) of runs of windows of open blocks that stand in a block of another record."""
    points, offsets = code_points(texts)
    hashes = Rolling(points).every(length)
    counts = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = hashes[at + offsets[owner]]
    order = np.argsort(h, kind="stable")
    hs, rs = h[order], rec[owner[order]]
    first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    sizes = np.diff(np.r_[first, len(hs)])
    different = np.minimum.reduceat(rs, first) != np.maximum.reduceat(rs, first)
    shared = np.zeros(len(h), dtype=bool)
    shared[order] = np.repeat(different, sizes)
    shared &= is_open[owner]
    begins = np.flatnonzero(shared & np.r_[True, ~shared[:-1] | (owner[1:] != owner[:-1])])
    stops = np.flatnonzero(shared & np.r_[~shared[1:] | (owner[1:] != owner[:-1]), True])
    who = owner[begins]
    return rec[who], a[who] + at[begins], a[who] + at[stops] + length


def _compare(parts: DataFrame, length: int) -> DataFrame:
    """(rec, start, end) from blocks partitioned and sorted by anchor."""
    names = ["rec", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            out = _shared_runs(t.column(1).to_numpy(), t.column(2).to_numpy().astype(np.int64), t.column(3).to_numpy(), t.column(4).to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            # complete anchors may be compared together; the last one of a batch may go on in the next
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if held and (cut > 0 or held[-1].column(0)[-1].as_py() != keys[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                    size += held[-1].nbytes
                if size >= _ROUND:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(cut))
            else:
                held.append(batch)
            size += held[-1].nbytes
        if held:
            yield flush(held)

    return parts.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "rec", "a", "open", "block").mapInArrow(run, "rec bigint, start int, end int")


def join_stretches(spans: DataFrame, key: str = "rec") -> DataFrame:
    """Maximal stretches of (key, start, end): spans that overlap or touch become one."""
    w = W.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = marked.withColumn("no", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("no")


def shared_spans(records: DataFrame, length: int = 300) -> DataFrame:
    """(rec_id, start_char, end_char): maximal stretches of (id, text) covered by windows that another record has too."""
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    long = records.where(F.col("id").isNotNull() & (F.length("text") >= length)).select("id", F.xxhash64("id").alias("rec"), "text")
    by_anchor, by_block = W.partitionBy("anchor"), W.partitionBy("anchor", "whole")
    rows = _block_rows(long, length)
    # a first pass over hashes alone leaves the blocks whose anchor another record has
    known = rows.groupBy("anchor").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("anchor")
    shared = checkpointed(rows.join(known, "anchor", "left_semi").distinct())
    judged = (
        shared.withColumn("settled", F.min("rec").over(by_block) != F.max("rec").over(by_block))
        .withColumn("lowest", F.row_number().over(by_block.orderBy("rec", "a")) == 1)
        .withColumn("highest", F.row_number().over(by_block.orderBy(F.desc("rec"), "a")) == 1)
        .withColumn("all_settled", F.min("settled").over(by_anchor))
    )
    judged = checkpointed(judged.where("settled or not all_settled"))
    through = judged.where("settled").select("rec", F.col("a").alias("start"), (F.col("b") + length).alias("end"))
    # at factor boundaries: open blocks, and of each kind of settled ones two to hold them against, of different records
    is_open = ~F.col("settled")
    border = judged.where(~F.col("all_settled") & (is_open | F.col("lowest") | F.col("highest")))
    border = border.select("anchor", "rec", F.struct("anchor", "a", "b", is_open.alias("open")).alias("p"))
    hot = border.groupBy("anchor").count().where(F.col("count") > HOT_BLOCKS).select("anchor", F.lit(True).alias("hot"))
    border = border.join(hot, "anchor", "left")
    grouped = border.groupBy("rec").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.col("p"))).alias("parts"), F.collect_list(F.when(F.col("hot"), F.col("p"))).alias("hot_parts")
    )
    wanted = checkpointed(grouped)
    once = long.join(wanted.select("rec"), "rec", "left_semi").groupBy("rec").agg(F.first("text").alias("text")).join(wanted, "rec")
    windows = _boundary_windows(once.where("size(parts) > 0").select("rec", "text", "parts"), length)
    found = through.union(_compare(windows, length))
    if not wanted.where("size(hot_parts) > 0").isEmpty():
        found = found.union(_compare_hot(once.where("size(hot_parts) > 0").select("rec", "text", F.col("hot_parts").alias("parts")), length))
    spans = join_stretches(found)
    names = long.select("id", "rec").distinct()
    return spans.join(names, "rec").select(F.col("id").alias("rec_id"), F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def shared_shares(records: DataFrame, length: int = 300) -> DataFrame:
    """(rec_id, n_chars, shared_chars, share): for each record how much of its text stands elsewhere too."""
    spans = shared_spans(records, length).groupBy("rec_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    sizes = records.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("rec_id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    joined = sizes.join(spans, "rec_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint"))
    return joined.select("rec_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("share"))
