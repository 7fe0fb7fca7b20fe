"""Problem 8: documents in containers of fixed capacity, by bounded-space online packing.

Each partition keeps at most ``WINDOWS`` open containers. An item goes to the open container with the least room that
still holds it; when none does, the fullest one is emitted and a new one opened. Containers still open at the end of a
partition are not emitted but packed again, as whole items, by the same rule over fewer partitions, round by round, until
one partition is left; so at most ``WINDOWS`` containers of the whole collection stay open at the end.

Items larger than the capacity are cut: full containers first, the rest is an item of its own. Items of size 0 (null and
empty texts) need no room and go to whatever container is at hand. Every document is assigned exactly once, or in
consecutive parts if it was cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WINDOWS = 64
#: Open containers of so many partitions are packed together in one task of the next round.
FAN_IN = 32


class Packer:
    """Open containers of one partition; ids are handed out in order from ``first``."""

    def __init__(self, capacity: int, first: int, windows: int = WINDOWS):
        self.capacity, self.next, self.windows = capacity, first, windows
        self.by_room: list[list[int]] = []  # [room, id], ascending by room
        self.closed: list[int] = []

    def place(self, size: int) -> int:
        """Id of the container that takes an item of ``size`` at most the capacity."""
        from bisect import bisect_left, insort

        k = bisect_left(self.by_room, [size, -1])
        if k < len(self.by_room):
            room, cid = self.by_room.pop(k)
        else:
            if len(self.by_room) >= self.windows:
                self.closed.append(self.by_room.pop(0)[1])
            room, cid = self.capacity, self.next
            self.next += 1
        room -= size
        if room:
            insort(self.by_room, [room, cid])
        else:
            self.closed.append(cid)
        return cid


def _pack(df: DataFrame, capacity: int, round_no: int) -> DataFrame:
    """(item, part, size, container, open) of (item, size): one packing round, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, (round_no << 56) | (TaskContext.get().partitionId() << 32))
        rows: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = size or 0
                if size <= capacity:
                    rows.append((item, 0, size, packer.place(size)))
                    continue
                for part in range(size // capacity):
                    rows.append((item, part, capacity, packer.place(capacity)))
                if size % capacity:
                    rows.append((item, size // capacity, size % capacity, packer.place(size % capacity)))
        # rows are numbers only; a partition's rows are held until it is known which containers stay open
        stay = {cid for _, cid in packer.by_room}
        for a in range(0, len(rows), 50_000):
            cols = np.array(rows[a : a + 50_000], dtype=np.int64).reshape(-1, 4)
            is_open = np.fromiter((c in stay for c in cols[:, 3].tolist()), dtype=bool, count=len(cols))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[:, 0]), pa.array(cols[:, 1].astype(np.int32)), pa.array(cols[:, 2]), pa.array(cols[:, 3]), pa.array(is_open)], names=["item", "part", "size", "container", "open"]
            )

    return df.mapInArrow(run, "item bigint, part int, size bigint, container bigint, open boolean")


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(item, part, start, size, container) of (item, size): item ids are longs, ``start`` is where the part begins."""
    first = checkpointed(_pack(sizes.select("item", "size"), capacity, 0))
    placed = first.select("item", "part", "size", "container")
    left = first.where("open").groupBy(F.col("container").alias("item")).agg(F.sum("size").alias("size"))
    parts, round_no = max(1, first.rdd.getNumPartitions()), 1
    while parts > 1 or round_no == 1:
        parts = -(-parts // FAN_IN)
        # larger leftovers first: best-fit then fills their gaps with the small ones
        again = checkpointed(_pack(left.repartition(parts, "item").sortWithinPartitions(F.desc("size"), "item"), capacity, round_no))
        moved = again.select(F.col("item").alias("container"), F.col("container").alias("to"))
        placed = placed.join(moved, "container", "left").select("item", "part", "size", F.coalesce("to", "container").alias("container"))
        left = again.where("open").groupBy(F.col("container").alias("item")).agg(F.sum("size").alias("size"))
        round_no += 1
    return placed.select("item", "part", (F.col("part").cast("bigint") * capacity).alias("start"), "size", "container")
