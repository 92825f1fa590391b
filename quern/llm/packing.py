"""Best-fit packing with conflicts: documents go into bins of a fixed capacity.

Texts longer than a bin are cut into pieces that fill a bin each, and a rest. Pieces are dealt to groups by hash and
packed within each group in the order of falling size. Open bins are ordered by residual; each carries a bitmap
of the sources and of the duplicate clusters it holds. The successor search starts at the residual equal to the
item's size and goes on to larger ones until it finds the tightest bin whose bitmap doesn't meet the item's.
Ranges of residuals in which every bin conflicts are skipped by the intersection of their bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, words_of

CAPACITY = 2048
#: Items that are packed together; more data means more groups of this size.
GROUP_ITEMS = 8192


class Bins:
    """Open bins of one group by residual; a tree over residuals holds the intersections of the bins' bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.width = 1 << capacity.bit_length()
        self.all = [-1] * (2 * self.width)  # -1, all bits: no bin here
        self.leaves: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.count = 0

    def _update(self, residual: int) -> None:
        common = -1
        for mask in self.leaves[residual]:
            common &= mask
        at = self.width + residual
        self.all[at] = common
        while at > 1:
            at >>= 1
            common = self.all[2 * at] & self.all[2 * at + 1]
            if self.all[at] == common:
                break
            self.all[at] = common

    def _successor(self, residual: int, mask: int) -> int:
        """Smallest residual from ``residual`` on where not every bin meets ``mask`` in one bit; -1 if none."""

        def free(at: int) -> bool:
            both = self.all[at]
            return both >= 0 and not both & mask or both < -1

        at = self.width + residual
        if residual > self.capacity:
            return -1
        if not free(at):
            while at > 1 and (at & 1 or not free(at + 1)):
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.width:
                at = 2 * at if free(2 * at) else 2 * at + 1
        return at - self.width

    def place(self, size: int, mask: int) -> tuple[int, int]:
        """(bin, offset) for an item; bins are numbered as they are opened."""
        residual = self._successor(size, mask)
        while residual >= 0:
            for held, bins in self.leaves[residual].items():
                if not held & mask:
                    number = bins.pop()
                    if not bins:
                        del self.leaves[residual][held]
                    self._update(residual)
                    self._put(number, residual - size, held | mask)
                    return number, self.capacity - residual
            residual = self._successor(residual + 1, mask)
        number, self.count = self.count, self.count + 1
        self._put(number, self.capacity - size, mask)
        return number, 0

    def _put(self, number: int, residual: int, mask: int) -> None:
        if residual:
            self.leaves[residual].setdefault(mask, []).append(number)
            self._update(residual)


def pack_items(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, items in the given order. A null source or cluster conflicts with nothing.

    Only what two items share needs a bit.
    """
    bits: dict[tuple[str, object], int] = {}
    seen: set[tuple[str, object]] = set()
    named = [[(kind, x) for kind, x in (("s", a), ("c", b)) if x is not None] for a, b in zip(sources, clusters, strict=True)]
    for names in named:
        for x in names:
            if x in seen:
                bits.setdefault(x, len(bits))
            seen.add(x)
    bins = Bins(capacity)
    return [bins.place(size, sum(1 << bits[x] for x in names if x in bits)) for size, names in zip(sizes, named, strict=True)]


def _pack_groups(capacity: int, limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows, group, batch = 0, None, 0

        def done() -> pd.DataFrame:
            items = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            none = lambda column: [None if pd.isna(x) else x for x in items[column]]
            places = pack_items([int(x) for x in items["length"]], none("source"), none("cluster"), capacity)
            items["bin"] = [f"{group:x}-{batch}-{b}" for b, _ in places]
            items["offset"] = [o for _, o in places]
            return items[["doc_id", "start", "length", "bin", "offset"]]

        for frame in frames:
            for key, part in frame.groupby("group", sort=False):
                while len(part):
                    if held and (key != group or rows >= limit):
                        yield done()
                        batch = batch + 1 if key == group else 0
                        held, rows = [], 0
                    elif not held and key != group:
                        batch = 0
                    group = key
                    held.append(part.iloc[: limit - rows])
                    part = part.iloc[limit - rows :]
                    rows += len(held[-1])
        if held:
            yield done()

    return run


def pack(df: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, start, length, bin, offset): where each piece of each row stands.

    No bin is above capacity, and no bin has two pieces that share a source or a duplicate cluster. The pieces of
    a row cover [0, size) once. Null sources and clusters conflict with nothing; a null or negative size counts
    as 0 and gives one piece of length 0; repeated rows are packed each. An empty input gives no
    rows. The number of groups follows the number of rows; a group beyond twice ``group_items`` (many equal
    rows) is packed in runs of that many, so a task's memory is bounded.
    """
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    rows = materialise(rows.withColumn("pieces", F.expr(f"greatest(size - 1, 0) div {int(capacity)} + 1")), "packing-rows")
    groups = max(1, -(-(rows.agg(F.sum("pieces")).collect()[0][0] or 0) // group_items))
    items = rows.select("doc_id", "size", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("k"))
    items = items.select("doc_id", (F.col("k") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("k") * capacity).alias("length"), "source", "cluster")
    items = items.withColumn("row_key", F.xxhash64("doc_id", "start", "length", "cluster")).withColumn("group", F.pmod("row_key", F.lit(groups)))
    dealt = items.repartition(min(groups, 10_000), "group").sortWithinPartitions("group", F.desc("length"), "row_key", "doc_id", "start")
    return dealt.mapInPandas(_pack_groups(capacity, 2 * group_items), "doc_id long, start long, length long, bin string, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by their words and one end mark; clusters are equal lower-case texts with blanks collapsed."""
    spread = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    sized = docs.select("doc_id", "source", (F.size(words_of(F.col("text"))) + 1).cast("long").alias("size"), F.xxhash64(F.btrim(spread)).alias("cluster"))
    return pack(sized, "doc_id", "size", "source", "cluster", capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, bin, offset."""
    return pack_documents(documents(spark, sf_dir))
