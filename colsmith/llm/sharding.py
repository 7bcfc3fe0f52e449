"""Resharding by minimum-cost flow: from old shard sizes and new capacities to block transfers that move the fewest bytes.

A store is a set of folders with Parquet files and a layout, which tells the shard, rows and bytes of each file. ``reshard`` solves a transportation problem on the driver between the old shards' bytes and the new shards' room,
a matter of shard counts only, and lays each old shard's bytes out in file order: what stays comes first, then one block for each transfer. Files inside a block change their shard in the layout and are not touched;
files that a block boundary cuts are rewritten, by one job that reads only them. A row belongs to the block that holds its middle, so a boundary misses by half a row at most.

Rows larger than a 256th of a new shard would make that miss large. They are fewer than 256 a shard, whatever the data, so they are placed one by one on the driver: they stay while they fit, the rest goes,
largest first, to the shard with most room, and swaps even out what is left. The flow then works with the room that remains. Shards of a given number come out near equal; capacities given in bytes are limits,
raised together where they cannot hold all rows.

A row's size is the UTF-8 length of its text and ``ROW_BYTES``; null text has no bytes. Rows keep their order in a file and are told apart by file and place, so repeated rows, equal or null ids and hot shards
need no care; a shard may hold any share of the rows. Equal texts are not kept together: a text with a third of all rows could not be. All columns are kept in one struct, so no name can clash. Empty tables give empty layouts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from colsmith.session import BROADCAST_ROWS, checkpoint

ROW_BYTES = 16
LARGE = 256  # a row above this part of a new shard is placed on its own
FILE_BYTES = 1 << 28  # what a file of a new store holds when there are many


def transfers(supply: Sequence[int], room: Sequence[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Cheapest flow of all supplies into the rooms: bytes from each old to each new shard.

    ``cost`` is per byte; by default staying is free and every other move costs 1. Each round sends as much as it can along a shortest path in the residual graph, with
    potentials that keep all costs there above zero. The rooms must hold the supplies.
    """
    left, free = np.array(supply, np.int64), np.array(room, np.int64)
    n, m = len(left), len(free)
    if left.sum() > free.sum():
        raise ValueError("the rooms hold less than the supplies")
    cost = np.asarray(1.0 - np.eye(n, m) if cost is None else cost, float)
    flow, high = np.zeros((n, m), np.int64), np.zeros(n + m)
    while left.any():
        far = np.where(np.append(left > 0, np.zeros(m, bool)), 0.0, np.inf)
        origin, done = np.full(n + m, -1), np.zeros(n + m, bool)
        while True:
            node = int(np.argmin(np.where(done, np.inf, far)))
            if done[node] or far[node] == np.inf:
                break
            done[node] = True
            if node < n:  # forward to every new shard
                reach, ends = far[node] + cost[node] + high[node] - high[n:], slice(n, n + m)
            else:  # back along bytes that were sent
                reach = np.where(flow[:, node - n] > 0, far[node] - cost[:, node - n] + high[node] - high[:n], np.inf)
                ends = slice(0, n)
            nearer = reach < far[ends] - 1e-12
            far[ends] = np.where(nearer, reach, far[ends])
            origin[ends] = np.where(nearer, node, origin[ends])
        real = np.where(free > 0, far[n:] + high[n:], np.inf)
        node = n + int(np.argmin(real))
        high += np.where(far == np.inf, 0, far)
        path = [node]
        while origin[path[-1]] >= 0:
            path.append(int(origin[path[-1]]))
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], free[node - n], *(flow[b, a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[0]] -= amount
        free[node - n] -= amount
    return flow


def place_large(sizes: Sequence[int], old: Sequence[int], capacity: Sequence[float]) -> list[int]:
    """New shard of each large row; a row that fits in its old shard stays there if it can."""
    load, shard = np.zeros(len(capacity)), [-1] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda r: -sizes[r])
    for r in order:
        if old[r] < len(capacity) and load[old[r]] + sizes[r] <= capacity[old[r]]:
            shard[r] = old[r]
            load[old[r]] += sizes[r]
    for r in order:
        if shard[r] < 0:
            shard[r] = int(np.argmax(capacity - load))
            load[shard[r]] += sizes[r]
    for _ in range(4 * len(capacity)):  # even out the fullest and the emptiest
        over = load - capacity
        a, b = int(np.argmax(over)), int(np.argmin(over))
        gap = over[a] - over[b]
        if over[a] <= 0 or a == b:
            break
        mine = [r for r in order if shard[r] == a]
        theirs = sorted((r for r in order if shard[r] == b), key=lambda r: sizes[r])
        known = np.array([0, *(sizes[r] for r in theirs)])
        best = (gap / 2, None, None)
        for r in mine:
            for k in np.searchsorted(known, sizes[r] - gap / 2) + np.array([-1, 0]):
                if 0 <= k < len(known):
                    off = abs(sizes[r] - int(known[k]) - gap / 2)
                    best = min(best, (off, r, None if k == 0 else theirs[k - 1]), key=lambda x: x[0])
        if best[1] is None or best[0] >= gap / 2 * 0.999:
            break
        _, r, s = best
        change = sizes[r] - (0 if s is None else sizes[s])
        shard[r], load[a], load[b] = b, load[a] - change, load[b] + change
        if s is not None:
            shard[s] = a
    return shard


def level(total: int, shards: int, sizes: Sequence[int]) -> float:
    """Bytes of a shard when all are equal but those that one row fills."""
    for size in sorted(sizes, reverse=True):
        if shards == 1 or size <= total / shards:
            break
        total, shards = total - size, shards - 1
    return total / shards


def rooms(total: int, capacity: Sequence[float], load: Sequence[float], fill: bool = False) -> list[int]:
    """Room beside what is loaded: capacities as they are if they hold the total, else raised by one factor until they just do.

    ``fill`` also lowers them, so that all rooms are used up.
    """
    capacity, load = np.array(capacity, float), np.array(load, float)

    def free(factor):
        return np.maximum(0, factor * capacity - load)

    low, high = (0.0 if fill else 1.0), 2.0
    if free(low).sum() < total:
        while free(high).sum() < total:
            high *= 2
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if free(middle).sum() < total else (low, middle)
    else:
        high = low
    whole = [math.floor(x) for x in free(high)]
    most = sorted(range(len(whole)), key=lambda j: (load[j] >= high * capacity[j], whole[j] - free(high)[j]))
    for k in range(max(0, total - sum(whole))):
        whole[most[k % len(most)]] += 1
    return whole


@dataclass
class Store:
    """Sharded rows: the layout (shard, file, rows, bytes), the folders of its files and the type of a stored row."""

    layout: DataFrame
    folders: list[str]
    row: StructType

    def scan(self, files: DataFrame, whole: bool = False) -> DataFrame:
        """Size, file and place (``at``) of the rows of some files, the row itself if ``whole``, and the other columns of ``files``."""
        fields = [StructField("row", self.row)] * whole + [StructField("size", LongType()), StructField("shard", IntegerType())]
        rows = None
        for folder in self.folders:
            some = files.sparkSession.read.schema(StructType(fields)).parquet(folder).drop("shard")
            some = some.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            rows = some if rows is None else rows.unionByName(some)
        return rows.join(_small(files), "file")

    def read(self) -> DataFrame:
        """row, size, shard and slot; slots are gapless from 0 in each shard, in the order of files."""
        before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        first = checkpoint(self.layout.select("shard", "file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
        return self.scan(first, True).select("row", "size", "shard", (F.col("first") + F.col("at")).alias("slot"))


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast if its rows are few; larger tables of files are joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _layout(folder: str, spark) -> DataFrame:
    rows = spark.read.schema("size long, shard int").parquet(folder)
    return checkpoint(rows.groupBy("shard", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")))


def store(rows: DataFrame, folder: str, shard: Column, text: str = "text", shards: int = 1) -> Store:
    """Writes rows by shard. A task writes one file for each shard it has rows of; partitions are put together, without a shuffle, as far as files stay below ``FILE_BYTES``."""
    spark = rows.sparkSession
    size = (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + ROW_BYTES).cast("long")
    total = rows.select(size.alias("size")).agg(F.sum("size")).first()[0] or 0
    tasks = max(8 * spark.sparkContext.defaultParallelism, math.ceil(total / (FILE_BYTES * shards)))
    made = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), size.alias("size"), shard.cast("int").alias("shard"))
    made.coalesce(tasks).write.partitionBy("shard").parquet(folder)
    return Store(_layout(folder, spark), [folder], made.schema["row"].dataType)


def reshard(old: Store, target: str, shards: int | None = None, capacities: Sequence[float] | None = None, cost: np.ndarray | None = None) -> Store:
    """The store in ``shards`` equal shards, or with at most the given ``capacities`` in bytes; rewritten rows go to the folder ``target``.

    ``cost`` is per byte from each old to each new shard. Files that only change their shard, or not even that, stay where they are.
    """
    layout, spark = old.layout, old.layout.sparkSession
    sizes = {r["shard"]: r["bytes"] for r in layout.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    total = sum(sizes.values())
    if not total:
        return old
    limit = int(total / (len(capacities) if capacities is not None else shards) / LARGE)
    large = old.scan(layout.select("file", "shard")).where(F.col("size") > limit).collect()  # fewer than LARGE for each new shard
    capacity = np.array(capacities, float) if capacities is not None else np.full(shards, level(total, shards, [r["size"] for r in large]))
    goes = place_large([r["size"] for r in large], [r["shard"] for r in large], capacity)
    load, small = np.zeros(len(capacity)), [sizes.get(i, 0) for i in range(max(sizes) + 1)]
    for r, j in zip(large, goes):
        load[j] += r["size"]
        small[r["shard"]] -= r["size"]
    flow = transfers(small, rooms(sum(small), capacity, load, capacities is None), cost)
    ends = []
    for i, sent in enumerate(flow.tolist()):
        begin = 0
        for j in sorted((j for j, n in enumerate(sent) if n), key=lambda j: (j != i, j)):  # what stays comes first
            ends.append((i, begin, begin + sent[j], j))
            begin += sent[j]
    blocks = F.broadcast(spark.createDataFrame(ends, "was int, begin long, end long, goes int"))  # one row a transfer
    alone = F.broadcast(spark.createDataFrame([(r["file"], r["at"], r["size"], j) for r, j in zip(large, goes)], "file string, at long, large long, goes int"))

    sums = alone.groupBy("file").agg(F.sum("large").alias("large"), F.min("goes").alias("least"), F.max("goes").alias("most"))
    files = layout.withColumnRenamed("shard", "was").join(F.broadcast(sums), "file", "left").withColumn("small", F.col("bytes") - F.coalesce("large", F.lit(0)))
    before = Window.partitionBy("was").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("start", F.coalesce(F.sum("small").over(before), F.lit(0)))
    inside = [files["was"] == blocks["was"], F.col("start") >= F.col("begin"), F.col("start") + F.col("small") <= F.col("end"), F.col("small") > 0]
    files = files.join(blocks, inside, "left").drop(blocks["was"]).withColumn("shard", F.coalesce("goes", "least"))
    same = (F.coalesce("least", "shard") == F.col("shard")) & (F.coalesce("most", "shard") == F.col("shard"))
    files = files.withColumn("whole", F.coalesce(((F.col("small") == 0) | F.col("goes").isNotNull()) & same, F.lit(False)))
    files = checkpoint(files.select("file", "was", "start", "rows", "bytes", "shard", "whole"))
    kept, cut = files.where("whole").select("shard", "file", "rows", "bytes"), files.where("not whole")
    names = [r["file"] for r in cut.select("file").collect()]  # no more than block ends and large rows
    if not names:
        return Store(checkpoint(kept), old.folders, old.row)

    cut = cut.where(F.col("file").isin(names)).select("file", "was", "start")
    singles = alone.select("file", "at", "goes")
    others = old.scan(cut).where(F.col("file").isin(names)).join(singles, ["file", "at"], "left_anti")
    sofar = F.sum("size").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    others = others.withColumn("middle", 2 * (F.col("start") + sofar) - F.col("size"))
    within = [others["was"] == blocks["was"], F.col("middle") >= 2 * F.col("begin"), F.col("middle") < 2 * F.col("end")]
    ranges = checkpoint(others.join(blocks, within).groupBy("file", "goes").agg(F.min("at").alias("low"), F.max("at").alias("high")))

    rows = old.scan(cut.select("file"), True).where(F.col("file").isin(names))
    single = rows.join(singles, ["file", "at"]).select("row", "size", F.col("goes").alias("shard"))
    many = rows.join(singles, ["file", "at"], "left_anti").join(F.broadcast(ranges), "file").where("at between low and high")
    many.select("row", "size", F.col("goes").alias("shard")).unionByName(single).repartition("shard").write.partitionBy("shard").parquet(target)
    return Store(checkpoint(kept.unionByName(_layout(target, spark))), [*old.folders, target], old.row)
