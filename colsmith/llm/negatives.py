"""Hard negatives: for an anchor and a near row of its label, the rows of other labels that score just below.

Scores are packed with the anchor's place and the row's id into one binary key (anchor, descending score, id). Keys are dealt by anchor and
sorted inside the partitions, and one pass over the sorted keys opens a window at each of an anchor's first positives and hands every following negative
to the windows that it lies in. Nothing is held of an anchor but its open windows.

Anchors are the stated queries, taken in blocks of ``ANCHORS``; a block is all that is broadcast or passes the driver, and each costs two scans. The first scan leaves every
task with its best ``positives`` rows an anchor; the sorted keys of all tasks then fix the positives. With their scores known, the second scan
leaves a task with its best ``negatives`` rows a window. Both are exact partial results, so what is shuffled grows with anchors and tasks and not with pairs.

Components become floor(scale * x) and scores are exact integers: products that might leave the 53 bits of a double are summed as Python integers,
and a score beyond 64 bits counts as the nearest 64-bit integer. Rows with a null label, a null vector or a null or non-finite component take no part, and neither do rows whose
vector is longer or shorter than the anchor's. Rows that share an id are never each other's partner; each such anchor gives its own (equal) rows.
A null id is never an anchor by a test on the id, and as a partner it comes before all ids of its score. An empty vector scores 0. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.session import checkpoint

ANCHORS = 1 << 16  # anchors of a block
ANCHOR_VALUES = 1 << 23  # components of a block, so that long vectors make smaller blocks
CELLS = 1 << 21  # scores computed at a time
EXACT = float(1 << 53)
NO_ID, NO_SCORE = np.iinfo(np.int64).min, np.iinfo(np.int64).min
_SIGN = np.uint64(1 << 63)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed(place: np.ndarray, score: np.ndarray, ident: np.ndarray) -> list[bytes]:
    """24 bytes a pair whose byte order is (place, descending score, id)."""
    parts = np.empty((len(score), 3), ">u8")
    parts[:, 0] = place
    parts[:, 1] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    parts[:, 2] = ident.astype(np.int64).view(np.uint64) ^ _SIGN
    raw = parts.tobytes()
    return [raw[i : i + 24] for i in range(0, len(raw), 24)]


def unpacked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, score and id of each key."""
    parts = np.frombuffer(b"".join(keys.to_pylist()), ">u8").reshape(-1, 3).astype(np.uint64)
    return parts[:, 0].astype(np.int64), (~parts[:, 1] ^ _SIGN).view(np.int64), (parts[:, 2] ^ _SIGN).view(np.int64)


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of equal length, as doubles; products beyond the doubles count as the largest."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    largest = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(values * scale, -largest, largest)).reshape(len(column), -1)


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, clipped to 64 bits."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if most(rows) * most(anchors) * max(1, rows.shape[1]) < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    out = exact(rows) @ exact(anchors).T if rows.shape[1] else np.zeros((len(rows), len(anchors)), object)
    return np.clip(out, NO_SCORE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The first ``k`` (descending score, id) pairs of each list, kept as sorted arrays; a pair's number is told along."""

    def __init__(self, lists: int, k: int):
        self.score = np.full((lists, k), NO_SCORE, np.int64)
        self.ident = np.full((lists, k), np.iinfo(np.int64).max, np.int64)
        self.number = np.full((lists, k), -1, np.int64)
        self.k = k

    def better(self, scores: np.ndarray, idents: np.ndarray, lists: slice) -> np.ndarray:
        """Cells of a (row, list) table that come before the last pair of their list."""
        last, least = self.score[lists, -1], self.ident[lists, -1]
        return (scores > last) | ((scores == last) & (idents[:, None] < least))

    def add(self, lists: np.ndarray, scores: np.ndarray, idents: np.ndarray, numbers: np.ndarray) -> None:
        touched, inverse = np.unique(lists, return_inverse=True)
        of = np.append(np.repeat(np.arange(len(touched)), self.k), inverse)
        score = np.append(self.score[touched].ravel(), scores)
        ident = np.append(self.ident[touched].ravel(), idents)
        number = np.append(self.number[touched].ravel(), numbers)
        order = np.lexsort((number < 0, ident, ~score, of))  # ~score falls as the score rises, without overflow
        begins = np.searchsorted(of[order], np.arange(len(touched)))
        first = order[begins[:, None] + np.arange(self.k)]
        self.score[touched], self.ident[touched], self.number[touched] = score[first], ident[first], number[first]


class Block:
    """Anchors of one vector length, ordered by id, with their positives' scores once these are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.positives: np.ndarray | None = None  # scores, one row an anchor; NO_SCORE where there are fewer

    def tiles(self, batches, scale: float) -> Iterator[tuple]:
        """First anchor, scores, ids, labels and numbers of tiles of the (row, anchor) table; rows of a tile are ordered by id."""
        number, wide = 0, self.vectors.shape[1]
        step = max(1, min(len(self.ids), CELLS // 64))
        high = max(64, CELLS // step)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(2)), wide))
            for at in range(0, batch.num_rows, high):
                part = batch.slice(at, high)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], part.column(1).to_numpy(zero_copy_only=False)[order]
                rows = _matrix(part.column(2), scale)[order]
                for a in range(0, len(self.ids), step):
                    yield a, _scores(rows, self.vectors[a : a + step]), ids, labels, number + np.arange(len(ids))
                number += len(ids)

    def nearest(self, batches, scale: float, k: int) -> Best:
        """The best rows of each anchor's label."""
        best = Best(len(self.ids), k)
        for a, scores, ids, labels, numbers in self.tiles(batches, scale):
            span = slice(a, a + scores.shape[1])
            fits = (labels[:, None] == self.labels[span]) & (ids[:, None] != self.ids[span])
            row, anchor = np.nonzero(fits & best.better(scores, ids, span))
            if len(row):
                best.add(anchor + a, scores[row, anchor], ids[row], numbers[row])
        return best

    def below(self, batches, scale: float, k: int, low: int, high: int) -> list[Best]:
        """The best rows of other labels in the window under each positive; one table of lists for each of an anchor's positives."""
        windows = [(Best(len(self.ids), k), *bounds(top, low, high)) for top in self.positives.T]
        for a, scores, ids, labels, numbers in self.tiles(batches, scale):
            span = slice(a, a + scores.shape[1])
            other = (labels[:, None] != self.labels[span]) & (ids[:, None] != self.ids[span])
            for best, first, last, some in windows:
                row, anchor = np.nonzero(other & (scores >= first[span]) & (scores <= last[span]) & some[span] & best.better(scores, ids, span))
                if len(row):
                    best.add(anchor + a, scores[row, anchor], ids[row], numbers[row])
        return [best for best, *_ in windows]


def bounds(top: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest score n with low * top <= 100 * n <= high * top, and whether there is a positive at all."""
    exact = [int(t) for t in top]
    clip = lambda v: max(NO_SCORE + 1, min(np.iinfo(np.int64).max, v))
    return (np.array([clip(-(-low * t // 100)) for t in exact], np.int64), np.array([clip(high * t // 100) for t in exact], np.int64), top != NO_SCORE)


def emit(batches, ids: np.ndarray, positives: int, negatives: int, low: int, high: int) -> Iterator[list[tuple]]:
    """Reads keys in order, opens a window at each of an anchor's first positives and gives it the negatives that lie in it.

    A negative with the positive's own score may come before it; the first of the current score are kept for windows that are yet to open.
    """
    place, windows, equal, level, out = -1, [], [], None, []

    def give(window, score, ident):
        if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
            window[2] += 1
            out.append((int(ids[place]), window[0], window[2], ident, window[1], score))

    for batch in batches:
        same = batch.column(1).to_pylist()
        for p, score, ident, positive in zip(*(x.tolist() for x in unpacked(batch.column(0))), same):
            if p != place:
                place, windows, equal, level = p, [], [], None
            if score != level:
                equal, level = [], score
            ident = None if ident == NO_ID else ident
            if positive:
                if len(windows) < positives:
                    windows.append([ident, score, 0])
                    for s, i in equal:
                        give(windows[-1], s, i)
            else:
                for window in windows:
                    give(window, score, ident)
                if len(equal) < negatives:
                    equal.append((score, ident))
        if out:
            yield out
            out = []


def _table(keys: list[bytes], positive: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([positive] * len(keys), pa.bool_())], ["key", "positive"])


def _keys(best: Best) -> list[bytes]:
    place, k = np.nonzero(best.number >= 0)
    return packed(place, best.score[place, k], best.ident[place, k])


def _blocks(anchors: DataFrame, scale: float) -> Iterator[Block]:
    """Anchors by length of vector and id, in blocks of bounded size."""
    held, length = [], None

    def block():
        column = pa.array([r["vector"] for r in held], pa.list_(pa.float64()))
        return Block(np.array([r["id"] for r in held], np.int64), np.array([r["label"] for r in held]), _matrix(column, scale))

    for r in anchors.orderBy(F.size("vector"), "id").toLocalIterator():
        if held and (len(r["vector"]) != length or len(held) >= ANCHORS or len(held) * length >= ANCHOR_VALUES):
            yield block()
            held = []
        held.append(r)
        length = len(r["vector"])
    if held:
        yield block()


def in_order(keys: DataFrame) -> DataFrame:
    """Dealt by the anchor in the key and sorted by the whole key."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def mine(rows: DataFrame, anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` tells which rows are anchors. A negative's score lies between ``low`` and ``high`` percent of the positive's; labels are integers.
    """
    spark = rows.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    taken = rows.select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    taken = taken.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(F.forall("vector", finite))
    values, out = taken.select("id", "label", "vector"), None
    for block in _blocks(checkpoint(taken.where("anchor and id is not null").select("id", "label", "vector")), scale):
        shared = spark.sparkContext.broadcast(block)

        def near(batches, shared=shared):
            found = _keys(shared.value.nearest(batches, scale, positives))
            if found:
                yield _table(found, True)

        def first(batches):
            place, kept = -1, 0
            for batch in batches:
                keep = []
                for p in unpacked(batch.column(0))[0].tolist():
                    place, kept = (p, kept + 1) if p == place else (p, 1)
                    keep.append(kept <= positives)
                yield batch.filter(pa.array(keep))

        opening = checkpoint(in_order(values.mapInArrow(near, "key binary, positive boolean")).mapInArrow(first, "key binary, positive boolean"))
        block.positives = np.full((len(block.ids), positives), NO_SCORE, np.int64)
        found = opening.select("key").toArrow().column(0)  # at most ``positives`` keys an anchor of the block
        if len(found):
            place, score, _ = unpacked(found)
            order = np.lexsort((~score, place))
            place, score = place[order], score[order]
            block.positives[place, np.arange(len(place)) - np.searchsorted(place, place)] = score
        windows = spark.sparkContext.broadcast(block)

        def under(batches, windows=windows):
            place, number, keys = [], [], []
            for best in windows.value.below(batches, scale, negatives, low, high):
                at, k = np.nonzero(best.number >= 0)
                place.append(at)
                number.append(best.number[at, k])
                keys.append(np.stack([best.score[at, k], best.ident[at, k]], 1))
            place, number, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, number, keys))
            if len(place):
                _, once = np.unique(np.stack([place, number], 1), axis=0, return_index=True)  # a row that lies in several windows goes once
                yield _table(packed(place[once], keys[once, 0], keys[once, 1]), False)

        def result(batches, windows=windows):
            for some in emit(batches, windows.value.ids, positives, negatives, low, high):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                                                 ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        pairs = opening.unionByName(values.mapInArrow(under, "key binary, positive boolean"))
        part = in_order(pairs).mapInArrow(result, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)
