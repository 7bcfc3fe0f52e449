"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents can be long, so similarity is containment: the share of an item's
distinct word shingles that a document holds. Items are partitioned by their number of shingles. A partition's sketch is the
``k`` smallest shingle hashes of an item, and a document is a candidate if it holds one of them. With
k > (1 - threshold) * shingles an item that is contained cannot miss, so k is exact for small items;
larger partitions stop at ``LARGEST_SKETCH`` minima, which miss with a chance of (1 - threshold) ** LARGEST_SKETCH.
Candidates are verified on all shingles of the item against the whole document.

Words are compared in lower case (A-Z). An item with fewer words than a shingle is one shingle of all its words; documents are
searched for windows of that length too. Null or empty items and documents match nothing. Repeated items and documents are all reported.

The benchmark is broadcast in blocks of at most ``BLOCK_SHINGLES`` shingles, one pass over the documents for each block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm import words as W
from colsmith.session import checkpoint

WORDS = 5  # words in a shingle
THRESHOLD = 0.8
LARGEST_SKETCH = 32
BLOCK_SHINGLES = 2_000_000  # shingles of one broadcast block: 32 MB
_MARKS = 1 << 20  # cells of the filter that most shingles of documents do not pass


class Index:
    """Sketches and full shingle sets of a block of items, grouped by words in a shingle."""

    def __init__(self, items: pd.DataFrame, threshold: float = THRESHOLD, words: int = WORDS):
        self.threshold = threshold
        self.names = items["item"].to_numpy()
        self.parts = []  # (words in a shingle, sketch hashes, their items, offsets of full sets, full sets)
        for width, own in items.groupby("width"):
            sets = [np.unique(np.array(x, np.int64).view(np.uint64)) for x in own["shingles"]]
            sizes = np.array([len(s) for s in sets])
            sketches = [s[np.argsort(W.mix(s))[: self.sketch_size(len(s))]] for s in sets]
            hashes = np.concatenate(sketches)
            at = np.repeat(own.index.to_numpy(), [len(s) for s in sketches])
            order = np.argsort(hashes, kind="stable")
            marks = np.zeros(_MARKS, bool)
            marks[(hashes % np.uint64(_MARKS)).astype(np.int64)] = True
            self.parts.append((int(width), hashes[order], at[order], dict(zip(own.index, sets)), marks, sizes))

    def sketch_size(self, n: int) -> int:
        """Minima of an item with n shingles; items of a power-of-two size class share the bound."""
        largest = 1 << max(0, int(n - 1).bit_length())
        return min(n, LARGEST_SKETCH, int((1 - self.threshold) * largest + 1e-9) + 1)

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """(row, place of the item, shingles in common, shingles of the item) of each verified pair."""
        hashes, _, _, rows = W.words(W.lower(data), offsets)
        for width, sketch, owner, sets, marks, _ in self.parts:
            values, index = W.shingles(hashes, rows, width)
            of = rows[index]
            near = np.flatnonzero(marks[(values % np.uint64(_MARKS)).astype(np.int64)])
            low = np.searchsorted(sketch, values[near], "left")
            many = np.searchsorted(sketch, values[near], "right") - low
            near, low, many = near[many > 0], low[many > 0], many[many > 0]
            if not len(near):
                continue
            place = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.stack([np.repeat(of[near], many), owner[place]], 1), axis=0)
            ends = np.searchsorted(of, pairs[:, 0], "right")
            begins = np.searchsorted(of, pairs[:, 0], "left")
            last = -1
            for (row, item), a, b in zip(pairs.tolist(), begins, ends):
                if row != last:
                    own, last = np.unique(values[a:b]), row
                full = sets[item]
                found = np.searchsorted(own, full)
                common = int((own[np.minimum(found, len(own) - 1)] == full).sum())
                if common >= self.threshold * len(full) - 1e-9:
                    yield row, item, common, len(full)


def item_shingles(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Id, words in a shingle and distinct shingles of each item that has words."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1)):
                hashes, _, _, rows = W.words(W.lower(data), offsets)
                for r in range(end - first):
                    own = hashes[np.searchsorted(rows, r, "left") : np.searchsorted(rows, r, "right")]
                    if len(own):
                        values, _ = W.shingles(own, np.zeros(len(own), np.int64), words)
                        yield pa.RecordBatch.from_pydict({
                            "item": batch.column(0).slice(first + r, 1), "width": pa.array([min(words, len(own))], pa.int32()),
                            "shingles": pa.array([np.unique(values).view(np.int64)], pa.list_(pa.int64()))})

    return benchmark.select(F.col(id_column).cast("long").alias("item"), F.col(text).cast("string")).mapInArrow(run, "item long, width int, shingles array<long>")


def _blocks(items: DataFrame):
    """Items of the benchmark in blocks that are small enough to broadcast."""
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r["item"], r["width"], r["shingles"]))
        size += len(r["shingles"])
        if size >= BLOCK_SHINGLES:
            yield pd.DataFrame(held, columns=["item", "width", "shingles"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["item", "width", "shingles"])


def contained(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Id, item_id, n_common and n_item of each item that a document contains."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, item_id long, n_common long, n_item long"
    rows, out = docs.select(id_column, F.col(text).cast("string")), None
    for block in _blocks(checkpoint(item_shingles(benchmark, item_id, item_text, words))):
        shared = spark.sparkContext.broadcast(Index(block, threshold, words))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for first, _, data, offsets in W.chunks(batch.column(1)):
                    found = list(index.search(data, offsets))
                    if found:
                        at, item, common, size = map(np.array, zip(*found))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + first)), pa.array(index.names[item], pa.int64()), pa.array(common), pa.array(size)],
                                                         [id_column, "item_id", "n_common", "n_item"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows that contain no item, with all their columns. Each block of the benchmark filters what the last one kept."""
    spark, place = docs.sparkSession, docs.columns.index(text)
    for block in _blocks(checkpoint(item_shingles(benchmark, item_id, item_text, words))):
        shared = spark.sparkContext.broadcast(Index(block, threshold, words))

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in W.chunks(batch.column(place)):
                    for row, *_ in shared.value.search(data, offsets):
                        keep[first + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
