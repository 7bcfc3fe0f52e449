"""Counts of the values of columns, many values a row.

A task sorts the values of a stretch of its rows and counts them column by column. What it found goes to the others as sorted runs,
one row a column and bucket of values, so that a shuffle moves few rows whatever the number of distinct values; runs of a bucket that
meet are merged and stay packed, with their partial sums beside them. Every value has one place, so counts are exact. Texts travel the
same way, in buckets of a hash, and come out one value a row. Numpy and Arrow do the work on arrays, Spark partitions, shuffles, stores and sums.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

STRETCH_BYTES = 64 << 20  # of rows that a task counts at a time, and their number
STRETCH_ROWS = 1 << 20
RUN_VALUES = 1 << 16  # of a row of merged counts
BUCKET_BITS = 12
BLOCK_TEXTS = 1 << 13  # hashed at a time
# Values are multiplied by an odd number and so spread over the buckets; its inverse gives them back.
SPREAD = 0x9E3779B97F4A7C15
BACK = pow(SPREAD, -1, 1 << 64)

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

RUNS = "k int, bucket int, v binary, n binary, nulls long"
SUMS = {
    "present": "long", "distinct": "long", "top": "long", "n_log": "double", "low": "double", "high": "double", "total": "double",
    "zeros": "long", "positives": "long", "negatives": "long", "decimals": "long", "encoded": "long",
}
COUNTS = "k int, v binary, n binary, nulls long, " + ", ".join(f"{c} {t}" for c, t in SUMS.items())
TEXT_RUNS = "k int, bucket int, v binary, size binary, n binary, nulls long"
TEXT_COUNTS = "k int, v string, n long"


@contextmanager
def batches_of_rows(spark: SparkSession):
    """Arrow batches end after a number of rows only; for rows of bounded size. With a limit of bytes Spark adds up the sizes of all columns after each row, which takes longer than the transfer."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of an array that end at ``ends`` as binary values."""
    offsets = np.concatenate(([0], ends * data.itemsize)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _array(column: pa.Array, dtype) -> np.ndarray:
    """The binary values of a column one after the other as one array."""
    if not len(column):
        return np.empty(0, dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(dtype) if offsets[-1] > offsets[0] else np.empty(0, dtype)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.cast(pa.binary()) if pa.types.is_large_binary(whole.type) else whole


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def _by_stretch(counted: Callable) -> Callable:
    """Run ``counted`` on stretches of a task's rows."""
    def run(batches):
        held, size, rows = [], 0, 0
        for batch in batches:
            held.append(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
            if size >= STRETCH_BYTES or rows >= STRETCH_ROWS:
                yield from counted(held)
                held, size, rows = [], 0, 0
        if held:
            yield from counted(held)

    return run


def _by_bucket(merged: Callable) -> Callable:
    """Run ``merged`` on whole buckets of rows that are ordered by column and bucket."""
    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # Buckets before the last one of the batch are complete.
            k, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((k != k[-1]) | (bucket != bucket[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            whole = held[:-1] + [batch.slice(0, cut)]
            if cut or (len(held) > 1 and (held[-2].column(0)[-1] != batch.column(0)[0] or held[-2].column(1)[-1] != batch.column(1)[0])):
                yield from merged(pa.Table.from_batches(whole))
                held = [batch.slice(cut)]
        if held:
            yield from merged(pa.Table.from_batches(held))

    return run


def _runs(ks: list[int]) -> Callable:
    """Sorted counts of each column in stretches of a task's rows."""
    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for place, k in enumerate(ks):
            column = table.column(place)
            x = column.drop_null().to_numpy() if column.null_count else column.to_numpy()
            if x.dtype == np.float64:
                x = x + 0.0  # one zero
            x = np.sort(x.view(np.uint64) * np.uint64(SPREAD))
            first = _starts(x)
            values, n = x[first], np.diff(np.append(first, len(x)))
            bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
            begin = _starts(bucket)
            ends = np.append(begin[1:], len(values))[:len(begin)]
            nulls = np.zeros(len(begin), np.int64)
            if column.null_count:
                bucket, begin = np.append(bucket, np.int32(0)), np.append(begin, len(values))
                ends, nulls = np.append(ends, len(values)), np.append(nulls, column.null_count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(begin), k, np.int32)), pa.array(bucket[begin]), _binary(values, ends), _binary(n.astype(np.int64), ends), pa.array(nulls)],
                names=["k", "bucket", "v", "n", "nulls"])

    return _by_stretch(counted)


def _sums(v: np.ndarray, n: np.ndarray, number: bool, real: bool, encoded: list[float]) -> list:
    """Partial sums of merged counts in the order of ``SUMS``."""
    found = [int(n.sum()), len(n), int(n.max()), float((n * np.log2(n)).sum())]
    if not number:
        return found + [None] * 8
    x = v if real else v.astype(np.float64)
    held = lambda c: int(n[c].sum())
    with np.errstate(all="ignore"):
        return found + [float(x.min()), float(x.max()), float((x * n).sum()), held(x == 0), held(x > 0), held(x < 0), held(np.fmod(x, 1) != 0), held(np.isin(x, encoded))]


def _merged(numbers: set[int], reals: set[int], encoded: list[float]) -> Callable:
    """Counts of each column from runs that are ordered by column and bucket; all runs of a bucket are in one task."""
    names = [c.split(" ")[0] for c in COUNTS.split(", ")]

    def merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        k = rows.column("k").to_numpy()
        for begin, end in zip(first := _starts(k), np.append(first[1:], len(k))):
            own, part = int(k[begin]), rows.slice(begin, end - begin)
            v, n = _array(_plain(part.column("v")), np.uint64), _array(_plain(part.column("n")), np.int64)
            nulls, made = int(part.column("nulls").to_numpy().sum()), []
            if len(v):
                if n.max() == 1:
                    v = np.sort(v)
                    starts = _starts(v)
                    n = np.diff(np.append(starts, len(v)))
                else:
                    order = np.argsort(v, kind="stable")
                    v = v[order]
                    starts = _starts(v)
                    n = np.add.reduceat(n[order], starts)
                v = (v[starts] * np.uint64(BACK)).view(np.float64 if own in reals else np.int64)
                for at in range(0, len(v), RUN_VALUES):
                    x, m = v[at:at + RUN_VALUES], n[at:at + RUN_VALUES]
                    made.append([own, x.tobytes(), m.astype(np.int64).tobytes(), 0, *_sums(x, m, own in numbers, own in reals, encoded)])
            if nulls:
                made.append([own, b"", b"", nulls, 0, 0, *[None] * (len(SUMS) - 2)])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    types = [{"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}[c.split(" ")[1]] for c in COUNTS.split(", ")]

    return _by_bucket(merged)


def packed_counts(frames: list[tuple[DataFrame, list[int], list[bool]]], numbers: Iterable[int], encoded: Iterable[float]) -> DataFrame:
    """Counts of the values of all columns of the frames, which are bigint or double; each frame comes with the numbers of its columns and whether they are double."""
    runs = reduce(DataFrame.unionByName, [df.mapInArrow(_runs(ks), RUNS) for df, ks, _ in frames])
    reals = {k for _, ks, kinds in frames for k, real in zip(ks, kinds) if real}
    met = runs.repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    return met.mapInArrow(_merged(set(numbers), reals, [float(e) for e in encoded]), COUNTS)


_WEIGHTS = np.random.default_rng(0).integers(0, 1 << 63, 512, np.uint64) * np.uint64(2) + np.uint64(1)  # of the places of a text's bytes


def _text_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls one after the other, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _text_buckets(texts: pa.Array) -> np.ndarray:
    """Bucket of each text, from all of its bytes, some thousand texts at a time."""
    data, offsets = _text_parts(texts)
    found = np.empty(len(texts), np.uint64)
    for at in range(0, len(texts), BLOCK_TEXTS):
        ends = offsets[at:at + BLOCK_TEXTS + 1]
        own, ends = data[ends[0]:ends[-1]], ends - ends[0]
        place = (np.arange(len(own)) - np.repeat(ends[:-1], np.diff(ends))) & (len(_WEIGHTS) - 1)
        upto = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own + np.uint64(1)) * _WEIGHTS[place], out=upto[1:])
        found[at:at + BLOCK_TEXTS] = upto[ends[1:]] - upto[ends[:-1]]
    return (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _text_runs(ks: list[int]) -> Callable:
    """Counts of each text column in stretches of a task's rows, ordered by bucket."""
    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for place, k in enumerate(ks):
            column = table.column(place)
            found = column.drop_null().value_counts()
            texts, n = found.field("values").cast(pa.string()), found.field("counts").to_numpy()
            bucket = _text_buckets(texts)
            order = np.argsort(bucket.astype(np.uint16), kind="stable")
            texts, n, bucket = texts.take(pa.array(order)), n[order], bucket[order]
            data, offsets = _text_parts(texts)
            begin = _starts(bucket)
            ends = np.append(begin[1:], len(n))[:len(begin)]
            bucket, upto, nulls = bucket[begin], offsets[ends], np.zeros(len(begin), np.int64)
            if column.null_count:
                bucket, upto, ends, nulls = np.append(bucket, np.int32(0)), np.append(upto, len(data)), np.append(ends, len(n)), np.append(nulls, column.null_count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), k, np.int32)), pa.array(bucket), _binary(data, upto), _binary(np.diff(offsets).astype(np.int32), ends), _binary(n.astype(np.int64), ends),
                 pa.array(nulls)], names=["k", "bucket", "v", "size", "n", "nulls"])

    return _by_stretch(counted)


def _text_merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Counts of the texts of whole buckets, one value a row."""
    k = rows.column("k").to_numpy()
    for begin, end in zip(first := _starts(k), np.append(first[1:], len(k))):
        part = rows.slice(begin, end - begin)
        data, size, n = (_array(_plain(part.column(c)), t) for c, t in (("v", np.uint8), ("size", np.int32), ("n", np.int64)))
        offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64))).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        values, total = texts.dictionary, np.zeros(len(texts.dictionary), np.int64)
        np.add.at(total, texts.indices.to_numpy(), n)
        nulls = int(part.column("nulls").to_numpy().sum())
        if nulls:
            values, total = pa.concat_arrays([values, pa.nulls(1, pa.string())]), np.append(total, nulls)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), k[begin], np.int32)), values, pa.array(total)], names=["k", "v", "n"])


def text_counts(frames: list[tuple[DataFrame, list[int]]]) -> DataFrame:
    """(k, v, n): how often each text stands in each column of the frames, which are short texts; each frame comes with the numbers of its columns."""
    runs = reduce(DataFrame.unionByName, [df.mapInArrow(_text_runs(ks), TEXT_RUNS) for df, ks in frames])
    met = runs.repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    return met.mapInArrow(_by_bucket(_text_merged), TEXT_COUNTS)


def each_run(counts: DataFrame, wanted: dict[int, bool], make: Callable, schema: str, gathered: bool = False) -> DataFrame:
    """Rows that ``make(k, values, n)`` gives for the counts of some columns, as lists of arrays; ``wanted`` tells which hold doubles.

    ``gathered`` sums arrays of one length a column over the rows of a task first; ``make`` then returns those.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split(" ")[1]] for c in schema.split(", ")]

    def batch(k: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), k, np.int32)), *[pa.array(c, t) for c, t in zip(columns, types[1:])]], names=names)

    def run(batches):
        held = {}
        for rows in batches:
            for k, v, n in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2)):
                found = make(k, np.frombuffer(v.as_buffer(), np.float64 if wanted[k] else np.int64), np.frombuffer(n.as_buffer(), np.int64))
                if gathered:
                    held[k] = [a + b for a, b in zip(held[k], found)] if k in held else found
                elif len(found[0]):
                    yield batch(k, found)
        for k, sums in held.items():
            full = np.flatnonzero(sums[0])
            yield batch(k, [full, *[s[full] for s in sums]])

    return counts.where(F.col("k").isin(*wanted) & (F.col("present") > 0)).select("k", "v", "n").mapInArrow(run, schema)


def moment_sums(counts: DataFrame, facts: dict[int, tuple]) -> DataFrame:
    """(k, near, far, s2, s3, s4): rows outside two fences and powers around the mean; ``facts`` has whether a column holds doubles, its mean and its four fences."""
    def make(k, values, n):
        _, mean, *fences = facts[k]
        x = values.astype(np.float64)
        outside = [0 if low is None else int(n[(x < low) | (x > high)].sum()) for low, high in (fences[:2], fences[2:])]
        if mean is None:
            return [[c] for c in (*outside, None, None, None)]
        with np.errstate(all="ignore"):
            g = x - mean
            return [[c] for c in (*outside, *(float((n * power).sum()) for power in (g * g, g * g * g, g * g * g * g)))]

    return each_run(counts, {k: f[0] for k, f in facts.items()}, make, "k int, near long, far long, s2 double, s3 double, s4 double")


_TENS = np.array([10 ** i for i in range(1, 20)], np.uint64)


def digit_sums(counts: DataFrame, ks: Iterable[int]) -> DataFrame:
    """(k, sized, length_sum, length_squares, phones, plain): what whole numbers look like as text."""
    def make(k, values, n):
        digits = np.searchsorted(_TENS, np.abs(values).view(np.uint64), side="right") + 1
        size = digits + (values < 0)
        return [[int(c)] for c in (n.sum(), (size * n).sum(), (size * size * n).sum(), n[(values >= 0) & (digits >= 10) & (digits <= 15)].sum(), n[values >= 0].sum())]

    return each_run(counts, dict.fromkeys(ks, False), make, "k int, sized long, length_sum long, length_squares long, phones long, plain long")


def _step(values: np.ndarray, low: float, width: float, steps: int) -> np.ndarray:
    return np.minimum(np.floor((values.astype(np.float64) - low) / width * steps), steps - 1).astype(np.int64)


def step_counts(counts: DataFrame, ends: dict[int, tuple], steps: int) -> DataFrame:
    """(k, step, n, size): rows and values in equal steps of each column; ``ends`` has whether it holds doubles, its least value and the width from there to the greatest."""
    def make(k, values, n):
        step = _step(values, *ends[k][1:], steps)
        size = np.bincount(step, minlength=steps)
        rows = np.zeros(steps, np.int64)
        np.add.at(rows, step, n)
        return [size, rows]

    found = each_run(counts, {k: e[0] for k, e in ends.items()}, make, "k int, step int, size long, n long", gathered=True)
    return found.groupBy("k", "step").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def step_values(counts: DataFrame, ends: dict[int, tuple], steps: int, asked: dict[int, list[tuple]]) -> DataFrame:
    """(k, i, x, n): the values of some steps; ``asked`` has the number and the first and last step of each stretch of a column."""
    def make(k, values, n):
        step = _step(values, *ends[k][1:], steps)
        at = [(i, np.flatnonzero((step >= first) & (step <= last))) for i, first, last in asked[k]]
        return [np.concatenate(c) for c in ([np.full(len(a), i) for i, a in at], [values[a].astype(np.float64) for _, a in at], [n[a] for _, a in at])]

    return each_run(counts, {k: ends[k][0] for k in asked}, make, "k int, i int, x double, n long")


def value_rows(counts: DataFrame, wanted: dict[int, bool]) -> DataFrame:
    """(k, x, n): the counts one value a row."""
    return each_run(counts, wanted, lambda k, values, n: [values.astype(np.float64), n], "k int, x double, n long")
