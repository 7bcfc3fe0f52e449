"""Near-duplicate documents with SetSketch registers.

A document is the set of its distinct word shingles. Its sketch has ``REGISTERS`` registers. Each shingle is the seed of a
Poisson process whose points fall on the registers at random; the earliest point of a register, on an exponential scale of
base ``BASE`` and truncated to 16 bits, is its value. Registers of a union are the maxima, and two registers are equal about
as often as the Jaccard similarity says. A point later than all registers' earliest ones cannot matter, so long documents need few points
for each shingle.

1. Documents with the same set form a class, which its smallest id stands for.
2. Bands of ``ROWS`` registers are keys. All members of a key are paired with its smallest id.
3. Pairs whose sizes allow the similarity are estimated jointly from their registers by maximum likelihood; those that are well below the
   threshold (``MARGIN``) go, the others are verified on their full sets. Verified pairs are links.
4. A member that is still in another component than its key's smallest id could be linked to some other member. Those
   members are looked up exactly, by the rarest shingles of the sets (prefix filter with the sizes of both sets), among all documents with
   such a key; what is found goes through 3 as well. A pair of a key is so either verified, connected anyway, or shown to be
   below the threshold, and the pairs within a large group are never all made.
5. Components over all links give the groups.

With 40 bands of 5 registers a pair at the threshold of 0.8 shares no key with a chance of about 1e-7.

Null, empty and blank texts have no shingles and stand alone; so do rows with a null id, whose component is null. A text with fewer words
than a shingle is one shingle. Rows with equal ids are one document with several texts: each text links the id. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm import graph
from colsmith.llm import words as W
from colsmith.session import checkpoint

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
MARGIN = 0.15  # five standard errors of the estimate at the threshold
STRETCH = 2 << 20
CELLS = 1 << 20  # hashed counters that tell rare shingles from frequent ones
STEP = 1.05  # ratio of neighbouring size classes in the prefix filter


def registers(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Registers of each row's set of distinct values; a row without values has zeros."""
    earliest = np.full(n_rows * REGISTERS, np.inf)
    time, latest = np.zeros(len(values)), np.full(n_rows, np.inf)
    seeds, owner, k = values.copy(), rows.copy(), 0
    while len(seeds):
        k += 1
        draw = W.mix(seeds + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / REGISTERS
        place = owner * REGISTERS + (W.mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(earliest, place, time)
        if k <= 8 or k % 16 == 0:
            latest = earliest.reshape(n_rows, REGISTERS).max(1)
        alive = time < latest[owner]
        seeds, owner, time = seeds[alive], owner[alive], time[alive]
    found = np.floor(1 - np.log(np.where(np.isfinite(earliest), earliest, RATE * BASE * 2) / RATE) / np.log(BASE))
    return np.clip(found, 0, 65535).astype(np.uint16).reshape(n_rows, REGISTERS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of each row."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(W.mix(np.arange(BANDS, dtype=np.uint64)), (len(sketches), BANDS)).copy()
    for j in range(ROWS):
        out = W.mix(out + parts[:, :, j])
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity that makes the registers of each pair most likely, given the sizes of the sets."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        first, second = p(u - v * j), p(v - u * j)
        return more * np.log(first) + less * np.log(second) + equal * np.log(np.maximum(1 - first - second, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # golden-section search
        left, right = high - (high - low) * 0.618034, low + (high - low) * 0.618034
        better = likelihood(left) > likelihood(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


def _sets(data, offsets, k):
    hashes, _, _, rows = W.words(W.lower(data), offsets)
    values, index = W.shingles(hashes, rows, k)
    return W.distinct(values, rows[index])


def signatures(docs: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """id, n (shingles), a digest of the set in two numbers, and sketch."""

    @W.lean
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1), STRETCH):
                m = end - first
                values, rows = _sets(data, offsets, words)
                sketches = registers(values, rows, m)
                heads = np.searchsorted(rows, np.arange(m))
                sums = [np.diff(np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))[np.append(heads, len(rows))]).view(np.int64) for x in (W.mix(values), W.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, m), pa.array(np.bincount(rows, minlength=m).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                     pa.array([s.tobytes() for s in sketches], pa.binary())],
                    ["id", "n", "d1", "d2", "sketch"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "id long, n long, d1 long, d2 long, sketch binary")


def bands(sketches: DataFrame) -> DataFrame:
    """(key, id, n) for every band of (id, n, sketch)."""

    @W.lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = band_keys(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)).reshape(-1)
                ids, sizes = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), BANDS) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(sizes)], ["key", "id", "n"])

    return sketches.select("id", "n", "sketch").mapInArrow(run, "key long, id long, n long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of (id, text)."""

    @W.lean
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1)):
                values, rows = _sets(data, offsets, words)
                cuts = np.searchsorted(rows, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.view(np.int64)))], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the similarity."""

    @W.lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                found = estimate(a, b, part.column(2).to_numpy(zero_copy_only=False).astype(float), part.column(3).to_numpy(zero_copy_only=False).astype(float))
                yield part.select(["a", "b", "n_a", "n_b"]).filter(pa.array(found >= threshold - MARGIN))

    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("s_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return rows.mapInArrow(run, "a long, b long, n_a long, n_b long")


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    return checkpoint(shingle_sets(docs.join(ids, "id", "left_semi").select("id", "text"), words))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets are as similar as the threshold."""
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    percent = round(threshold * 100)
    return checkpoint(rows.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct())


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles fall into each cell; at most CELLS rows reach the driver."""

    @W.lean
    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _needed(a, b, percent: int):
    """Least number of common shingles of sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _by_prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of an outside document and another one, of different components, that may reach the threshold.

    In any fixed order of shingles, the first common one of such a pair stands before place n - needed + 1 in both sets.
    Rare shingles come first in the order, so what a whole group shares comes too late to pair its members.
    """
    percent = round(threshold * 100)
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    @W.lean
    def run(batches):
        counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made = batch.slice(at, 256), []
                for i, component, outside, shingles in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                    values = shingles.values.to_numpy()
                    n, order = len(values), np.lexsort((values, counts[values & (CELLS - 1)]))
                    least, most = -(-percent * n // 100), 100 * n // percent
                    own = int(np.log(n) / np.log(STEP) + 1e-9)
                    roles = [(False, own, n - _needed(n, least, percent) + 1)]
                    if outside:
                        first, last = (int(np.log(x) / np.log(STEP) + 1e-9) for x in (least, most))
                        roles += [(True, c, n - _needed(n, max(least, int(np.ceil(STEP**c - 1e-6))), percent) + 1) for c in range(first, last + 1)]
                    for role, c, length in roles:
                        if length > 0:
                            k = min(length, n)
                            made.append((values[order[:k]], np.arange(k), c, role, i, n, component))
                if made:
                    sizes = [len(m[0]) for m in made]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([m[0] for m in made])), pa.array(np.concatenate([m[1] for m in made]).astype(np.int32)),
                         *(pa.array(np.repeat([m[j] for m in made], sizes), kind) for j, kind in ((2, pa.int32()), (3, pa.bool_()), (4, pa.int64()), (5, pa.int64()), (6, pa.int64())))],
                        ["token", "place", "class", "outside", "id", "n", "component"])

    rows = checkpoint(sets.select("id", "component", "outside", "shingles").mapInArrow(run, "token long, place int, class int, outside boolean, id long, n long, component long"))
    left = rows.where("outside").select("token", "class", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"), F.col("component").alias("c_a"))
    right = rows.where("not outside").select("token", "class", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"), F.col("component").alias("c_b"))
    needed = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    fits = (F.col("c_a") != F.col("c_b")) & (F.col("p_a") <= F.col("n_a") - needed) & (F.col("p_b") <= F.col("n_b") - needed)
    return left.join(right, ["token", "class"]).where(fits).select("a", "n_a", "b", "n_b")


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs with a < b whose sizes allow the similarity."""
    ordered = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                          F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    allowed = 100 * F.least("n_a", "n_b") >= round(threshold * 100) * F.greatest("n_a", "n_b")
    return ordered.where(allowed & (F.col("a") < F.col("b"))).distinct()


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Id, n_shingles, component_id (smallest id that links reach) and kept (the smallest id itself) of every row."""
    signed = checkpoint(signatures(docs, id_column, text, words))
    some = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = checkpoint(some.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")))
    reps = some.join(classes, (some["id"] == classes["rep"]) & (some["d1"] == classes["d1"]) & (some["d2"] == classes["d2"]) & (some["n"] == classes["n"]), "left_semi")
    reps = checkpoint(reps.select("id", "n", "sketch"))

    banded = bands(reps)
    firsts = banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("many")).where("many > 1")
    members = checkpoint(banded.join(firsts, "key").select("key", "id", "n", "first", "many"))
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    stars = _pairs(members.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("first.id").alias("b"), F.col("first.n").alias("n_b")), threshold)
    stars = checkpoint(_likely(stars, reps, threshold))
    ids = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    links = _verified(stars, _sets_of(own, ids, words), threshold)
    labels = graph.components(links)

    of = labels.select("id", "component")
    first_of = of.select(F.col("id").alias("first_id"), F.col("component").alias("first_component"))
    placed = members.where("many > 2").select("key", "id", F.col("first.id").alias("first_id")).join(of, "id", "left").join(first_of, "first_id", "left")
    placed = placed.select("key", "id", F.coalesce("component", "id").alias("component"), (F.coalesce("component", "id") != F.coalesce("first_component", "first_id")).alias("outside"))
    placed = checkpoint(placed)
    open_keys = placed.where("outside").select("key").distinct()
    involved = checkpoint(placed.join(open_keys, "key", "left_semi").groupBy("id").agg(F.first("component").alias("component"), F.max("outside").alias("outside")))
    sets = checkpoint(shingle_sets(own.join(involved, "id", "left_semi").select("id", "text"), words).join(involved, "id"))
    rest = checkpoint(_likely(_pairs(_by_prefix(sets, threshold), threshold), reps, threshold))
    more = _verified(rest, sets, threshold)
    if more.limit(1).count():
        labels = graph.components(links.unionByName(more).unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    found = signed.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    found = found.select("id", "n", component.alias("component"))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the smallest id of each group, with all their columns; rows with a null id stay."""
    gone = checkpoint(groups(docs, id_column, text, words, threshold).where("not kept").select(F.col(id_column).alias("gone_id")))
    return docs.join(gone, docs[id_column] == gone["gone_id"], "left_anti")
