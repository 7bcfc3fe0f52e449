"""Relations between columns: keys, correlations, associations, references."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import scalar as S
from colsmith.operators import profile as P
from colsmith.operators.features import named
from colsmith.session import checkpoint

KEY_SHARE = 0.995
STRONG_CORRELATION = 0.7
STRONG_ASSOCIATION = 0.5
PAIRS_PER_JOB = 60
# Values of more characters are counted by digest.
DIGEST_OVER = 64
SKETCH_BITS, SKETCH_ERROR = 15, 0.00575  # of distinct-count sketches, and their relative standard error when merged
CELLS_PER_TASK = 2_000_000  # keys of combinations that one task counts, and four times the rows of a task that holds many combinations
FEW_VALUES = 4096  # a column with no more values is shuffled as a few bits of digests that tell them apart
# Distinct values of a child column that stand for all of them in the screen of references, as expected, and what
# their overlap may fall short of the true one: by Hoeffding's bound the chance of more is below 1e-12.
SCREEN_VALUES = 4096
SCREEN_MARGIN = 0.06


def primary_keys(profile: DataFrame) -> DataFrame:
    return profile.where((F.col("null_count") == 0) & (F.col("row_count") > 0) & (F.col("unique_ratio") >= KEY_SHARE)).select(
        "table_name", "column_name", "unique_ratio")


def composite_keys(df: DataFrame, table_name: str, max_size: int = 3, include_supersets: bool = False) -> DataFrame:
    """Null-free combinations of two or three columns that are (nearly) unique.

    A combination can only reach the bar when the product of its columns' distinct counts does, which the profile
    knows, or a sketch of two of its columns times the others. Pairs that their sketches leave are counted exactly, and
    with them all larger combinations that have a column by which these rows meet anyway; only the others are sketched too.
    Supersets of keys already found are keys anyway and are skipped unless asked for.
    """
    rows = P.profile({table_name: df}, {"values"}).select("column_name", "row_count", "null_count", "unique_count", "unique_ratio", "top_count").collect()
    full = [r for r in rows if r["null_count"] == 0 and r["row_count"]]
    distinct = {r["column_name"]: r["unique_count"] for r in full}
    tops = {r["column_name"]: r["top_count"] for r in full}
    n = full[0]["row_count"] if full else 0
    keys = [{r["column_name"]} for r in full if r["unique_ratio"] >= KEY_SHARE]
    plain = P.standardise(df)
    most = {}  # of distinct rows that a pair can have

    def reach(names: tuple) -> float:
        product = math.prod(distinct[c] for c in names)
        return min([product, *[most.get(pair, product) * product // math.prod(distinct[c] for c in pair) for pair in combinations(names, 2)]])

    def candidates(size: int) -> list[tuple]:
        return [names for names in combinations(distinct, size) if (include_supersets or not any(k <= set(names) for k in keys)) and reach(names) >= KEY_SHARE * n]

    def near(wanted: list[tuple]) -> list[tuple]:
        kept = []
        for start in range(0, len(wanted), PAIRS_PER_JOB):
            group = wanted[start:start + PAIRS_PER_JOB]
            # A sketch of every candidate in one pass; only those near the bar are counted exactly.
            sketches = plain.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(SKETCH_BITS))).alias(f"s{i}")
                                   for i, names in enumerate(group)]).first()
            most.update((names, math.ceil(sketches[f"s{i}"] * (1 + 6 * SKETCH_ERROR))) for i, names in enumerate(group))
            kept += [names for i, names in enumerate(group) if sketches[f"s{i}"] >= (KEY_SHARE - 6 * SKETCH_ERROR) * n]
        return kept

    wanted = near(candidates(2)) if max_size > 1 else []
    pairs, anchors = list(wanted), {anchor for anchor, group in _meetings(wanted, tops) if len(group) > 1}
    for size in range(3, max_size + 1):
        larger = candidates(size)
        counted = {names for names in larger if anchors & set(names) or any(set(pair) < set(names) for pair in pairs)}
        wanted += [*counted, *near([names for names in larger if names not in counted])]
    counts = _distinct_combinations(plain, wanted, n, tops, distinct)
    found = []
    for names in sorted(counts, key=lambda w: (len(w), [*distinct].index(w[0]), w)):
        if counts[names] / n >= KEY_SHARE and (include_supersets or not any(k < set(names) for k in keys)):
            found.append((table_name, list(names), counts[names] / n))
            keys.append(set(names))
    return df.sparkSession.createDataFrame(found, "table_name string, columns array<string>, unique_ratio double")


def _meetings(wanted: list[tuple], tops: dict[str, int]) -> list[tuple[str | None, list[tuple]]]:
    """Combinations by the column that makes their rows meet: few columns, no value of which holds many rows; None for the rest."""
    groups, left = [], sorted(set(wanted))
    while left:
        shared = {c: [w for w in left if c in w] for c in {c for w in left for c in w} if tops[c] <= CELLS_PER_TASK // 16}
        anchor = max(sorted(shared), key=lambda c: len(shared[c]), default=None)
        groups.append((anchor, left if anchor is None else shared[anchor]))
        left = [w for w in left if w not in groups[-1][1]]
    return groups


def _distinct_rows(group: list[tuple], columns: dict[str, tuple[int, int, int]]) -> Callable:
    """Counts of distinct rows of each combination among the rows of one task; ``columns`` has the place of each column and its bits there."""
    order = list(columns)
    places = [[order.index(c) for c in names] for names in group]

    def coded(rows: pa.Table, place: int, shift: int, bits: int) -> tuple[np.ndarray, int]:
        values = rows.column(place).combine_chunks()
        if bits:
            values = pa.array(values.to_numpy(zero_copy_only=False) >> shift & (1 << bits) - 1)
        codes = values.dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary)

    def run(batches):
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        found = []
        if rows is not None and rows.num_rows:
            codes, sizes = zip(*[coded(rows, *spot) for spot in columns.values()])
            for place in places:
                key, size = codes[place[0]], sizes[place[0]]
                for i in place[1:]:
                    if size * sizes[i] >= 1 << 63:
                        values, key = np.unique(key, return_inverse=True)
                        size = len(values)
                    key, size = key * sizes[i] + codes[i], size * sizes[i]
                key = np.sort(key)
                found.append(1 + int(np.count_nonzero(key[1:] != key[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.int64())], ["k", "d"])

    return run


def _few_bits(plain: DataFrame, values: dict[str, Column], distinct: dict[str, int]) -> dict[str, int]:
    """As many bits of each column's digests as keep all its values apart, for columns of few values."""
    small = [c for c in values if distinct.get(c, FEW_VALUES + 1) <= FEW_VALUES]
    if not small:
        return {}
    digests: dict[int, set] = {}
    cells = [F.struct(F.lit(i).alias("k"), F.xxhash64(values[c]).alias("h")) for i, c in enumerate(small)]
    for r in plain.select(F.inline(F.array(*cells))).distinct().collect():
        digests.setdefault(r["k"], set()).add(r["h"])
    enough = {c: [b for b in range(1, 33) if len({h & (1 << b) - 1 for h in digests.get(i, ())}) == distinct[c]] for i, c in enumerate(small)}
    return {c: bits[0] for c, bits in enough.items() if bits}


def _packed(values: dict[str, Column], bits: dict[str, int], anchor: str) -> tuple[list[Column], dict[str, tuple[int, int, int]]]:
    """The anchor first, then the other columns, those of few values as bits of shared words; and where each column is."""
    wide = [anchor, *[c for c in values if c != anchor and c not in bits]]
    made, places = [values[c] for c in wide], {c: (i, 0, 0) for i, c in enumerate(wide)}
    used = 64
    for c in values:
        if c not in places:
            if used + bits[c] > 63:
                made.append(F.lit(0).cast("bigint"))
                used = 0
            made[-1] = made[-1].bitwiseOR(F.shiftleft(F.xxhash64(values[c]).bitwiseAND(F.lit((1 << bits[c]) - 1)), used))
            places[c], used = (len(made) - 1, used, bits[c]), used + bits[c]
    return made, places


def _distinct_combinations(plain: DataFrame, wanted: list[tuple], n: int, tops: dict[str, int], distinct: dict[str, int] | None = None) -> dict[tuple, int]:
    """Exact distinct counts of combinations of columns without nulls.

    Equal combinations agree in each of their columns, so the rows are shuffled once by a column that many combinations
    share and no value of which holds many rows, and all these combinations are counted where the rows meet, by sorting
    codes of a bounded number of rows. Columns that have few values by ``distinct`` share words of a few bits each. Other
    combinations are shuffled one digest a row.
    """
    kinds = dict(plain.dtypes)

    def value(c: str) -> Column:
        column = F.col(f"`{c}`")
        if S.is_text_type(kinds[c]):
            return _short(column)
        return column + F.lit(0.0) if kinds[c] == "double" else column  # one zero

    def cell(i: int, names: tuple) -> Column:
        columns = [F.col(f"`{c}`") for c in names]
        return F.struct(F.lit(i).alias("__k"), F.xxhash64(*columns).alias("__a"), F.xxhash64(F.lit(1), *columns).alias("__b"))

    meetings = _meetings(wanted, tops)
    bits = _few_bits(plain, {c: value(c) for c in dict.fromkeys(c for anchor, group in meetings if anchor for names in group for c in names)}, distinct or {})
    found = {}
    for anchor, group in meetings:
        if anchor is not None:
            columns, places = _packed({c: value(c) for c in dict.fromkeys(c for names in group for c in names)}, bits, anchor)
            met = plain.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).repartition(max(1, math.ceil(4 * n / CELLS_PER_TASK)), "c0")
            counted = met.mapInArrow(_distinct_rows(group, places), "k int, d long").groupBy("k").agg(F.sum("d").alias("d"))
            found |= {group[r["k"]]: r["d"] for r in counted.collect()}
            continue
        for start in range(0, len(group), PAIRS_PER_JOB):
            some = group[start:start + PAIRS_PER_JOB]
            by = ["__k", "__a", "__b"]
            met = plain.select(F.inline(F.array(*[cell(i, names) for i, names in enumerate(some)]))).repartition(max(1, math.ceil(n * len(some) / CELLS_PER_TASK)), *by)
            counted = met.groupBy(*by).agg(F.lit(1).alias("one")).groupBy("__k").agg(F.count("one").alias("d"))
            found |= {some[r["__k"]]: r["d"] for r in counted.collect()}
    return found


def correlations(df: DataFrame, table_name: str, floor: float = STRONG_CORRELATION) -> DataFrame:
    """Pearson correlations of all pairs of number columns, both ways, strongest first per column.

    Columns without nulls go through one pass that sums the products of all their pairs as a matrix. A pair with
    nulls counts the rows that have both values; those pairs are put in long form inside each task and aggregated on the map side.
    """
    fields = [f for f in P.fields_of({table_name: df}) if f.is_number]
    rows, full = [], []
    if len(fields) > 1:
        plain = fields[0].frame
        facts = plain.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.nanvl(f.number, F.lit(None).cast("double"))).alias(f"c{i}") for i, f in enumerate(fields)]).first()
        full = [f for i, f in enumerate(fields) if facts["n"] > 1 and facts[f"c{i}"] == facts["n"]]
    if len(full) > 1:
        vectors = VectorAssembler(inputCols=[f"c{i}" for i in range(len(full))], outputCol="v").transform(plain.select(*[f.number.alias(f"c{i}") for i, f in enumerate(full)]))
        matrix = Correlation.corr(vectors, "v").first()[0].toArray()
        for (i, a), (j, b) in combinations(enumerate(full), 2):
            v = float(matrix[i, j])
            if v == v and abs(v) >= floor:
                rows += [(table_name, a.name, b.name, v), (table_name, b.name, a.name, v)]
    done = {id(f) for f in full} if len(full) > 1 else set()
    pairs = [(a, b) for a, b in combinations(fields, 2) if not (id(a) in done and id(b) in done)]
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        group = pairs[start:start + PAIRS_PER_JOB]
        cells = [F.struct(F.lit(i).alias("k"), a.number.alias("x"), b.number.alias("y")) for i, (a, b) in enumerate(group)]
        found = fields[0].frame.select(F.inline(F.array(*cells))).groupBy("k").agg(F.corr("x", "y").alias("v"))
        for r in found.collect():
            v, (a, b) = r["v"], group[r["k"]]
            if v is not None and v == v and abs(v) >= floor:
                rows += [(table_name, a.name, b.name, v), (table_name, b.name, a.name, v)]
    rows.sort(key=lambda r: (r[1], -abs(r[3]), r[2]))
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, other string, correlation double")


def _short(value: Column) -> Column:
    """The value itself, or a digest of a longer one under a mark that a short value cannot have at that length."""
    return F.when(F.length(value) <= DIGEST_OVER, value).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramér's V of pairs of columns.

    The full grid of cells is not needed: the statistic is n * (sum O^2 / (R * C) - 1) over the
    cells that occur. Tables of two by two get the continuity correction, which only needs the
    marginals and the deviation of any one cell. Both marginals are sums of the cell counts,
    so the data is shuffled once, after a map-side count. Values longer than a digest are keyed by their digest.
    """
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    keyed = df.select(*[_short(F.col(f"`{c}`").cast("string")).alias(f"v{i}") for i, c in enumerate(used)])
    cells = [F.struct(F.lit(i).alias("pair"), F.col(f"v{used.index(a)}").alias("x"), F.col(f"v{used.index(b)}").alias("y"))
             for i, (a, b) in enumerate(pairs)]
    rows = df.count()
    counted = keyed.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("pair", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("o"))
    by_x = counted.groupBy("pair", "x").agg(F.sum("o").alias("r"))
    by_y = counted.groupBy("pair", "y").agg(F.sum("o").alias("c"))
    x_side = by_x.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), F.sum(1 / F.col("r")).alias("inv_r"), F.sum("r").alias("n"))
    y_side = by_y.groupBy("pair").agg(F.count(F.lit(1)).alias("cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    joined = counted.join(by_x, ["pair", "x"]).join(by_y, ["pair", "y"])
    total = joined.groupBy("pair").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"),
        F.max_by(F.struct("o", "r", "c"), F.struct("o", "x", "y")).alias("one"))
    found = total.join(x_side, "pair").join(y_side, "pair")
    n = F.col("n")
    deviation = F.greatest(F.abs(F.col("one.o") - F.col("one.r") * F.col("one.c") / n) - 0.5, F.lit(0.0))
    corrected = deviation * deviation * n * F.col("inv_r") * F.col("inv_c")
    plain = n * (F.col("q") - 1)
    small = F.least("rows", "cols") - 1
    chi2 = F.when((F.col("rows") == 2) & (F.col("cols") == 2), corrected).otherwise(plain)
    value = F.when(small > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.lit(float(rows)) * small))).otherwise(F.lit(0.0))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_name string, other string")
    return found.select("pair", value.alias("cramers_v")).join(F.broadcast(names), "pair").select("column_name", "other", "cramers_v")


def associations(df: DataFrame, table_name: str, floor: float = STRONG_ASSOCIATION, max_values: int = 50) -> DataFrame:
    """Strong associations between text columns or columns of few values, each pair once.

    A text column without nulls whose values are all different has one row a value, so its measure with any column of two or more values
    is sqrt(present / rows) by the formula and is not counted. The other pairs are counted a bounded number a job; only
    one row a pair reaches the driver.
    """
    rows = P.profile({table_name: df}, {"values"}).where((F.col("unique_count") <= max_values) | F.col("is_string")).select(
        "column_name", "unique_count", "present", "row_count", "is_string").collect()
    found, pairs = [], []
    for a, b in combinations(rows, 2):
        keyed = [k for k in (a, b) if k["is_string"] and k["row_count"] > 2 and k["unique_count"] == k["row_count"]]
        other = b if keyed and keyed[0] is a else a
        if keyed and other["present"] > 2 and other["is_string"]:
            value = (other["present"] / other["row_count"]) ** 0.5 if other["unique_count"] > 1 else 0.0
            found.append((a["column_name"], b["column_name"], value))
        else:
            pairs.append((a["column_name"], b["column_name"]))
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        found += [(r["column_name"], r["other"], r["cramers_v"]) for r in cramers_v(df, pairs[start:start + PAIRS_PER_JOB]).collect()]
    made = df.sparkSession.createDataFrame(found, "column_name string, other string, cramers_v double")
    return made.where(F.col("cramers_v") >= floor)


def schema_types(profile: DataFrame) -> DataFrame:
    """What kind of table it is, from shares and flags of its columns."""
    dates = F.col("is_temporal") | (F.col("is_string") & (F.coalesce(F.col("matches_iso_datetime"), F.lit(0.0)) >= 1))
    key = named("id", "_id", "key", "uuid", "guid") & (F.col("unique_ratio") > 0.9)
    facts = profile.groupBy("table_name").agg(
        F.count_if(dates).alias("temporal_columns"), F.count_if(key).alias("id_columns"), F.avg(F.col("is_numeric").cast("int")).alias("numeric_ratio"),
        F.count_if(F.col("is_string") & (F.col("unique_count") > 20)).alias("many_valued"), F.count(F.lit(1)).alias("total_columns"))
    ids, numeric = F.col("id_columns") > 0, F.col("numeric_ratio")
    cases = [
        ((F.col("temporal_columns") > 0) & (numeric > 0.5), "time_series", 0.8), (ids & (F.col("many_valued") > 0), "transactional", 0.75),
        (ids & (1 - numeric > 0.6), "hierarchical", 0.7), ((numeric > 0.7) & (F.col("total_columns") > 20), "feature_rich", 0.65)]
    chosen = S.first_match([(c, F.struct(F.lit(k).alias("t"), F.lit(v).alias("c"))) for c, k, v in cases],
                           F.struct(F.lit("unknown").alias("t"), F.lit(0.0).alias("c")))
    return facts.withColumn("s", chosen).select(
        "table_name", F.col("s.t").alias("schema_type"), F.col("s.c").alias("confidence"), "temporal_columns", "id_columns", "numeric_ratio")


def _long(tables: dict[str, DataFrame], number: dict[tuple[str, str], int], value) -> DataFrame | None:
    """(k, v) rows of the numbered columns of all tables without nulls; each table is read once."""
    found = None
    for table, df in tables.items():
        cells = [F.struct(F.lit(i).alias("k"), value(F.col(f"`{c}`")).alias("v")) for (t, c), i in number.items() if t == table]
        if cells:
            part = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL")
            found = part if found is None else found.unionByName(part)
    return found


def possible_references(tables: dict[str, DataFrame], pairs: list[tuple], distinct: dict[tuple[str, str], int], floor: float) -> set[tuple]:
    """Pairs of (child, parent) columns, each a (table, column), whose overlap may exceed ``floor``.

    A child is judged by those of its distinct values whose hash is below a bound, set by its distinct count so that about
    ``SCREEN_VALUES`` remain, or all when it has no more. They are broadcast, a bounded number of pairs a job, to the scans of
    the parents, which send on nothing but hits. A child of few values is refuted for certain, one of many by a margin.
    """
    if not pairs:
        return set()
    spark = next(iter(tables.values())).sparkSession
    number = {c: i for i, c in enumerate(dict.fromkeys(c for pair in pairs for c in pair))}
    children = {c: number[c] for c in dict.fromkeys(c for c, _ in pairs)}
    share = {c: min(1.0, SCREEN_VALUES / max(1, distinct[c])) for c in children}
    bounds = F.create_map(*[F.lit(x) for c, i in children.items() for x in (i, share[c])])
    digest = lambda c: F.when(c.isNotNull(), F.xxhash64(c.cast("string")))
    place = F.col("v").cast("double") / 2.0 ** 64 + 0.5  # of the hash among all hashes, from 0 to 1
    sample = checkpoint(_long(tables, children, digest).where(place <= F.element_at(bounds, F.col("k"))).distinct().withColumnRenamed("k", "child"))
    sizes = {r["child"]: r["count"] for r in sample.groupBy("child").count().collect()}
    kept = set()
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        group = pairs[start:start + PAIRS_PER_JOB]
        wanted = spark.createDataFrame([(number[c], number[p]) for c, p in group], "child int, k int")
        probes = sample.join(F.broadcast(wanted), "child")
        parents = _long(tables, {p: number[p] for _, p in group}, digest)
        hits = parents.join(F.broadcast(probes), ["k", "v"]).select("child", "k", "v").distinct().groupBy("child", "k").count()
        met = {(r["child"], r["k"]): r["count"] for r in hits.collect()}
        for c, p in group:
            size = sizes.get(number[c], 0)
            margin = SCREEN_MARGIN if share[c] < 1 else 0.0
            # Fewer values than half of those expected say nothing; the exact count decides.
            if (share[c] < 1 and size < SCREEN_VALUES / 2) or size and met.get((number[c], number[p]), 0) / size > floor - margin:
                kept.add((c, p))
    return kept


def foreign_keys(tables: dict[str, DataFrame], floor: float = 0.8, by_name: bool = True) -> DataFrame:
    """Columns whose distinct values mostly occur in a key column of the same or another table.

    Name stems must contain each other unless ``by_name`` is off. Pairs that a screen refutes move no values. The others are
    compared in one job: the distinct values of their columns meet by value, and each pair counts what they share. A
    reference needs an overlap above ``floor``.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = P.profile(tables, {"values"}).select("table_name", "column_name", "unique_ratio", "null_count", "unique_count").collect()

    def stem(name: str) -> str:
        bare = name.lower()
        for part in ("_id", "_key", "fk_", "pk_"):
            bare = bare.replace(part, "")
        return bare.split("_", 1)[-1].removesuffix("key")

    asked = []
    for child in rows:
        name = child["column_name"].lower()
        if by_name and not any(p in name for p in ("_id", "ref_", "fk_", "key")):
            continue
        if not 0 < child["unique_ratio"] < 0.95 or child["unique_count"] == 0:
            continue
        for parent in rows:
            if (parent["table_name"], parent["column_name"]) == (child["table_name"], child["column_name"]):
                continue
            if parent["unique_ratio"] < KEY_SHARE:
                continue
            a, b = stem(child["column_name"]), stem(parent["column_name"])
            if by_name and not (a in b or b in a):
                continue
            asked.append((child, parent))
    out = []
    of = lambda r: (r["table_name"], r["column_name"])
    possible = possible_references(tables, [(of(c), of(p)) for c, p in asked], {of(r): r["unique_count"] for r in rows}, floor)
    asked = [(c, p) for c, p in asked if (of(c), of(p)) in possible]
    if asked:
        number = {c: i for i, c in enumerate(dict.fromkeys(of(r) for pair in asked for r in pair))}
        values = checkpoint(_long(tables, number, lambda c: c.cast("string")).distinct())
        wanted = spark.createDataFrame([(number[of(c)], number[of(p)]) for c, p in asked], "child int, parent int")
        left = values.withColumnRenamed("k", "child").join(F.broadcast(wanted), "child")
        met = left.join(values.withColumnRenamed("k", "parent"), ["parent", "v"]).groupBy("child", "parent").count().collect()
        shared = {(r["child"], r["parent"]): r["count"] for r in met}
        for child, parent in asked:
            overlap = shared.get((number[of(child)], number[of(parent)]), 0) / child["unique_count"]
            if overlap > floor:
                out.append((*of(child), *of(parent), overlap))
    return spark.createDataFrame(out, "table_name string, column_name string, other_table string, other string, overlap double")


def correlation_change(df: DataFrame, before: str, after: str, others: list[str], limit: float = 0.15) -> DataFrame:
    """How much the correlations with other columns moved: mean, maximum and verdict."""
    parts = [e for i, o in enumerate(others) for e in (F.corr(F.col(before).cast("double"), F.col(o).cast("double")).alias(f"b{i}"),
                                                      F.corr(F.col(after).cast("double"), F.col(o).cast("double")).alias(f"a{i}"))]
    row = df.agg(*parts)
    changes = F.array_compact(F.array(*[F.nanvl(F.abs(F.col(f"a{i}") - F.col(f"b{i}")), F.lit(None).cast("double")) for i in range(len(others))]))
    mean = F.aggregate("changes", F.lit(0.0), lambda t, x: t + x) / F.size("changes")
    moved = row.select(changes.alias("changes"))
    average = F.when(F.size("changes") > 0, mean).otherwise(F.lit(0.0))
    return moved.select(F.lit(after).alias("column_name"), average.alias("mean_change"), F.coalesce(F.array_max("changes"), F.lit(0.0)).alias("max_change"),
                        (average <= limit).alias("passed"))
