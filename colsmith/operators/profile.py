"""Column profiles: one row of statistics per column of a table.

Rows are read once: they become a count per distinct value of each column, which is kept for the
length of a profile, and everything else (moments, lengths, patterns, quartiles, fences) is
computed from those counts; patterns are tried on texts whose digits are alike. Profiles without
value counts, and quartiles of columns with more distinct values than one task orders in a narrow
stretch, read the rows. Only one row per column, or per step of a long one, reaches the driver. Wide tables are handled in groups of columns so that generated code stays within limits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsmith.functions import constants as K
from colsmith.functions import scalar as S
from colsmith.operators import packed
from colsmith.operators.quantiles import DIRECT_ROWS, exact_quantiles, stepped_quantiles

COLUMNS_PER_JOB = 40
LONG_TEXT = 64
ALL_PARTS = frozenset({"numbers", "text", "values", "quartiles"})
WITH_SEMANTICS = ALL_PARTS | {"semantics"}
# Distinct counts within about one percent and without a shuffle of values; no entropy or top value.
APPROXIMATE = frozenset({"numbers", "quartiles", "approximate"})
WHOLE = ("tinyint", "smallint", "int", "bigint")

_NUMBER_FIELDS = {
    "n": lambda x: F.count(x),
    "min_value": F.min,
    "max_value": F.max,
    "mean": F.avg,
    "zeros": lambda x: F.count_if(x == 0),
    "positives": lambda x: F.count_if(x > 0),
    "negatives": lambda x: F.count_if(x < 0),
    "decimals": lambda x: F.count_if(x % 1 != 0),
    "encoded_nulls": lambda x: F.count_if(x.isin(*[float(v) for v in K.NULL_NUMBERS])),
}

_BASE = [
    ("table_name", "string"), ("column_name", "string"), ("position", "int"), ("type_name", "string"),
    ("row_count", "bigint"), ("present", "bigint"), ("is_numeric", "boolean"), ("is_string", "boolean"),
    ("is_temporal", "boolean"), ("is_integer", "boolean"),
]
_NUMBER_SCHEMA = [(f, "bigint" if f in ("n", "zeros", "positives", "negatives", "decimals", "encoded_nulls") else "double")
                  for f in _NUMBER_FIELDS]
_CENTRED_SCHEMA = [("std", "double"), ("skew_pop", "double"), ("kurt_pop", "double")]
_TEXT_SCHEMA = (
    [("avg_length", "double"), ("min_length", "bigint"), ("max_length", "bigint"), ("length_std", "double")]
    + [(f, "double") for f in K.VALUE_PATTERNS] + [("matches_json", "double")]
    + [(f, "boolean") for f in K.CONTENT_PATTERNS]
    + [("domain_pattern_matches", "map<string,double>"), ("complexity_hits", "int")]
)
_VALUE_SCHEMA = [
    ("unique_count", "bigint"), ("top_count", "bigint"), ("sum_n_log", "double"), ("all_ordinal", "boolean"),
]
_EXTRA_SCHEMA = (
    [(f"sem_{n}", "double") for n in [*K.SEMANTIC_PATTERNS, "number", "email"]]
    + [(f"alt_{n}", "double") for n in K.SECOND_PATTERNS] + [("alt_email", "double"), ("trimmed_length", "double")]
    + [(f"looks_{n}", "double") for n in K.LOOKS_PATTERNS]
    + [("embedded_nulls", "double"), ("mixed_case", "double"), ("word_count", "double"), ("json_depth", "double"),
       ("null_indicators", "bigint"), ("in_boolean_set", "boolean"), ("in_binary_set", "boolean"),
       ("boolean_words", "boolean"), ("ordinal_words", "boolean"), ("unique_lower", "int")]
)
_FENCE_SCHEMA = [("q25", "double"), ("median", "double"), ("q75", "double"),
                 ("outlier_count", "bigint"), ("far_outlier_count", "bigint")]
RAW_SCHEMA = ", ".join(f"{n} {t}" for n, t in [*_BASE, *_NUMBER_SCHEMA, *_CENTRED_SCHEMA, *_TEXT_SCHEMA, *_VALUE_SCHEMA, *_EXTRA_SCHEMA, *_FENCE_SCHEMA])


@dataclass(frozen=True)
class Field:
    """One column of one of the profiled tables, with its number in the long form."""

    k: int
    table: str
    name: str
    kind: str
    source_kind: str
    frame: DataFrame

    @property
    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def is_number(self) -> bool:
        return S.is_number(self.kind)

    @property
    def is_text(self) -> bool:
        return S.is_text_type(self.kind)

    @property
    def number(self) -> Column:
        return S.as_double(self.column, self.kind)


def simple_types(df: DataFrame) -> list[T.StructField]:
    """The columns a profile covers: numbers, text, dates and booleans."""
    kept = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if S.is_number(kind) or S.is_text_type(kind) or S.is_time_type(kind):
            kept.append(f)
    return kept


def standardise(df: DataFrame) -> DataFrame:
    """Decimals become double and NaN becomes null, as everything below expects."""
    columns = []
    for f in simple_types(df):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("float", "double"):
            c = F.when(~F.isnan(c), c.cast("double"))
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _groups(items: list, size: int = COLUMNS_PER_JOB):
    return [items[i:i + size] for i in range(0, len(items), size)]


def text_aggregates(x: Column, n: Column) -> dict[str, Column]:
    """Pattern statistics of text values that occur ``n`` times each."""
    total = F.sum(n)

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0))) / total

    words = F.sum(F.when(F.lower(x).isin(*K.NULL_WORDS), n).otherwise(F.lit(0)))
    dates = sum((x.contains(d).cast("int") for d in K.NULL_DATES), F.lit(0))
    found = {
        "matches_json": part(S.is_json(x)),
        "encoded_nulls": words + F.sum(dates * n),
        "domain_pattern_matches": F.create_map(*[
            e for name, p in K.DOMAIN_PATTERNS.items() for e in (F.lit(name), part(S.starts_with_pattern(x, p)))]),
        "complexity_hits": sum((F.max(S.has_pattern(x, p).cast("int")) for p in K.COMPLEXITY_PATTERNS), F.lit(0)),
    }
    for name, pattern in K.VALUE_PATTERNS.items():
        found[name] = part(S.starts_with_pattern(x, pattern))
    for name, pattern in K.CONTENT_PATTERNS.items():
        found[name] = F.max(S.has_pattern(x, pattern))
    return found


_LENGTHS = {
    "avg_length": F.avg, "min_length": lambda n: F.min(n).cast("bigint"),
    "max_length": lambda n: F.max(n).cast("bigint"), "length_std": F.stddev_samp,
}


def stacked(fields: list[Field], cell: Callable[[Field], Column]) -> DataFrame:
    """One row per (row, column): the struct ``cell`` makes of each column.

    Arrays of structs are inlined per table, so nothing is shuffled; tables are united, so one
    job serves all of them and the generated code stays small whatever the number of columns.
    """
    frames = []
    for table in dict.fromkeys(f.table for f in fields):
        own = [f for f in fields if f.table == table]
        frames += [own[0].frame.select(F.inline(F.array(*[cell(f) for f in group]))) for group in _groups(own)]
    return reduce(DataFrame.unionByName, frames)


def _moment_pass(fields: list[Field], parts: frozenset, raw: list[dict]) -> None:
    """Row and value counts, moments of the numbers and lengths of the texts."""
    nothing = F.lit(None).cast("double")
    cells = stacked(fields, lambda f: F.struct(
        F.lit(f.k).alias("k"), f.column.isNotNull().alias("has"), (f.number if f.is_number else nothing).alias("x"),
        (F.length(f.column) if f.is_text else F.lit(None).cast("int")).alias("size"),
        *([F.when(f.column.isNotNull(), F.xxhash64(f.column)).alias("h")] if "approximate" in parts else [])))
    made = [F.count(F.lit(1)).alias("row_count"), F.count_if("has").alias("present")]
    made += [make(F.col("size")).alias(name) for name, make in _LENGTHS.items()]
    if "numbers" in parts:
        made += [make(F.col("x")).alias(name) for name, make in _NUMBER_FIELDS.items()]
    if "approximate" in parts:
        made.append(F.least(F.approx_count_distinct("h", 0.01), F.count_if("has")).alias("unique_count"))
    for row in cells.groupBy("k").agg(*made).collect():
        found = row.asDict()
        raw[found.pop("k")].update(found)
    for f in fields:
        raw[f.k].setdefault("row_count", 0)
        raw[f.k].setdefault("present", 0)
        if not f.is_number:
            raw[f.k].update(dict.fromkeys(_NUMBER_FIELDS))


def _is_real(f: Field) -> bool:
    return f.is_number and f.kind != "boolean" and f.kind not in WHOLE


def _number_key(f: Field) -> Column:
    """Numbers and times as double or bigint."""
    if _is_real(f):
        return f.column.cast("double")
    if f.kind == "boolean":
        return f.column.cast("int").cast("bigint")
    if f.is_number:
        return f.column.cast("bigint")
    return F.unix_date(f.column).cast("bigint") if f.kind == "date" else F.unix_micros(f.column.cast("timestamp"))


def _number_counts(fields: list[Field]) -> DataFrame:
    """(k, whole, real, n) of columns that are no texts; a row without either counts the nulls."""
    def cell(f: Field) -> Column:
        whole, real = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        return F.struct(F.lit(f.k).alias("k"), (whole if _is_real(f) else _number_key(f)).alias("whole"), (_number_key(f) if _is_real(f) else real).alias("real"))

    return stacked(fields, cell).groupBy("k", "whole", "real").agg(F.count(F.lit(1)).alias("n"))


def _packed_counts(fields: list[Field]) -> DataFrame:
    """The same counts, many values a row (``packed.COUNTS``)."""
    frames = []
    for table in dict.fromkeys(f.table for f in fields):
        for group in _groups([f for f in fields if f.table == table]):
            frames.append((group[0].frame.select(*[_number_key(f).alias(f"c{f.k}") for f in group]), [f.k for f in group], [_is_real(f) for f in group]))
    return packed.packed_counts(frames, [f.k for f in fields if f.is_number], K.NULL_NUMBERS)


def _text_counts(fields: list[Field]) -> DataFrame:
    """(k, word, digest, n) of text columns; a row without either counts the nulls."""
    def cell(f: Field) -> Column:
        c = f.column
        long = F.length(c) > LONG_TEXT
        digest = F.when(long, F.concat_ws("#", F.md5(c), F.length(c).cast("string")))
        return F.struct(F.lit(f.k).alias("k"), F.when(~long, c).alias("word"), digest.alias("digest"))

    return stacked(fields, cell).groupBy("k", "word", "digest").agg(F.count(F.lit(1)).alias("n"))


def _packed_text_counts(fields: list[Field]) -> DataFrame:
    """The same counts, many values a row on their way (``packed.text_counts``). Digests are longer than any word."""
    def cell(f: Field) -> Column:
        c = f.column.cast("string")
        return F.when(F.length(c) > LONG_TEXT, F.concat_ws("#", F.md5(c), F.lpad(F.length(c).cast("string"), 32, "0"))).otherwise(c).alias(f"c{f.k}")

    frames = []
    for table in dict.fromkeys(f.table for f in fields):
        frames += [(group[0].frame.select(*[cell(f) for f in group]), [f.k for f in group]) for group in _groups([f for f in fields if f.table == table])]
    v, long = F.col("v"), F.length("v") > LONG_TEXT
    return packed.text_counts(frames).select("k", F.when(~long, v).alias("word"), F.when(long, v).alias("digest"), "n")


def _counts(fields: list[Field]) -> list[DataFrame]:
    """Counts of numbers and times, then of texts, as far as there are any. Keys of numbers alone are counted much faster than mixed ones."""
    texts, others = [f for f in fields if f.is_text], [f for f in fields if not f.is_text]
    return [make(own) for make, own in ((_number_counts, others), (_text_counts, texts)) if own]


@dataclass(frozen=True)
class Counts:
    """Counts of the values of columns: of numbers and times packed, of texts one value a row. They are made from Arrow batches of many short rows (``packed.batches_of_rows``)."""

    numbers: DataFrame | None
    texts: DataFrame | None

    @classmethod
    def of(cls, fields: list[Field]) -> Counts:
        texts, others = [f for f in fields if f.is_text], [f for f in fields if not f.is_text]
        return cls(_packed_counts(others) if others else None, _packed_text_counts(texts) if texts else None)

    def persist(self) -> None:
        for c in filter(None, (self.numbers, self.texts)):
            c.persist()

    def unpersist(self) -> None:
        for c in filter(None, (self.numbers, self.texts)):
            c.unpersist()


def value_counts(fields: list[Field]) -> DataFrame:
    """(k, whole, real, word, digest, n): how often each value of column number ``k`` occurs.

    Values keep an exact key of their own type; text longer than 64 characters is keyed by its
    digest and length so that the shuffle stays small. Counting starts on the map side, which
    keeps a value held by a third of all rows harmless.
    """
    parts = [c.where(_known(c)) for c in _counts(fields)]
    if len(parts) == 1:
        kinds = {"whole": "bigint", "real": "double", "word": "string", "digest": "string"}
        parts = [parts[0].withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in parts[0].columns})]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("k", "whole", "real", "word", "digest", "n")


def _known(counted: DataFrame) -> Column:
    return S.any_of([F.col(c).isNotNull() for c in counted.columns if c not in ("k", "n")])


def _is_one(fields: list[Field]) -> Column:
    """Whether a row of value counts belongs to one of the columns."""
    return F.col("k").isin(*[f.k for f in fields]) if fields else F.lit(False)


def _deviation(total: int, squares: int, n: int) -> float | None:
    """Sample deviation from exact sums of whole numbers."""
    return math.sqrt((n * squares - total * total) / (n * (n - 1))) if n > 1 else None


_SUMS = ("sized", "length_sum", "length_squares", "long_squares")


def _length_sums(size: Column, n: Column) -> list[Column]:
    """Exact sums for the mean and the deviation of lengths that occur ``n`` times each; squares of short ones fit a long."""
    size = size.cast("bigint")
    wide = (size * size).cast("decimal(20,0)") * n.cast("decimal(20,0)")
    return [F.sum(F.when(size.isNotNull(), n)).alias("sized"), F.sum(size * n).alias("length_sum"), F.sum(F.when(size <= LONG_TEXT, size * size * n)).alias("length_squares"),
            F.sum(F.when(size > LONG_TEXT, wide)).alias("long_squares")]


def _lengths(row) -> dict:
    n, total, squares = row["sized"], row["length_sum"], int(row["length_squares"] or 0) + int(row["long_squares"] or 0)
    return {"avg_length": total / n if n else None, "length_std": _deviation(int(total), squares, n) if n else None}


def _all_ordinal(value=lambda c: c, text: str = "word") -> Column:
    """Whether all values are steps of one ordinal scale, or digits; ``value`` leaves out the nulls where they are counted too."""
    word, short = F.lower(text), F.col(text).isNotNull() & (F.length(text) <= LONG_TEXT)
    every = lambda c: F.coalesce(F.bool_and(value(short & c)), F.lit(False))
    return S.any_of([every(word.isin(*scale)) for scale in K.ORDINAL_SCALES]) | every(F.col(text).rlike(r"^\d+$"))


def value_aggregates() -> list[Column]:
    """Distinct values, entropy, top value and ordinal scales from value counts without nulls."""
    return [
        F.count(F.lit(1)).alias("unique_count"), F.max("n").alias("top_count"),
        F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("sum_n_log"), _all_ordinal().alias("all_ordinal"),
    ]


def _value_aggregates(known: Column) -> list[Column]:
    """Rows, distinct values, entropy and top value from value counts; ``known`` tells values from nulls."""
    n = F.col("n")
    return [
        F.sum(n).alias("row_count"), F.sum(F.when(known, n).otherwise(F.lit(0))).alias("present"), F.count_if(known).alias("unique_count"),
        F.max(F.when(known, n)).alias("top_count"), F.sum(F.when(known, n * F.log2(n.cast("double")))).alias("sum_n_log"),
    ]


def _number_aggregates() -> list[Column]:
    """What ``_value_aggregates`` finds, and the moments of the numbers, from packed counts."""
    rows, held = F.sum("present"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        (rows + F.sum("nulls")).alias("row_count"), rows.alias("present"), F.sum("distinct").alias("unique_count"), F.max("top").alias("top_count"), F.sum("n_log").alias("sum_n_log"),
        rows.alias("n"), F.min("low").alias("min_value"), F.max("high").alias("max_value"), (F.sum("total") / F.nullif(rows, F.lit(0))).alias("mean"),
        held("zeros").alias("zeros"), held("positives").alias("positives"), held("negatives").alias("negatives"), held("decimals").alias("decimals"),
        held("encoded").alias("encoded_nulls"),
    ]


def _text_aggregates(known: Column, ordinal: bool) -> list[Column]:
    size = F.coalesce(F.length("word"), F.substring_index("digest", "#", -1).cast("int"))
    return [*_length_sums(size, F.col("n")), F.min(size).cast("bigint").alias("min_length"), F.max(size).cast("bigint").alias("max_length"),
            *([_all_ordinal(lambda c: F.when(known, c)).alias("all_ordinal")] if ordinal else [])]


def _counted_moments(fields: list[Field], counts: Counts, parts: frozenset, raw: list[dict]) -> None:
    """What ``_moment_pass`` finds in the rows, and distinct values, entropy and top value, from the value counts."""
    for f in fields:
        raw[f.k].update(row_count=0, present=0, unique_count=0, top_count=0, sum_n_log=0.0, all_ordinal=False)
    if counts.numbers is not None:
        for row in counts.numbers.groupBy("k").agg(*_number_aggregates()).collect():
            found = {c: v for c, v in row.asDict().items() if v is not None or c not in ("top_count", "sum_n_log")}
            k = found.pop("k")
            raw[k].update({c: v for c, v in found.items() if "numbers" in parts or c not in _NUMBER_FIELDS}, ends=(found["min_value"], found["max_value"]))
    if counts.texts is not None:
        known = _known(counts.texts)
        # Patterns come with the scales, if there are any.
        for row in counts.texts.groupBy("k").agg(*_value_aggregates(known), *_text_aggregates(known, not parts & {"text", "semantics"})).collect():
            found = row.asDict() | _lengths(row)
            raw[found.pop("k")].update({c: v for c, v in found.items() if c not in _SUMS and (v is not None or c not in ("top_count", "sum_n_log"))})
    for f in fields:
        if not f.is_number:
            raw[f.k].update(dict.fromkeys(_NUMBER_FIELDS))


_PROBS = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _quartile_aggregates(counted: DataFrame, ranks: dict[int, int]) -> DataFrame:
    """(k, <low and high order statistic per quartile>) from the running sums of value counts (k, x, n)."""
    frame = W.partitionBy("k").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    total = F.create_map(*[e for k, n in ranks.items() for e in (F.lit(k), F.lit(n))])[F.col("k")]
    upto = counted.withColumn("upto", F.sum("n").over(frame)).withColumn("total", total)
    picked = []
    for name, p in _PROBS.items():
        low = F.floor((F.col("total") - 1) * p)
        for side, rank in (("lo", low), ("hi", F.least(low + 1, F.col("total") - 1))):
            covers = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
            picked.append(F.max(F.when(covers, F.col("x"))).alias(f"{name}_{side}"))
    return upto.groupBy("k").agg(*picked)


def _counted_quartiles(fields: list[Field], counts: Counts, raw: list[dict]) -> None:
    """Quartiles of number columns of any length whose distinct values one task can order."""
    short = {f.k: f for f in fields if f.is_number and 0 < raw[f.k]["unique_count"] <= DIRECT_ROWS}
    if not short:
        return
    ranks = {k: raw[k]["present"] for k in short}
    found = stepped_quantiles(counts.numbers, {k: (k, _is_real(f), *raw[k]["ends"]) for k, f in short.items()}, {k: list(_PROBS.values()) for k in short}, ranks, DIRECT_ROWS)
    for k, values in found.items():
        raw[k].update(zip(_PROBS, values))
    left = {k: _is_real(f) for k, f in short.items() if k not in found}  # without end on one side
    if not left:
        return
    for row in _quartile_aggregates(packed.value_rows(counts.numbers, left), {k: ranks[k] for k in left}).collect():
        for name, p in _PROBS.items():
            position = (ranks[row["k"]] - 1) * p
            lo, hi = row[f"{name}_lo"], row[f"{name}_hi"]
            raw[row["k"]][name] = lo + (hi - lo) * (position - math.floor(position))


def json_depth(x: Column) -> Column:
    """Nesting depth of a JSON object or array in text; null for anything else.

    A container with content adds one level. Escaped characters and then quoted text are removed first, each by a pattern
    without a repeated group, so that only structural brackets are counted and a value of any length is walked without recursion.
    """
    compact = F.to_json(F.try_parse_json(F.when(F.trim(x).rlike(r"^[\{\[]"), x)))
    quoted = F.regexp_replace(F.regexp_replace(compact, r"\\.", ""), '"[^"]*+"', "s")
    bare = F.regexp_replace(quoted, r"\{\}|\[\]", "s")
    steps = F.split(F.regexp_replace(bare, r"[^\{\}\[\]]", ""), "")
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda s, ch: F.struct(
            (s["now"] + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1).otherwise(0)).alias("now"),
            F.greatest(s["top"], s["now"] + F.when(ch.isin("{", "["), 1).otherwise(0)).alias("top")),
        lambda s: s["top"])
    return F.when(compact.isNotNull(), walk.cast("double"))


def extra_aggregates(x: Column, n: Column) -> dict[str, Column]:
    """Semantic patterns and "looks like" measures of text values that occur ``n`` times each."""
    total = F.sum(n)
    trimmed = F.trim(x)
    low = F.lower(trimmed)

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0))) / total

    def only(words) -> Column:
        return F.bool_and(low.isin(*words))

    found = {f"sem_{k}": part(S.has_pattern(trimmed if k == "phone" else x, p)) for k, p in K.SEMANTIC_PATTERNS.items()}
    found["sem_number"] = part(trimmed.try_cast("double").isNotNull())
    found["sem_email"] = part(S.has_pattern(x, K.EMAIL))
    found |= {f"alt_{k}": part(S.has_pattern(trimmed, p)) for k, p in K.SECOND_PATTERNS.items()}
    found["alt_email"] = part(S.has_pattern(trimmed, K.EMAIL))
    found["trimmed_length"] = F.sum(F.length(trimmed) * n) / total
    found |= {f"looks_{k}": part(S.has_pattern(x, p)) for k, p in K.LOOKS_PATTERNS.items()}
    hits = sum((x.rlike(f"(?i){p}").cast("int") for p in K.EMBEDDED_NULL_PATTERNS), F.lit(0))
    found["embedded_nulls"] = F.least(F.lit(1.0), F.sum(hits * n) / total)
    found["mixed_case"] = part(x.rlike("[A-Z]") & x.rlike("[a-z]"))
    found["word_count"] = F.sum(F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))) * n) / total
    depth = json_depth(x)
    found["json_depth"] = F.coalesce(F.sum(depth * n) / F.sum(F.when(depth.isNotNull(), n)), F.lit(0.0))
    found["null_indicators"] = F.sum(F.when(low.isin(*K.NULL_INDICATORS), n).otherwise(F.lit(0)))
    found["in_boolean_set"] = S.any_of([only(words) for words in K.BOOLEAN_SETS])
    found["in_binary_set"] = S.any_of([F.bool_and(F.lower(x).isin(*words)) for words in K.BINARY_SETS])
    found["boolean_words"] = F.bool_and(F.lower(x).isin(*K.BOOLEAN_WORDS))
    found["ordinal_words"] = F.bool_or(F.lower(x).isin(*K.ORDINAL_WORDS))
    return found


# Texts in which a digit may say more than that it is one: keys and escapes of JSON, exponents and placeholder dates.
_EXACT_DIGITS = (r'(?s)^[ \t\r\n]*+[\[{"].*(?:\\|\d[^"]*+"[ \t\r\n]*+:)', r"\d[eE][-+]?\d")


def alike(x: Column) -> Column:
    """The text with the digits from 2 on all the same: no pattern and no list of words tells them apart, so few texts stand for many."""
    exact = S.any_of([*[x.contains(d) for d in K.NULL_DATES], *[x.rlike(p) for p in _EXACT_DIGITS]])
    return F.when(exact, x).otherwise(F.regexp_replace(x, "[2-9]", "5"))


def weighted_texts(fields: list[Field], raw: list[dict], counts: Counts | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(k, x, n): every distinct short value with its count, and every long value as it is, if there are any."""
    counted = (_text_counts(fields) if counts is None else counts.texts).where(_is_one(fields) & F.col("word").isNotNull()).select("k", F.col("word").alias("x"), "n")
    long = [f for f in fields if (raw[f.k].get("max_length") or 0) > LONG_TEXT]
    if not long:
        return counted, None
    rows = stacked(long, lambda f: F.struct(F.lit(f.k).alias("k"), f.column.alias("x"), F.lit(1).cast("bigint").alias("n")))
    return counted, rows.where(F.length("x") > LONG_TEXT)


def _text_pass(fields: list[Field], parts: frozenset, raw: list[dict], counts: Counts | None = None) -> None:
    """Patterns are tried once per short value with ``alike`` digits and once per long value."""
    texts = [f for f in fields if f.is_text]
    if not texts:
        return
    x = F.col("x")
    made = text_aggregates(x, F.col("n")) if "text" in parts else {}
    if "semantics" in parts:
        made |= extra_aggregates(x, F.col("n"))
    if counts is not None:
        made["all_ordinal"] = _all_ordinal(text="x")
    short, long = weighted_texts(texts, raw, counts)
    tried = short.groupBy("k", alike(x).alias("x")).agg(F.sum("n").alias("n"))
    tried = tried if long is None else tried.unionByName(long)
    capitals = set()
    for row in tried.groupBy("k").agg(*[c.alias(n) for n, c in made.items()], F.bool_or(x != F.lower(x)).alias("capitals")).collect():
        raw[row["k"]].update({n: row[n] for n in made})
        if row["capitals"]:
            capitals.add(row["k"])
    if "semantics" in parts:
        for f in texts:
            if f.k not in capitals and raw[f.k].get("unique_count"):
                raw[f.k].update(unique_lower=raw[f.k]["unique_count"])
        cased = [f for f in texts if f.k in capitals or "unique_count" not in raw[f.k]]
        if cased:
            folded = [d.select("k", F.md5(F.lower(x)).alias("x")) for d in weighted_texts(cased, raw, counts) if d is not None]
            for row in reduce(DataFrame.unionByName, folded).distinct().groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("unique_lower")).collect():
                raw[row["k"]].update(unique_lower=row["unique_lower"])


def _digit_pass(fields: list[Field], raw: list[dict], counts: Counts | None = None) -> None:
    """What whole numbers look like as text: their length, and whether they read as phone numbers."""
    whole = [f for f in fields if f.kind in WHOLE]
    if not whole:
        return
    numbers = _packed_counts(whole) if counts is None else counts.numbers
    made = [F.sum(c).alias(c) for c in ("sized", "length_sum", "length_squares", "phones", "plain")]
    for row in packed.digit_sums(numbers, [f.k for f in whole]).groupBy("k").agg(*made, F.lit(0).alias("long_squares")).collect():
        raw[row["k"]].update(_lengths(row), sem_phone=row["phones"] / row["sized"], sem_alnum=row["plain"] / row["sized"])


def _missing_quartiles(fields: list[Field], raw: list[dict], counts: Counts | None = None) -> None:
    """Quartiles of the columns too long for the value counts as a whole; where there are counts, their narrow stretches mostly do."""
    def missing(of: list[Field]) -> dict[str, Field]:
        return {f"c{f.k}": f for f in of if "q25" not in raw[f.k] and raw[f.k]["present"]}

    def found(own: dict[str, Field], held: tuple | None) -> None:
        plain = next(iter(own.values())).frame if held else own[next(iter(own))].frame.select(*[f.number.alias(c) for c, f in own.items()])
        for c, q in exact_quantiles(plain, {c: list(_PROBS.values()) for c in own}, {c: raw[f.k]["present"] for c, f in own.items()}, DIRECT_ROWS, held).items():
            raw[own[c].k].update(zip(_PROBS, q))

    if counts is not None and (own := missing(fields)):
        found(own, (counts.numbers, {c: (f.k, _is_real(f), *raw[f.k]["ends"]) for c, f in own.items()}))
    for table in dict.fromkeys(f.table for f in fields):
        if own := missing([f for f in fields if f.table == table]):
            found(own, None)


def _centred_pass(fields: list[Field], parts: frozenset, raw: list[dict], counts: Counts | None = None) -> None:
    """Moments around the mean and values outside the quartile fences, in one pass.

    With the mean known, three plain sums give deviation, skewness and kurtosis.
    """
    numbers = [f for f in fields if f.is_number]
    if "quartiles" in parts:
        _missing_quartiles(numbers, raw, counts)
        for f in numbers:
            raw[f.k].update(outlier_count=0, far_outlier_count=0)
    known = [f for f in numbers if raw[f.k]["present"]]
    if not known:
        return

    def fences(f: Field, width: float) -> tuple:
        if raw[f.k].get("q25") is None:
            return None, None
        spread = width * (raw[f.k]["q75"] - raw[f.k]["q25"])
        return raw[f.k]["q25"] - spread, raw[f.k]["q75"] + spread

    facts = {f.k: (_is_real(f), raw[f.k].get("mean"), *fences(f, 1.5), *fences(f, 3.0)) for f in known}
    if counts is None:
        values = stacked(known, lambda f: F.struct(F.lit(f.k).alias("k"), f.number.alias("x")))
        side = known[0].frame.sparkSession.createDataFrame([(k, *fact[1:]) for k, fact in facts.items()], "k int, mean double, low double, high double, far_low double, far_high double")
        # One row a column; the values are not shuffled.
        cells = values.join(F.broadcast(side), "k").withColumn("g", F.col("x") - F.col("mean"))
        g, x = F.col("g"), F.col("x")
        made = [F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("near"), F.count_if((x < F.col("far_low")) | (x > F.col("far_high"))).alias("far"),
                F.sum(g * g).alias("s2"), F.sum(g * g * g).alias("s3"), F.sum(g * g * g * g).alias("s4")]
    else:
        cells = packed.moment_sums(counts.numbers, facts)
        made = [F.sum(c).alias(c) for c in ("near", "far", "s2", "s3", "s4")]
    for row in cells.groupBy("k").agg(*made).collect():
        found, size = raw[row["k"]], raw[row["k"]]["present"]
        if "quartiles" in parts:
            found.update(outlier_count=row["near"], far_outlier_count=row["far"])
        s2 = row["s2"]
        if s2 is not None:
            found["std"] = math.sqrt(s2 / (size - 1)) if size > 1 else None
            if s2 > 0:
                found.update(skew_pop=math.sqrt(size) * row["s3"] / s2 ** 1.5, kurt_pop=size * row["s4"] / (s2 * s2) - 3)


def fields_of(tables: dict[str, DataFrame]) -> list[Field]:
    found = []
    for table, df in tables.items():
        plain = standardise(df)
        source = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        for f in simple_types(plain):
            found.append(Field(len(found), table, f.name, f.dataType.simpleString(), source[f.name], plain))
    return found


def _all_passes(fields: list[Field], parts: frozenset, raw: list[dict]) -> None:
    counts = Counts.of(fields) if "values" in parts else None
    if counts and parts != {"values"}:  # several passes follow
        counts.persist()
    try:
        if counts is None:
            _moment_pass(fields, parts, raw)
        else:
            _counted_moments(fields, counts, parts, raw)
            if "quartiles" in parts:
                _counted_quartiles(fields, counts, raw)
        if parts & {"text", "semantics"}:
            _text_pass(fields, parts, raw, counts)
        if "semantics" in parts:
            _digit_pass(fields, raw, counts)
        if parts & {"quartiles", "numbers"}:
            _centred_pass(fields, parts, raw, counts)
    finally:
        if counts:
            counts.unpersist()


def raw_profiles(tables: dict[str, DataFrame], parts: frozenset | set = ALL_PARTS) -> list[tuple]:
    """One tuple per column in the order of ``RAW_SCHEMA``."""
    parts = frozenset(parts)
    fields = fields_of(tables)
    raw: list[dict] = [{} for _ in fields]
    with packed.batches_of_rows(next(iter(tables.values())).sparkSession):
        _all_passes(fields, parts, raw)
    places: dict[str, int] = {}
    rows = []
    for f in fields:
        places[f.table] = places.get(f.table, -1) + 1
        raw[f.k].update(
            table_name=f.table, column_name=f.name, position=places[f.table], type_name=f.source_kind, is_numeric=f.is_number,
            is_string=f.is_text, is_temporal=S.is_time_type(f.kind), is_integer=f.kind in WHOLE)
        rows.append(tuple(raw[f.k].get(n) for n in _raw_names()))
    return rows


def _raw_names() -> list[str]:
    return [n for n, _ in [*_BASE, *_NUMBER_SCHEMA, *_CENTRED_SCHEMA, *_TEXT_SCHEMA, *_VALUE_SCHEMA, *_EXTRA_SCHEMA, *_FENCE_SCHEMA]]


def profile(tables: dict[str, DataFrame], parts: frozenset | set = ALL_PARTS) -> DataFrame:
    """Profile table of all simple columns of the given tables."""
    spark = next(iter(tables.values())).sparkSession
    return derive(raw_table(spark, raw_profiles(tables, parts)))


def raw_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RAW_SCHEMA)


def derive(raw: DataFrame) -> DataFrame:
    """Ratios, flags and adjusted moments from the raw counts and moments."""
    rows, present = F.col("row_count"), F.col("present")
    number = F.col("is_numeric") & (present > 0)
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    mean, std = F.col("mean"), F.col("std")
    entropy_bits = F.when(present > 0, F.log2(present.cast("double")) - F.col("sum_n_log") / present).otherwise(F.lit(0.0))
    unique = F.col("unique_count")
    first = raw.withColumns({
        "null_count": rows - present,
        "null_pct": share(rows - present, rows),
        "unique_ratio": share(unique, rows),
        "duplicate_ratio": share(rows - unique, rows),
        "cardinality": unique,
        "is_text": F.col("is_string"),
        "std_pop": F.when(number, F.when(present > 1, std * F.sqrt((present - 1) / present)).otherwise(F.lit(0.0))),
        "skewness": F.when(number, S.sample_skewness(F.col("skew_pop"), present)),
        "kurtosis": F.when(number, S.sample_kurtosis(F.col("kurt_pop"), present)),
        "all_positive": F.when(number, F.col("min_value") > 0),
        "has_zeros": F.when(number, F.col("zeros") > 0),
        "range_size": F.col("max_value") - F.col("min_value"),
        "cv": F.when(number, F.when(mean != 0, F.abs(std / mean)).otherwise(F.lit(0.0))),
        "iqr": F.col("q75") - F.col("q25"),
        "has_outliers": F.when(number, F.col("outlier_count") > 0),
        "outlier_pct": F.when(number, F.col("outlier_count") / present),
        "far_outlier_pct": F.when(number, F.col("far_outlier_count") / present),
        "is_already_scaled": F.when(number, (F.abs(mean) < 0.1) & (std > 0.8) & (std < 1.2)),
        "has_natural_bounds": F.when(number, (F.col("min_value") >= 0) & (F.col("max_value") <= 100)),
        "entropy": F.when(unique > 1, entropy_bits / F.log2(unique.cast("double"))).otherwise(F.lit(0.0)),
        # Over all rows: nulls lower the shares without adding a term of their own.
        "entropy_bits": F.when(present > 0, (present * F.log2(rows.cast("double")) - F.col("sum_n_log")) / rows).otherwise(F.lit(0.0)),
        "encoded_null_ratio": share(F.coalesce(F.col("encoded_nulls"), F.lit(0)), rows),
        "top_share": share(F.col("top_count"), present),
        "mode_frequency": share(F.col("top_count"), rows),
        "zero_ratio": F.when(number, F.col("zeros") / present),
        "positive_ratio": F.when(number, F.col("positives") / present),
        "negative_ratio": F.when(number, F.col("negatives") / present),
    })
    return first.withColumns({
        "is_categorical": F.col("is_string") & (F.col("unique_ratio") < 0.5),
        "is_ordinal": F.col("is_string") & (F.col("unique_ratio") < 0.5) & F.coalesce(F.col("all_ordinal"), F.lit(False)),
        "is_bimodal": F.when(number, F.col("kurtosis") < -1),
        "pattern_complexity": F.coalesce(F.col("complexity_hits"), F.lit(0)) / len(K.COMPLEXITY_PATTERNS),
    })
