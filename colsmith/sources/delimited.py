"""Delimited text: separator detection, tolerant reading, cleanup and type inference."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions import scalar as S

SEPARATORS = (",", "\t", ";", "|", " ")
PROBE_LINES = 10
NUMERIC_SHARE = 0.9


def separator_scores(spark: SparkSession, path: str, lines: int = PROBE_LINES) -> DataFrame:
    """(file, separator, score) from the first lines of every file under ``path``.

    Only the first block of a file is looked at, and the row limit per file is applied
    before the shuffle.
    """
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"),
    )
    head = (
        text.where(F.col("start") == 0)
        .withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("line")))
        .where(F.col("n") <= lines)
        .where(F.trim("value") != "")
    )
    options = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(s).alias("separator"),
                 F.size(F.split("value", re.escape(s))).alias("fields"))
        for i, s in enumerate(SEPARATORS)
    ])
    mean, spread = F.avg("fields"), F.stddev_pop("fields")
    scored = head.select("file", F.inline(options)).groupBy("file", "rank", "separator").agg(
        mean.alias("mean"), (mean * (1 - spread / (mean + 1))).alias("score"))
    return scored.where((F.col("mean") > 1) & (F.col("mean") < 100)).select("file", "rank", "separator", "score")


def file_separators(spark: SparkSession, path: str) -> DataFrame:
    """(file, separator): the best separator of each file, earlier candidates win ties."""
    best = F.max_by("separator", F.struct(F.col("score"), -F.col("rank")))
    return separator_scores(spark, path).groupBy("file").agg(best.alias("separator"))


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator most files under ``path`` agree on; a comma when there is no evidence."""
    votes = file_separators(spark, path).groupBy("separator").count().orderBy(F.desc("count"), "separator").limit(1).collect()
    return votes[0]["separator"] if votes else ","


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "UTF-8",
                   schema: str | None = None) -> DataFrame:
    """All columns as text; rows with too many or too few fields are skipped."""
    reader = (
        spark.read.option("header", True).option("sep", separator or detect_separator(spark, path))
        .option("encoding", encoding).option("mode", "DROPMALFORMED")
        .option("ignoreLeadingWhiteSpace", True).option("enforceSchema", False)
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def clean_names(names: list[str]) -> list[str]:
    """Trimmed names with blanks as underscores; repeated names get a number."""
    used: dict[str, int] = {}
    cleaned = []
    for name in names:
        base = re.sub(r"\s+", "_", name.strip())
        used[base] = used.get(base, -1) + 1
        cleaned.append(f"{base}.{used[base]}" if used[base] else base)
    return cleaned


def clean_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop unnamed and all-null columns, repair the names; say what was done."""
    notes = []
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    counts = plain.agg(*[F.count(c).alias(c) for c in plain.columns]).first()
    unnamed = [i for i, name in enumerate(df.columns) if "Unnamed" in name or re.fullmatch(r"_c\d+", name)]
    empty = [i for i in range(len(df.columns)) if i not in unnamed and counts[f"c{i}"] == 0]
    if unnamed:
        notes.append(f"Removed {len(unnamed)} unnamed columns")
    if empty:
        notes.append(f"Removed {len(empty)} empty columns")
    kept = [i for i in range(len(df.columns)) if i not in unnamed and i not in empty]
    names = [df.columns[i] for i in kept]
    final = clean_names(names)
    changed = sum(a != b for a, b in zip(names, final))
    if changed:
        notes.append(f"Cleaned {changed} column names")
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(kept, final)]), notes


def _numeric_shares(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    parts = []
    for i, c in enumerate(columns):
        parsed = F.count(F.trim(F.col(f"`{c}`")).try_cast("double"))
        parts += [parsed.alias(f"p{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    return {c: {"rows": row["rows"], "present": row[f"n{i}"], "numbers": row[f"p{i}"]} for i, c in enumerate(columns)}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if S.is_text_type(f.dataType.simpleString())]


def infer_numbers(df: DataFrame, share: float = NUMERIC_SHARE) -> DataFrame:
    """Text columns become double when more than ``share`` of all rows are numbers."""
    columns = text_columns(df)
    if not columns:
        return df
    found = _numeric_shares(df, columns)
    casts = {c: F.trim(F.col(f"`{c}`")).try_cast("double") for c, f in found.items()
             if f["rows"] and f["numbers"] / f["rows"] > share}
    return df.withColumns(casts) if casts else df


def settle_types(df: DataFrame) -> DataFrame:
    """Text columns become double only when every non-null value is a number.

    A column that mixes numbers and words keeps all its values as text.
    """
    columns = text_columns(df)
    if not columns:
        return df
    found = _numeric_shares(df, columns)
    casts = {c: F.trim(F.col(f"`{c}`")).cast("double") for c, f in found.items()
             if f["present"] and f["numbers"] == f["present"]}
    return df.withColumns(casts) if casts else df


class TooLarge(ValueError):
    """The input is larger than the caller allows."""


def check_limits(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Pass the frame through when it is within the given limits; there are none by default."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise TooLarge(f"{len(df.columns)} columns, at most {max_columns} allowed")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise TooLarge(f"more than {max_rows} rows")
    return df
