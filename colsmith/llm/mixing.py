"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mix, measured in characters. Its mean repetition rate is target characters
over own characters. Each document draws how often it appears from a Poisson distribution with that mean,
by inverting the distribution at a uniform number that a keyed hash of its id gives. A mean above ``LARGEST_RATE`` is drawn as the sum of
equal parts below it, each with a hash of its own, so no rate is cut. Copies are exploded (an array of 4 bytes a copy) and dealt out by a hash,
which shuffles them globally; the draw of one document never depends on other rows' order.

A null source is a source of its own. Null texts count no characters; a source without characters has rate 1.
Sources missing from given targets have target 0 and leave the mix; so do the documents that draw 0. Rows with
equal ids draw the same number, a null id is drawn as an empty one. Existing columns named like the two added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.session import BROADCAST_ROWS, checkpoint

LARGEST_RATE = 50.0  # mean of one draw; a larger rate is the sum of several draws


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the SHA-256 of the parts."""
    joined = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to a point that a draw passes with a chance under 1e-12."""
    last = F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, source: str = "source", text: str = "text", temperature: float = 0.5) -> DataFrame:
    """Rate of every source, the number of equal parts that it is drawn in, and cumulative probabilities of a part.

    Without ``targets`` a source's target is its share of characters to the power ``temperature``, scaled to sum 1.
    """
    size = checkpoint(docs.groupBy(F.col(source).alias("mix_source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("chars")))
    if targets is None:
        size = size.withColumn("weight", F.pow("chars", F.lit(float(temperature))))
    else:
        chosen = F.lit(0.0)
        for name, weight in targets.items():
            chosen = F.when(F.col("mix_source") == name, float(weight)).otherwise(chosen)
        size = size.withColumn("weight", chosen)
    total = size.agg(F.coalesce(F.sum("chars"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()  # one row
    rate = F.col("weight") / F.lit(total[1]) * F.lit(total[0]) / F.col("chars")
    rate = F.when(F.col("chars") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(0.0)))
    found = size.select("mix_source", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / LARGEST_RATE), F.lit(1)).cast("int"))
    return found.withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, seed: str = "mix", id_column: str = "doc_id", source: str = "source",
        text: str = "text", temperature: float = 0.5) -> DataFrame:
    """Documents with ``copy`` (from 0) and ``mix_order`` (0 to 1, the place in the global shuffle)."""
    docs = docs.drop("copy", "mix_order")
    found = rates(docs, targets, source, text, temperature).select("mix_source", "parts", "steps")
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # beyond it a join by key, whose hot keys adaptive execution splits
        found = F.broadcast(found)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("key"), uniform(F.lit(seed), id_column).alias("u"))

    def draw(u: Column) -> Column:
        return F.size(F.filter("steps", lambda c: c <= u))

    further = F.aggregate(F.sequence(F.lit(1), F.col("parts") - 1), F.lit(0), lambda n, i: n + draw(uniform(F.lit(seed), F.lit("part"), F.col("row")[id_column], i)))
    many = draw(F.col("u")) + F.when(F.col("parts") > 1, further).otherwise(0)
    drawn = rows.join(found, F.col("key").eqNullSafe(F.col("mix_source"))).select("row", many.alias("n")).where("n > 0")
    copies = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    copies = copies.withColumn("mix_order", uniform(F.lit(seed), F.lit("order"), F.col("row")[id_column], "copy"))
    return copies.select("row.*", "copy", "mix_order").repartition(F.col("mix_order")).sortWithinPartitions(F.xxhash64("mix_order"))
