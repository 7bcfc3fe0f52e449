"""URL filters: host and path rules, then a ratio of character language models over the whole url.

Two variable-order Markov models over a small alphabet, one of accepted and one of rejected urls, give
each character a probability that interpolates orders 0 to 3 (Witten-Bell weights). A url's score is
the difference of the two log-likelihoods per character. The threshold comes from labelled urls that the models have not seen.

Counts come from all labelled urls. They are tables of at most ``SYMBOLS ** 4`` numbers whatever the
input, which bounds what is collected and broadcast. A url with no text to score gets 0, which is accepted
unless the threshold is above 0. Null labels are not learned from. Without urls of both labels every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3  # characters of context
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 32  # start or other, letters, any digit, and . - / _ which keep their own number
BINS = 2000  # of scores between -LARGEST and LARGEST, for the threshold
LARGEST = 10.0

_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i + 1
_CODE[48:58] = 27
for _i, _c in enumerate(".-/_"):
    _CODE[ord(_c)] = 28 + _i


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, in lower case (A-Z only); empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, LETTERS.upper(), LETTERS), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The url without its scheme: all after the first ://, or all of it. This is what the models learn from and score, query and fragment included."""
    return F.regexp_replace(url.cast("string"), r"(?s)^.*?://", "")


def matching_rule(host_column: Column, path_column: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are (verdict, "host/path")."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = (host_column == name) | host_column.endswith("." + name)
        fits &= path_column.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _codes(text: str | None) -> np.ndarray:
    """A number for every character with its ORDER predecessors."""
    c = np.append(np.zeros(ORDER, np.int64), _CODE[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)])
    n = len(c) - ORDER
    return sum(c[j : j + n] * SYMBOLS ** (ORDER - j) for j in range(ORDER + 1))


def gram_counts(urls: DataFrame, text: str, label: str) -> DataFrame:
    """Counts of character grams by label, summed in each task before they are shuffled."""

    def run(batches):
        counts = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is not None and y is not None:
                    np.add.at(counts.setdefault(y, np.zeros(SYMBOLS ** (ORDER + 1), np.int64)), _codes(t), 1)
        for y, n in counts.items():
            at = np.flatnonzero(n)
            for i in range(0, len(at), 50_000):
                part = at[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"label": pa.array([y] * len(part), pa.bool_()), "gram": pa.array(part), "n": pa.array(n[part])})

    rows = urls.select(F.col(text).cast("string"), F.col(label).cast("boolean")).mapInArrow(run, "label boolean, gram long, n long")
    return rows.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last character of every gram, interpolated over all orders."""
    table = counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        n = table.sum(axis=tuple(range(ORDER - order)))  # last ``order`` characters of context and the next one
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        weight = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        p = n / np.maximum(total + kinds, 1) + weight * p  # p holds the shorter context and broadcasts over the longer
    return np.log(p).reshape(-1)


class Model:
    """Differences of log-probabilities for every gram, and the threshold of the score."""

    def __init__(self, difference: np.ndarray, threshold: float):
        self.difference, self.threshold = difference, threshold

    def score_text(self, text: str | None) -> float:
        found = self.difference[_codes(text)]
        return float(np.float64(found.astype(np.float64).sum() / len(found))) if len(found) else 0.0

    def score(self, text: Column, spark) -> Column:
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([shared.value.score_text(t) for t in texts], dtype="float64")

        return scored(text.cast("string"))


def fit(urls: DataFrame, text: str, label: str, lost: float = 0.01) -> Model:
    """Learn from labelled urls (true: accepted) and calibrate on those whose crc32 is odd.

    The threshold is the one with the fewest errors (each label weighing the same) among those that lose
    at most a share ``lost`` of accepted urls.
    """
    urls = urls.select(address(F.col(text)).alias("address"), F.col(label).cast("boolean").alias("label"))
    text, label = "address", "label"
    odd = F.crc32(F.col(text).cast("binary")) % 2 == 1
    counts = {y: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for y in (True, False)}
    for r in gram_counts(urls.where(~odd), text, label).collect():  # at most 2 * SYMBOLS ** 4 rows
        counts[r["label"]][r["gram"]] = r["n"]
    if not all(n.any() for n in counts.values()):
        return Model(np.zeros(SYMBOLS ** (ORDER + 1), np.float32), 0.0)
    model = Model((log_probabilities(counts[True]) - log_probabilities(counts[False])).astype(np.float32), 0.0)
    scored = urls.where(odd & F.col(label).isNotNull()).select(F.col(label).cast("boolean").alias("y"), model.score(F.col(text), urls.sparkSession).alias("s"))
    bin_ = F.least(F.greatest(F.floor((F.col("s") + LARGEST) * BINS / (2 * LARGEST)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    histogram = np.zeros((2, BINS))
    for r in scored.groupBy("y", bin_.alias("b")).count().collect():  # at most 2 * BINS rows
        histogram[int(r["y"]), r["b"]] = r["count"]
    if histogram.sum(1).min() > 0:
        below = np.append(np.zeros((2, 1)), np.cumsum(histogram, 1), 1) / histogram.sum(1, keepdims=True)  # share under each bin's start
        errors = np.where(below[1] <= lost, below[1] + 1 - below[0], math.inf)
        best = np.flatnonzero(errors == errors.min())
        model.threshold = float(best[len(best) // 2] * 2 * LARGEST / BINS - LARGEST)
    return model


def judge(urls: DataFrame, model: Model, rules: Sequence[tuple[str, str]], url: str = "url", keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns, host, path, rule and verdict: the rule's, else allow from the model's threshold on."""
    u = F.col(url).cast("string")
    found = urls.select(*keep, host(u).alias("_h"), path(u).alias("_p"), model.score(address(u), urls.sparkSession).alias("_s"))
    rule = matching_rule(F.col("_h"), F.col("_p"), rules)
    method = F.when(F.col("_s") >= model.threshold, "allow").otherwise("block")
    return found.select(*keep, F.col("_h").alias("host"), F.col("_p").alias("path"), rule["rule"].alias("rule"),
                        F.coalesce(rule["verdict"], method).alias("verdict"), F.round("_s", 6).alias("score"))
