"""Hard negatives against plain Python."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsmith.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector int, key string, anchor boolean, positive string"


def naive(rows, positives=5, count=5, low=80, high=100):
    """Every anchor against every row, in exact integers."""
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, la in usable:
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i if i is not None else -math.inf, i, label) for i, v, label in usable if i != a and len(v) == len(va)]
        scored.sort(key=lambda s: s[:2])
        for p, _, pi, _ in [s for s in scored if s[3] == la][:positives]:
            inside = [s for s in scored if s[3] != la and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, pi, k + 1, s[2], -p, -s[0]) for k, s in enumerate(inside[:count])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "k", True, "p") for r in rows], SCHEMA).repartition(parts)


def mined(df, **options):
    return found(negatives.mine(df, F.col("vec_id") % 100 == 0, **options))


def test_odd_rows(spark):
    draw = random.Random(3)
    base = [0.5, -0.25, 1.0]
    rows = [(i, [x + draw.choice([0, 0.01, 0.1]) for x in base], draw.choice([0, 0, 1, 2])) for i in range(0, 400)]
    rows += [(i, list(base), draw.choice([0, 1])) for i in range(400, 520)]  # one vector many times: all scores tie
    rows += [(None, list(base), 0), (None, list(base), 1), (600, None, 0), (700, list(base), None), (800, [0.5, None, 1.0], 0), (900, [math.inf, 0.0, 1.0], 0),
             (901, [math.nan, 0.0, 1.0], 1), (1000, [], 0), (1001, [], 0), (1002, [], 1), (1100, [0.5], 3), (1101, [0.4], 3), (1102, [0.45], 1)]
    assert mined(frame(spark, rows)) == naive(rows)


def test_rows_that_share_an_id_are_no_partners(spark):
    rows = [(0, [1.0], 0), (0, [1.0], 0), (0, [1.0], 1), (1, [1.0], 0), (2, [0.9], 1), (2, [0.9], 1)]
    assert mined(frame(spark, rows)) == naive(rows) != []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [3e6, 1 / 256], 0), (2, [3e6, 0.0], 1), (3, [2.9e6, 0.0], 1), (4, [3e6, 2 / 256], 1)]
    assert mined(frame(spark, rows)) == naive(rows) != []
    assert len(mined(frame(spark, [(0, [1e300], 0), (1, [1e300], 0), (2, [1.7e308], 1)]))) == 1  # all scores are the greatest long


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1), (3, [0.0], 0), (4, [0.0], 1), (5, [-0.9], 1)]
    assert mined(frame(spark, rows)) == naive(rows) == [(0, 3, 1, 4, 0, 0)]


def test_small_blocks_and_own_bounds(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(10 * i, [draw.random() for _ in range(4)], i % 3) for i in range(300)]
    expected = naive(rows, 2, 3, 50, 90)
    assert mined(frame(spark, rows), positives=2, negatives=3, low=50, high=90) == expected
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    assert mined(frame(spark, rows), positives=2, negatives=3, low=50, high=90) == expected


def test_empty(spark):
    df = frame(spark, [(1, [1.0], 0)])
    assert mined(df.limit(0)) == [] and mined(df) == [] and negatives.mine(df, F.lit(None)).columns == [c.split()[0] for c in negatives.RESULT.split(", ")]


@pytest.mark.parametrize("scores", [[-(2**62), -1, 0, 1, 2**63 - 1]])
def test_keys_sort_as_their_parts(scores):
    parts = [(place, -s, i) for place in (0, 5) for s in scores for i in (-7, 0, 2**62)]
    place, score, ident = (pa.array(x).to_numpy() for x in zip(*[(p, -s, i) for p, s, i in parts]))
    keys = negatives.packed(place, score, ident)
    assert [p for _, p in sorted(zip(keys, parts))] == sorted(parts)
    assert [x.tolist() for x in negatives.unpacked(pa.array(keys))] == [place.tolist(), score.tolist(), ident.tolist()]
