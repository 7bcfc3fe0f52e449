"""Screens of references between columns, word counts in one pass, votes on given scores."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from colsmith.operators import cross, text
from colsmith.plans import models as M


def _referring(spark, shares, values=20_000):
    """A key table and one child table a share; that part of the child's values are keys. Every value stands twice."""
    keys = spark.range(values * 2).select(F.col("id").alias("main_id"))
    tables = {"main": keys}
    for name, share in shares.items():
        inside = int(values * share)
        value = F.when(F.col("n") < inside, F.col("n")).otherwise(F.col("n") + 10 * values)
        tables[name] = spark.range(values * 2).withColumn("n", F.col("id") % values).select(value.alias("main_id"), F.lit("x").alias("other"))
    return tables


def test_screen_refutes_and_leaves_exact_results(spark):
    shares = {"none": 0.0, "half": 0.5, "below": 0.78, "above": 0.82, "all": 1.0}
    tables = _referring(spark, shares)
    pairs = [((name, "main_id"), ("main", "main_id")) for name in shares]
    distinct = {(name, "main_id"): 20_000 for name in shares} | {("main", "main_id"): 40_000}
    possible = {c[0] for c, _ in cross.possible_references(tables, pairs, distinct, 0.8)}
    assert {"above", "all"} <= possible and not {"none", "half"} & possible
    found = {r["table_name"]: r["overlap"] for r in cross.foreign_keys(tables).collect()}
    assert found == {"above": pytest.approx(0.82), "all": 1.0}


def test_screen_is_exact_for_few_values_and_skips_nulls(spark):
    parent = spark.range(1000).select(F.col("id").alias("k"))
    child = spark.createDataFrame([(i if i < 8 else 5000 + i,) for i in range(10)] * 3 + [(None,)], "k long")
    pair = [(("c", "k"), ("p", "k"))]
    counts = {("c", "k"): 10, ("p", "k"): 1000}
    assert cross.possible_references({"p": parent, "c": child}, pair, counts, 0.8) == set()
    assert cross.possible_references({"p": parent, "c": child}, pair, counts, 0.79) == set(pair)
    assert cross.possible_references({"p": parent, "c": child.limit(0)}, pair, {("c", "k"): 0, ("p", "k"): 1000}, 0.8) == set()
    assert cross.possible_references({"p": parent}, [], {}, 0.8) == set()


def test_vocabulary_counts_uses_and_rows(spark):
    rows = ["red red blue", "Blue green", None, "", "red ünï_1 a b", "green"]
    df = spark.createDataFrame([Row(t=t) for t in rows], "t string")
    vocabulary = text.fit_vocabulary(df, "t", 3)
    assert vocabulary.terms == ["blue", "green", "red"]
    import math
    assert vocabulary.idf == pytest.approx([math.log(7 / 3) + 1] * 3)
    assert text.fit_vocabulary(df, "t", 9, ("red", "green")).terms == ["blue", "ünï_1"]
    assert text.fit_vocabulary(df.limit(0), "t").terms == [] and text.fit_vocabulary(df.where("t = ''"), "t").terms == []


def test_soft_vote_of_given_scores(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8], [0.7, 0.3]), (2, [0.5, 0.5], [0.5, 0.5]), (3, None, [1.0, 0.0])], "id int, a array<double>, b array<double>")
    rows = {r["id"]: r for r in M.soft_vote(df, ["a", "b"], ["drop", "keep"]).collect()}
    assert rows[1]["model_action"] == "keep" and rows[1]["model_confidence"] == pytest.approx(0.55)
    assert rows[2]["model_action"] == "drop"
    assert rows[3]["model_action"] is None and rows[3]["model_confidence"] is None


def test_combinations_meet_by_a_shared_column(spark, monkeypatch):
    """Rows go through the shuffle once for all combinations with a column, and one by one where none holds few rows a value."""
    from itertools import combinations

    rows = [(i // 4, i * 7 % 1000, i % 4 if i % 300 else 0, float(i % 5), "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b int, c int, d double, e string")
    wanted = [w for w in combinations("abcde", 3) if set("ab") & set(w)]
    expected = {w: len({tuple(r["abcde".index(c)] for c in w) for r in rows}) for w in wanted}
    tops = {"a": 4, "b": 1, "c": 250, "d": 200, "e": 500}
    assert cross._distinct_combinations(df, wanted, 1000, tops) == expected
    monkeypatch.setattr(cross, "CELLS_PER_TASK", 300)  # no value may hold so few rows: digests, many tasks
    assert cross._distinct_combinations(df, wanted, 1000, {c: 900 for c in "abcde"}) == expected
    # b is a key alone, and a with c or d; their supersets are skipped.
    assert {tuple(r["columns"]) for r in cross.composite_keys(df, "t").collect()} == {("a", "c"), ("a", "d")}


def test_pairs_and_triples_meet_in_one_shuffle(spark, monkeypatch):
    """Rows are shuffled once for all pairs and triples with a column, nulls and both zeros count as values of their own kind."""
    from itertools import combinations

    rows = [(i // 4, i % 4 // 2, i % 2, float(i % 2) * (-1) ** (i // 2), "x" * (64 + i % 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "a long, b int, c int, d double, e string")
    asked = []
    real = cross._distinct_combinations
    monkeypatch.setattr(cross, "_distinct_combinations", lambda plain, wanted, n, tops, distinct: asked.append((list(wanted), cross._meetings(wanted, tops))) or real(plain, wanted, n, tops, distinct))
    found = {tuple(r["columns"]): r["unique_ratio"] for r in cross.composite_keys(df, "t").collect()}
    share = {w: len({tuple(r["abcde".index(c)] for c in w) for r in rows}) / 4000 for size in (2, 3) for w in combinations("abcde", size)}
    pairs = {w: s for w, s in share.items() if len(w) == 2 and s >= 0.995}
    assert found == pairs | {w: s for w, s in share.items() if len(w) == 3 and s >= 0.995 and not any(set(p) < set(w) for p in pairs)}
    assert any(len(w) == 3 for w in found)
    assert len(asked) == 1 and [anchor for anchor, _ in asked[0][1]] == ["a"]
    tops = {"a": 4, "b": 2000, "e": 2000}
    assert real(df.withColumn("b", F.nullif("b", F.lit(0))), [("a", "b"), ("a", "b", "e")], 4000, tops) == {
        w: len({tuple(r["abcde".index(c)] for c in w) for r in rows}) for w in [("a", "b"), ("a", "b", "e")]}
