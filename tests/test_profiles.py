"""Profiles, semantic types, targets, health and relations on small frames."""

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsmith.functions import constants
from colsmith.functions.scalar import once
from colsmith.operators import cross, health, semantic
from colsmith.operators.profile import APPROXIMATE, WITH_SEMANTICS, json_depth, profile


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{i:09d}xx", float(v), "low" if i % 2 else "high", f"user{i}@mail.org", None if i % 10 < 7 else 1.0, 42, i % 2, f"https://x.org/{i}", f"555{i:07d}", f"2024-01-{i % 28 + 1:02d}")
            for i, v in enumerate(rng.gamma(2, 2, 200))]
    df = spark.createDataFrame(rows, "patient_id string, amount double, risk string, email string, sparse double, constant int, is_fraud int, photo_url string, contact string, dob string")
    return profile({"people": df}, WITH_SEMANTICS).persist(), df


def rows_of(df):
    return {r["column_name"]: r for r in df.collect()}


def test_moments_equal_the_sample_formulas(people):
    found = rows_of(people[0])["amount"]
    x = np.array([r["amount"] for r in people[1].collect()])
    n, m = len(x), x.mean()
    g1 = ((x - m) ** 3).mean() / x.std() ** 3
    g2 = ((x - m) ** 4).mean() / x.std() ** 4 - 3
    assert found["skewness"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2))
    assert found["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert found["median"] == pytest.approx(np.median(x)) and found["std"] == pytest.approx(x.std(ddof=1))


def test_counts_flags_and_patterns(people):
    found = rows_of(people[0])
    assert found["sparse"]["null_pct"] == pytest.approx(0.7) and found["constant"]["unique_count"] == 1
    assert found["risk"]["is_ordinal"] and found["risk"]["is_categorical"] and found["risk"]["entropy"] == pytest.approx(1.0)
    assert found["email"]["matches_email_pattern"] == 1.0 and found["photo_url"]["matches_url_pattern"] == 1.0


def test_semantic_types(people):
    found = rows_of(semantic.semantic_types(people[0]))
    assert {c: found[c]["semantic_type"] for c in ("email", "photo_url", "contact", "patient_id", "is_fraud", "amount", "risk", "dob")} == {
        "email": "email", "photo_url": "url", "contact": "phone", "patient_id": "identifier", "is_fraud": "boolean", "amount": "numeric",
        "risk": "categorical", "dob": "datetime"}


def test_targets(people):
    found = rows_of(semantic.target_columns(people[0]))
    assert found["is_fraud"]["target_method"] == "exact_name" and not found["patient_id"]["is_target"]
    assert rows_of(semantic.target_columns(people[0], "amount"))["amount"]["target_confidence"] == 1.0


def test_health(people):
    found = rows_of(health.column_health(people[0]))
    assert found["constant"]["health_score"] == 70 and "every value is the same" in found["constant"]["anomalies"]
    assert found["sparse"]["severity"] == "critical" and found["amount"]["data_type"] == "numeric"


def test_approximate_counts_need_no_value_counts(people):
    exact, rough = rows_of(people[0]), rows_of(profile({"people": people[1]}, APPROXIMATE))
    for name, r in rough.items():
        assert r["unique_count"] == pytest.approx(exact[name]["unique_count"], rel=0.04)
        assert r["unique_count"] == 1 or r["entropy"] is None
    assert rough["amount"]["median"] == exact["amount"]["median"]


def test_empty_and_all_null_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert rows_of(profile({"t": empty}, WITH_SEMANTICS))["a"]["row_count"] == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "a double, b string")
    found = rows_of(profile({"t": nulls}, WITH_SEMANTICS))
    assert found["a"]["null_pct"] == found["b"]["null_pct"] == 1.0 and found["b"]["unique_count"] == 0


def test_json_depth(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"a": {"b": [1, 2]}}',), ("{}",), ('{"a": "x{["}',), ("plain",)], "x string")
    assert [r[0] for r in df.select(json_depth(F.col("x"))).collect()] == [1.0, 3.0, 0.0, 1.0, None]


@pytest.mark.parametrize("value, depth", [
    ('{"k": "' + "x" * 1_000_000 + '"}', 1.0), ('["' + '\\\\\\"[{' * 200_000 + '", [1]]', 2.0), ("[" + "1," * 400_000 + "[[2]]]", 3.0), ("[" * 1_000_000, None), ('{"' * 300_000, None)])
def test_json_depth_of_long_values(spark, value, depth):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(json_depth(F.col("x"))).first()[0] == depth


LONG = ("1", "a", "0a", "b.", "a@", ",000", " ", "-", "A", "/a", '"\\', "1,", "$1", "é", "[{")


def test_profiles_of_very_long_texts(spark):
    rows = [(part * (1_000_000 // len(part)), i % 2) for i, part in enumerate(LONG)] + [("$1" + ",000" * 200_000, 0), ("a@" + "b." * 500_000, 0), ("1" * 1_000_000 + "x", 1), ("1." * 500_000, 1)]
    found = rows_of(profile({"t": spark.createDataFrame(rows, "x string, n int")}, WITH_SEMANTICS))
    assert found["x"]["row_count"] == len(rows) and found["x"]["max_length"] == 1_000_002


@settings(deadline=None, max_examples=300)
@given(st.text("019.,$%-a@b_ x€", max_size=14))
def test_patterns_that_try_once_find_the_same(text):
    tables = (constants.VALUE_PATTERNS, constants.CONTENT_PATTERNS, constants.DOMAIN_PATTERNS, constants.SEMANTIC_PATTERNS, constants.SECOND_PATTERNS, constants.LOOKS_PATTERNS)
    for p in [*constants.COMPLEXITY_PATTERNS, constants.EMAIL, *(p for t in tables for p in t.values())]:
        if once(p) != p:
            assert bool(regex.search(p, text)) == bool(regex.search(once(p), text)), p
            assert bool(regex.match(f"(?:{p})", text)) == bool(regex.match(f"(?:{once(p)})", text)) or p in constants.COMPLEXITY_PATTERNS, p


def test_cramers_v_against_the_full_grid(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 3, 300), rng.integers(0, 4, 300)
    b = np.where(rng.random(300) < 0.5, a, b)
    df = spark.createDataFrame([(int(x), int(y), int(x > 0), int(y > 1)) for x, y in zip(a, b)], "a int, b int, c int, d int")
    found = {(r["column_name"], r["other"]): r["cramers_v"] for r in cross.cramers_v(df, [("a", "b"), ("c", "d"), ("a", "a")]).collect()}
    grid = np.array([[np.sum((a == i) & (b == j)) for j in range(4)] for i in range(3)], float)
    e = np.outer(grid.sum(1), grid.sum(0)) / 300
    assert found["a", "b"] == pytest.approx(np.sqrt(((grid - e) ** 2 / e).sum() / (300 * 2)))
    c, d = a > 0, b > 1
    two = np.array([[np.sum((c == i) & (d == j)) for j in (False, True)] for i in (False, True)], float)
    e = np.outer(two.sum(1), two.sum(0)) / 300
    assert found["c", "d"] == pytest.approx(np.sqrt((np.maximum(np.abs(two - e) - 0.5, 0) ** 2 / e).sum() / 300))
    assert found["a", "a"] == pytest.approx(1.0)


def test_associations_with_keys_and_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    long = ["x" * 100 + str(i) for i in range(4)]
    rows = [(f"id{i}", long[i % 4], None if i % 5 == 0 else "pq"[i % 2], int(rng.integers(0, 3)), "same", None) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, long string, gaps string, few int, constant string, nothing string")
    monkeypatch.setattr(cross, "PAIRS_PER_JOB", 4)
    found = {(r["column_name"], r["other"]): r["cramers_v"] for r in cross.associations(df, "t", 0.0).collect()}
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1:]]
    want = {(r["column_name"], r["other"]): r["cramers_v"] for r in cross.cramers_v(df, pairs).collect()}
    assert found.keys() == want.keys() and len(found) == 10
    assert all(found[k] == pytest.approx(want[k]) for k in want)
    assert found["key", "gaps"] == pytest.approx((48 / 60) ** 0.5) and found["key", "constant"] == 0.0


def test_composite_keys_by_brute_force(spark):
    df = spark.createDataFrame([(i // 10, i % 10, i % 3) for i in range(100)], "a int, b int, c int")
    assert [sorted(r["columns"]) for r in cross.composite_keys(df, "t").collect()] == [["a", "b"]]


def test_correlations_and_references(spark):
    df = spark.createDataFrame([(i, 2.0 * i, float(i % 5)) for i in range(50)], "a int, b double, c double")
    assert {(r["column_name"], r["other"]) for r in cross.correlations(df, "t").collect()} == {("a", "b"), ("b", "a")}
    child = spark.createDataFrame([(i % 20,) for i in range(100)], "city_id int")
    parent = spark.createDataFrame([(i,) for i in range(30)], "city_id int")
    assert cross.foreign_keys({"visits": child, "cities": parent}).first()["other_table"] == "cities"


def test_long_columns_of_few_values_take_quartiles_from_their_counts(spark, monkeypatch):
    from colsmith.operators import profile as P

    def refuse(*_):
        raise AssertionError("the rows were read again")

    monkeypatch.setattr(P, "DIRECT_ROWS", 50)
    monkeypatch.setattr(P, "exact_quantiles", refuse)
    rows = [(None if i % 10 == 0 else i % 7, float(i % 3) / 4, i % 5 == 0, None if i % 4 == 0 else "x" * (i % 3 * 40), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b double, c boolean, t string, own int")
    found = rows_of(profile({"t": df.drop("own")}, WITH_SEMANTICS))
    for name, column in (("a", 0), ("b", 1), ("c", 2)):
        x = np.array([float(r[column]) for r in rows if r[column] is not None])
        r = found[name]
        assert (r["row_count"], r["present"], r["unique_count"]) == (400, len(x), len(set(x)))
        assert [r["q25"], r["median"], r["q75"]] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
        assert (r["mean"], r["std"], r["zeros"]) == (pytest.approx(x.mean()), pytest.approx(x.std(ddof=1)), int((x == 0).sum()))
        assert r["skew_pop"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3)
    digits = np.array([len(str(r[0])) for r in rows if r[0] is not None])
    assert (found["a"]["avg_length"], found["a"]["length_std"]) == (digits.mean(), digits.std())
    sizes = np.array([len(r[3]) for r in rows if r[3] is not None])
    t = found["t"]
    assert (t["min_length"], t["max_length"], t["unique_count"], t["null_count"]) == (0, 80, 3, 100)
    assert (t["avg_length"], t["length_std"]) == (pytest.approx(sizes.mean()), pytest.approx(sizes.std(ddof=1)))
    with pytest.raises(AssertionError, match="read again"):  # only columns of more distinct values go back to their rows
        profile({"t": df.select("own")})


def test_json_is_told_by_its_start(spark):
    values = ['{"a": 1}', " \t[1, 2]", "\r\n-1.5", "true", "nothing", '"x"', "", " ", "+1", "x{", "null", "NaN", None]
    from colsmith.functions.scalar import is_json
    df = spark.createDataFrame([(v,) for v in values], "v string")
    plain = F.try_parse_json("v").isNotNull()
    assert [tuple(r) for r in df.where(is_json(F.col("v")) != plain).collect()] == []


def test_patterns_see_the_same_in_texts_with_alike_digits(spark, monkeypatch):
    """Few texts stand for many that differ in digits only; every measure is that of the texts themselves."""
    from colsmith.operators import profile as P

    texts = ["2024-03-17", "1970-01-01", "9999-12-31x", "$1,234.56", "0", "1", "7", "+12345678901", "(234) 567-8901", "4242-4242-4242-4242", "123-45-6789", "a2@b3.org", "https://x9.org/27",
             '{"a2": 1, "a3": [2]}', '{"a2": 1, "a2": 2}', '{"a": 23, "b": 45}', '{"2\\"": 1, "3\\"": 2}', '["2", "3"]', '{"a": "2"}', '{"2" :1, "3" :2}', '"x2', "2e400", "1E5", "007", "77", "7.5%", "AB12", "ab12cd34-1234-1234-1234-123456789abc", "12/31/1999", "Jan 23, 2024", "n/a", "  3  ", "Ünï 22", "1.0",
             "x" * 70 + "27", "X" * 70, "23 na 45", "12345-6789", None, ""]
    columns = [[f"https://host{i % 9}.example.com/{i:06d}" for i in range(3000)], [texts[i % len(texts)] for i in range(3000)], [f"User {i % 1500}" if i % 2 else f"USER {i % 1500}" for i in range(3000)]]
    df = spark.createDataFrame(list(zip(*columns)), "url string, mixed string, cased string")
    found = P.raw_profiles({"t": df}, WITH_SEMANTICS)
    fields = P.fields_of({"t": df})
    tried = spark.createDataFrame([(u,) for u in columns[0]], "u string").select(P.alike(F.col("u"))).distinct().count()
    assert tried <= 3 ** 5 * 3 * 4
    payloads = spark.range(3000).select(P.alike(F.concat(F.lit('{"a": {"b": ['), F.col("id").cast("string"), F.lit("]}}"))))
    assert payloads.distinct().count() <= 3 ** 4 + 3 ** 3 + 3 ** 2 + 3
    monkeypatch.setattr(P, "alike", lambda x: x)
    assert P.raw_profiles({"t": df}, WITH_SEMANTICS) == found
    at = P._raw_names().index("unique_lower")
    assert [r[at] for r in found] == [len({t.lower() for t in c if t is not None}) for c in columns] and len(fields) == 3


def test_quartiles_of_long_columns_from_their_counts(spark, monkeypatch):
    """Equal steps find the values to order; a column whose values lie in one step is read from the rows."""
    from colsmith.operators import profile as P
    from colsmith.operators import quantiles

    monkeypatch.setattr(P, "DIRECT_ROWS", 50)
    read = set()
    real = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda df, brackets: read.update(b.column for b in brackets) or real(df, brackets))
    rng = np.random.default_rng(3)
    even, steep = rng.normal(0, 1, 4001), np.append(rng.random(4000), 1e12)
    many = rng.integers(0, 300, 4001)
    df = spark.createDataFrame([(float(a), float(b), int(c), None if i % 3 else i) for i, (a, b, c) in enumerate(zip(even, steep, many))], "even double, steep double, many long, gaps long")
    found = rows_of(profile({"t": df}))
    gaps = [i for i in range(4001) if i % 3 == 0]
    for name, x in (("even", even), ("steep", steep), ("many", many), ("gaps", gaps)):
        assert [found[name][q] for q in ("q25", "median", "q75")] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
    assert read == {"c1"}


def test_number_counts_travel_packed(spark, monkeypatch):
    """Numbers and times are counted many values a row, whatever the sizes of stretches, runs and batches; no row a cell is made."""
    import datetime
    from collections import Counter

    from colsmith.operators import packed
    from colsmith.operators import profile as P

    def refuse(*_):
        raise AssertionError("one row a cell")

    rng = np.random.default_rng(11)
    ends = [-2 ** 63, 2 ** 63 - 1, 0, -1, 99999, -999, 10 ** 9, 10 ** 15, 10 ** 15 - 1, -10 ** 18]
    rows = [(int(ends[i]) if i < len(ends) else int(rng.integers(-400, 400)), None if i % 7 == 0 else float(rng.integers(-30, 30)) / 4 * (-1 if i % 2 else 1) * (i % 3), i * 37, i % 3 == 0,
             datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 50), datetime.datetime(1960, 1, 1) + datetime.timedelta(microseconds=i * 7), None, float("inf") if i == 5 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b double, own long, c boolean, d date, t timestamp, e int, far double").repartition(5)
    whole = P.raw_profiles({"t": df}, WITH_SEMANTICS)
    monkeypatch.setattr(P, "stacked", refuse)
    monkeypatch.setattr(packed, "STRETCH_ROWS", 100)
    monkeypatch.setattr(packed, "RUN_VALUES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = rows_of(P.derive(P.raw_table(spark, P.raw_profiles({"t": df}, WITH_SEMANTICS))))
        counts = P._packed_counts(P.fields_of({"t": df}))
        assert counts.where("k = 2").count() < 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    other = rows_of(P.derive(P.raw_table(spark, whole)))
    for place, name in enumerate(df.columns):
        values = Counter(r[place] + 0.0 if isinstance(r[place], float) else r[place] for r in rows if r[place] is not None)
        r, n = found[name], sum(values.values())
        assert (r["row_count"], r["present"], r["unique_count"], r["top_count"]) == (3000, n, len(values), max(values.values(), default=0))
        assert r["sum_n_log"] == pytest.approx(sum(m * np.log2(m) for m in values.values()))
        if r["is_numeric"] and n:
            x = np.array([float(v) for v in values.elements()])
            assert (r["min_value"], r["max_value"], r["zeros"], r["negatives"]) == (x.min(), x.max(), (x == 0).sum(), (x < 0).sum())
            assert [r["q25"], r["median"], r["q75"]] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
            if np.isfinite(x).all():
                low, high = r["q25"] - 1.5 * r["iqr"], r["q75"] + 1.5 * r["iqr"]
                assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1)) and r["outlier_count"] == ((x < low) | (x > high)).sum()
        assert all(other[name][c] == pytest.approx(r[c], nan_ok=True) for c in ("mean", "std", "skew_pop", "avg_length", "length_std", "sem_phone", "sem_alnum", "encoded_nulls", "outlier_count") if r[c] is not None)
    sizes = np.array([len(str(r[0])) for r in rows])
    assert (found["a"]["avg_length"], found["a"]["length_std"]) == (pytest.approx(sizes.mean()), pytest.approx(sizes.std(ddof=1)))
    assert found["a"]["sem_phone"] == pytest.approx(sum(10 <= len(str(r[0])) <= 15 and r[0] >= 0 for r in rows) / 3000)


def test_text_counts_travel_packed(spark, monkeypatch):
    """Texts are counted many values a row on their way, whatever the sizes of stretches, blocks and batches; no row a cell is made."""
    from collections import Counter

    from colsmith.operators import packed
    from colsmith.operators import profile as P

    def refuse(*_):
        raise AssertionError("one row a cell")

    made = lambda i: [None, "", f"user{i % 900}@mail.example.com", "ü" * 64, "ü" * 65, "a" * 65, "x" * 64 + str(i % 3), "\x00", " ", f"№{i}"][i % 10]
    rows = [(made(i), "same", None, f"url{i}", made(i * 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").repartition(5)
    fields = P.fields_of({"t": df})
    expected = P._text_counts(fields).collect()
    monkeypatch.setattr(P, "stacked", refuse)
    monkeypatch.setattr(packed, "STRETCH_ROWS", 100)
    monkeypatch.setattr(packed, "BLOCK_TEXTS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = P.Counts.of(fields).texts.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda d: d and (d.split("#")[0], int(d.split("#")[1]))
    assert Counter((r.k, r.word, plain(r.digest), r.n) for r in found) == Counter((r.k, r.word, plain(r.digest), r.n) for r in expected)
    empty = P.Counts.of(P.fields_of({"t": df.where("b is null")})).texts
    assert empty.count() == 0


def test_profile_counts_come_in_batches_of_rows(spark, monkeypatch):
    """While values are counted Spark does not add up the sizes of all columns after each row; afterwards the session is as before."""
    from colsmith.operators import packed
    from colsmith.operators import profile as P

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    make = P.Counts.of
    monkeypatch.setattr(P.Counts, "of", lambda fields: seen.append(spark.conf.get(key)) or make(fields))
    df = spark.range(10)
    P.raw_profiles({"t": df})
    assert seen == [str(2 ** 31 - 1)] and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), packed.batches_of_rows(spark):
        1 / 0
    assert spark.conf.get(key) == before


def test_rows_of_messy_are_dealt_out(spark, tmp_path):
    """Orders in one stretch of one file do not leave the making and counting of all texts to one task."""
    from colsmith.catalog.shared import messy

    made = spark.range(2000).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "id / 3.0D AS o_totalprice", "timestamp'2024-01-01' AS o_orderdate")
    made.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = messy(lambda t: spark.read.parquet(str(tmp_path / f"{t}.parquet"))).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2000 and max(sizes) < 1000
