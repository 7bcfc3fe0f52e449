"""Queries for sources and sinks: tables are written as text and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsmith.catalog.registry import query
from colsmith.session import scratch_path
from colsmith.sources import delimited, stores


def _as_text(df, separator):
    path = scratch_path(df.sparkSession, "text")
    df.write.option("header", True).option("sep", separator).csv(path)
    return path


@query("s1_separator_detection", """
SELECT * FROM (VALUES ('orders', ';'), ('customer', '|'), ('part', ',')) v(table_name, separator)""")
def _(load):
    spark = load("orders").sparkSession
    found = []
    for name, separator in (("orders", ";"), ("customer", "|"), ("part", ",")):
        path = _as_text(load(name), separator)
        votes = delimited.file_separators(spark, path).groupBy("separator").count()
        found.append(votes.groupBy().agg(F.max_by("separator", "count").alias("separator")).select(F.lit(name).alias("table_name"), "separator"))
    return found[0].union(found[1]).union(found[2])


@query("s2_tolerant_scan", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    text = orders.select(F.concat_ws(";", F.col("o_orderkey"), F.concat(F.lit("  "), F.col("o_orderstatus")), F.col("o_orderpriority")).alias("value"))
    # A surplus field makes a row malformed; such rows are skipped.
    broken = orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(";a;b;surplus")).alias("value"))
    path = scratch_path(orders.sparkSession, "scan")
    text.union(broken).write.text(path)
    return (orders.sparkSession.read.schema("o_orderkey string, o_orderstatus string, o_orderpriority string")
            .option("sep", delimited.detect_separator(orders.sparkSession, path)).option("mode", "DROPMALFORMED")
            .option("ignoreLeadingWhiteSpace", True).csv(path))


@query("s3_frame_cleanup", 'SELECT c_custkey AS "customer_key", c_acctbal AS "account_balance" FROM customer')
def _(load):
    df = load("customer").select(
        F.col("c_custkey").alias(" customer key "), F.col("c_acctbal").alias("account  balance"),
        F.lit(None).cast("string").alias("nothing"), F.col("c_name").alias("Unnamed: 0"))
    return delimited.clean_frame(df)[0]


@query("s4_mixed_types", "SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS mixed FROM events")
def _(load):
    df = load("events").select(
        "event_id", F.col("value").cast("string").alias("value"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("mixed"))
    return delimited.settle_types(df)


_LIMITED = ("region", "orders", "events", "lineitem")
_ROWS = 10_000


@query("s5_input_limits", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) <= {_ROWS} AS inside, CASE WHEN count(*) <= {_ROWS} THEN count(*) END AS n FROM {t}" for t in _LIMITED))
def _(load):
    """Tables of several sizes against one row limit: those inside are passed on and counted."""
    found = None
    for name in _LIMITED:
        df = load(name)
        try:
            row = delimited.check_limits(df, max_rows=_ROWS, max_columns=1000).agg(F.lit(name).alias("table_name"), F.lit(True).alias("inside"), F.count(F.lit(1)).alias("n"))
        except delimited.TooLarge:
            row = df.sparkSession.createDataFrame([(name, False, None)], "table_name string, inside boolean, n bigint")
        found = row if found is None else found.unionByName(row)
    return found


@query("s6_numeric_inference", "SELECT event_id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value, event_type FROM events")
def _(load):
    df = load("events").select(
        "event_id", F.when(F.col("event_id") % 20 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"), "event_type")
    return delimited.infer_numbers(df)


@query("s7_export", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(orders.sparkSession, "export")
    stores.export(orders, path, "json")
    return orders.sparkSession.read.schema(orders.schema).json(f"{path}/data")


@query("s7_export_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(orders.sparkSession, "export")
    stores.export(orders, path, "csv")
    return orders.sparkSession.read.schema(orders.schema).option("header", True).csv(f"{path}/data")


@query("s8_correction_store", """
SELECT user_id, event_type AS wrong_action, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL""")
def _(load):
    corrections = load("events").select("event_id", "user_id", "ts", F.col("event_type").alias("wrong_action"))
    path = scratch_path(corrections.sparkSession, "store")
    # Two appends, split by time, read back as one store.
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    stores.append(corrections.where(early), path)
    stores.append(corrections.where(~early), path)
    return stores.read_store(corrections.sparkSession, path, wrong_action="click").groupBy("user_id", "wrong_action").agg(F.count(F.lit(1)).alias("n"))


@query("s9_label_file", """
SELECT 'doc' || doc_id AS dataset, 'quality' AS "column", CASE WHEN quality = 1 THEN 'keep_as_is' ELSE 'drop_column' END AS action, toxic::DOUBLE AS null_pct FROM labels""")
def _(load):
    labels = load("labels").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("dataset"), F.lit("quality").alias("column"),
        F.when(F.col("quality") == 1, "keep_as_is").otherwise("drop_column").alias("action"), F.lit(0.9).alias("confidence"),
        F.struct(F.col("toxic").cast("double").alias("null_pct")).alias("features"))
    path = scratch_path(labels.sparkSession, "labels")
    labels.write.json(path)
    back = stores.read_labels(labels.sparkSession, path, array_file=False)
    return back.select("dataset", "column", "action", F.col("features.null_pct").alias("null_pct"))
