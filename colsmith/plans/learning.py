"""Learning from user corrections: patterns, rules, their validation and their use.

Corrections are rows (correction_id, user_id, ts, table_name, column_name, wrong_action, correct_action and
the statistics of the column). Everything is grouping over that table. Rules meet profiles by keys that like columns must
share; only reports of every column against every rule read the rules in broadcast blocks of a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions import scalar as S
from colsmith.operators.features import zero
from colsmith.session import BROADCAST_ROWS

MIN_SUPPORT = 10
SIMILARITY = 0.85
CONFIDENCE_DIGITS = 9  # decimals in which confidences differ at all
RANGE_KEYS = ("null_pct", "unique_ratio", "skewness", "kurtosis", "mean", "std")
FLAG_KEYS = ("is_numeric", "is_categorical", "is_temporal", "has_outliers")

# Weights of the statistics two columns are compared by.
WEIGHTS = {
    "null_pct": 0.15, "unique_ratio": 0.15, "skewness": 0.10, "kurtosis": 0.05, "outlier_pct": 0.10, "entropy": 0.05,
    "is_numeric": 0.15, "is_categorical": 0.10, "is_temporal": 0.05, "is_boolean": 0.05, "cardinality": 0.05,
}


def pattern_type() -> Column:
    """Coarse kind of a column from its statistics."""
    null, skew, tails = zero("null_pct"), F.abs(zero("skewness")), zero("outlier_pct")
    number = (
        F.when(null > 0.5, "numeric_high_nulls").when(null > 0.1, "numeric_medium_nulls").when(skew > 2.0, "numeric_high_skewness")
        .when(skew > 1.0, "numeric_medium_skewness").when(tails > 0.1, "numeric_many_outliers").otherwise("numeric_normal"))
    category = (
        F.when(F.col("unique_ratio") > 0.9, "categorical_high_uniqueness").when(F.col("unique_count") > 50, "categorical_high_cardinality")
        .when(F.col("unique_count") < 10, "categorical_low_cardinality").otherwise("categorical_medium_cardinality"))
    return F.when(F.col("is_numeric"), number).when(F.col("is_string"), category).otherwise("unknown")


def fingerprint(kind: Column) -> Column:
    """Stable hash of the coarse kind, so that like columns support each other."""
    return F.substring(F.sha2(kind, 256), 1, 16)


def record_corrections(corrections: DataFrame, profile: DataFrame) -> DataFrame:
    """Attach the column statistics, the pattern type and its hash to raw corrections."""
    facts = profile.select(
        "table_name", "column_name", "null_pct", "unique_ratio", "unique_count", "skewness", "kurtosis", "mean", "std", "outlier_pct", "entropy",
        "is_numeric", "is_categorical", "is_string", "is_temporal", F.coalesce("has_outliers", F.lit(False)).alias("has_outliers"),
        (F.col("type_name") == "boolean").alias("is_boolean"), F.col("unique_count").alias("cardinality"))
    # One row per profiled column: small by nature, and still checked.
    side = F.broadcast(facts) if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else facts
    return corrections.join(side, ["table_name", "column_name"]).withColumn("pattern_type", pattern_type()).withColumn(
        "pattern_hash", fingerprint(F.col("pattern_type")))


def learned_rules(recorded: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """One rule per (pattern type, corrected action) with enough support; its template holds the means."""
    numbers = ("null_pct", "unique_ratio", "skewness", "kurtosis", "outlier_pct", "entropy", "cardinality")
    flags = ("is_numeric", "is_categorical", "is_temporal", "is_boolean")
    grouped = recorded.groupBy("pattern_type", "correct_action").agg(
        F.count(F.lit(1)).alias("support_count"), F.avg("system_confidence").alias("system_confidence"),
        *[F.avg(c).alias(c) for c in numbers], *[(F.avg(F.col(c).cast("int")) >= 0.5).alias(c) for c in flags])
    share = F.col("support_count") / (F.col("support_count") + min_support)
    return grouped.where(F.col("support_count") >= min_support).select(
        F.concat_ws("_", F.lit("LEARNED"), "pattern_type", "correct_action").alias("rule_name"), "pattern_type",
        F.col("correct_action").alias("recommended_action"), "support_count", F.least(F.lit(0.95), 0.5 + share / 2).alias("base_confidence"),
        F.struct(*numbers, *flags).alias("template"))


def similarity(template: Column, of: dict[str, Column]) -> Column:
    """Weighted likeness of a column's statistics to a rule template, from 0 to 1.

    Statistics the template lacks do not count; statistics the column lacks count as unlike.
    """
    score, total = F.lit(0.0), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        want, have = template[name], of[name]
        if name.startswith("is_"):
            part = F.when(want == have, 1.0)
        elif name in ("null_pct", "unique_ratio", "outlier_pct"):
            gap = F.abs(want - have)
            part = F.when(gap <= 0.15, 1 - gap / 0.15)
        elif name in ("skewness", "kurtosis"):
            sign = lambda c: F.when(c < -0.5, -1).when(c > 0.5, 1).otherwise(0)
            part = F.when(want.isNotNull() & have.isNotNull() & (sign(want) == sign(have)), 1.0)
        elif name == "cardinality":
            gap = F.abs(F.log10(F.greatest(want.cast("double"), F.lit(1.0))) - F.log10(F.greatest(have.cast("double"), F.lit(1.0))))
            part = F.when((want > 0) & (have > 0) & (gap <= 1), 1 - gap)
        else:
            part = F.lit(0.0)
        score = score + F.coalesce(part, F.lit(0.0)) * weight
        total = total + F.when(want.isNotNull(), weight).otherwise(0.0)
    return F.when(total > 0, score / total).otherwise(0.0)


def _against_all(columns: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Every row of ``columns`` beside every row of ``few``, which is broadcast in blocks of at most about ``BROADCAST_ROWS`` rows."""
    blocks = -(-few.count() // BROADCAST_ROWS) or 1
    found = None
    for b in range(blocks):
        part = few if blocks == 1 else few.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        pairs = columns.join(F.broadcast(part), F.lit(True))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _statistics() -> dict[str, Column]:
    of = {n: F.col(n) for n in WEIGHTS if n not in ("is_boolean", "cardinality")}
    return of | {"is_boolean": F.col("type_name") == "boolean", "cardinality": F.col("unique_count")}


_RULE = ("rule_name", "recommended_action", "base_confidence", "support_count", "template")
_PAIR = ("table_name", "column_name", "rule_name", "recommended_action", "base_confidence", "support_count")


def rule_similarities(profile: DataFrame, rules: DataFrame) -> DataFrame:
    """Likeness of every profiled column to every learned rule: a report as large as its definition says.

    Decisions need the like pairs only and take them from ``similar_rules``.
    """
    pairs = _against_all(profile, rules.select(*_RULE), "rule_name")
    return pairs.select(*_PAIR, similarity(F.col("template"), _statistics()).alias("similarity"))


def similar_rules(profile: DataFrame, rules: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs of ``rule_similarities`` from ``threshold`` on, found by an equi-join instead of by trying all pairs.

    A column that is like enough loses at most 1 - threshold of the weights. A statistic whose own loss would be larger is a
    condition, so it becomes a key: a flag that weighs more must agree, and a share must lie within the allowed gap, that is in
    the same or a neighbouring band of that width. Each rule is written once for every band it can meet. Statistics a template lacks
    are no condition, so such a rule meets every band; thresholds that leave no condition compare everything.
    """
    lost = 1 - threshold + 1e-9
    flags = [n for n in WEIGHTS if n.startswith("is_") and WEIGHTS[n] + WEIGHTS["entropy"] > lost]
    shares = [n for n in ("null_pct", "unique_ratio") if WEIGHTS[n] + WEIGHTS["entropy"] > lost]
    if not flags and not shares:
        return rule_similarities(profile, rules).where(F.col("similarity") >= threshold)
    of, t = _statistics(), F.col("template")
    width = 0.15
    bands = int(1 / width) + 1
    side, columns, keys = rules.select(*_RULE), profile, []
    for n in flags:
        # Entropy never agrees, so a template that has it has lost its weight already; one without it may spend that elsewhere.
        free = t[n].isNull() | t["entropy"].isNull()
        side = side.withColumn(f"__{n}", F.explode(F.when(free, F.array(F.lit(True), F.lit(False), F.lit(None))).otherwise(F.array(t[n]))))
        columns = columns.withColumn(f"__{n}", of[n])
        keys.append(f"__{n}")
    band = lambda c: F.greatest(F.lit(0), F.least(F.lit(bands - 1), F.floor(c / width).cast("int")))
    for n in shares:
        near = F.sequence(F.greatest(F.lit(0), band(t[n]) - 1), F.least(F.lit(bands - 1), band(t[n]) + 1))
        every = F.concat(F.sequence(F.lit(0), F.lit(bands - 1)), F.array(F.lit(None).cast("int")))
        side = side.withColumn(f"__{n}", F.explode(F.when(t[n].isNull() | t["entropy"].isNull(), every).otherwise(near)))
        columns = columns.withColumn(f"__{n}", band(of[n]))
        keys.append(f"__{n}")
    c, r = columns.alias("c"), side.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}"))
    pairs = c.join(r, same).select("c.*", *[F.col(f"r.{x}") for x in _RULE])
    return pairs.select(*_PAIR, similarity(F.col("template"), of).alias("similarity")).where(F.col("similarity") >= threshold)


def learned_decisions(similarities: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Candidates from learned rules that are like enough."""
    scale = 0.9 + 0.1 * (F.col("similarity") - threshold) / (1 - threshold)
    return similarities.where(F.col("similarity") >= threshold).select(
        "table_name", "column_name", F.col("recommended_action").alias("action"),
        F.least(F.col("base_confidence") * scale, F.lit(0.95)).alias("confidence"), F.lit(120).alias("priority"), F.col("rule_name").alias("rule"))


def merge_candidates(rule_decisions: DataFrame, learned: DataFrame) -> DataFrame:
    """The surer of the catalogue's decision and the best learned candidate of each column.

    Confidences are compared to nine decimals, as rules of one pattern have equal means but for the last bits of their sums. Of equal
    candidates the greatest action and then rule name wins; the catalogue wins against an equal candidate.
    """
    sure = lambda c: F.round(c, CONFIDENCE_DIGITS)
    ranked = F.struct(sure(F.col("confidence")).alias("sure"), "action", "rule", "confidence")
    best = learned.groupBy("table_name", "column_name").agg(F.max(ranked).alias("l"))
    joined = rule_decisions.join(best, ["table_name", "column_name"], "left")
    better = F.col("l.sure") > sure(F.col("confidence"))
    return joined.select("table_name", "column_name", *[F.when(better, F.col(f"l.{c}")).otherwise(F.col(c)).alias(c) for c in ("action", "confidence", "rule")],
                         F.when(better, "learned").otherwise("symbolic").alias("source"))


def validate_rules(heldout: DataFrame, rules: DataFrame, min_rows: int = 20, floor: float = 0.80) -> DataFrame:
    """Accuracy of each rule on corrections of its pattern type it was not learned from."""
    joined = heldout.join(rules.select("rule_name", "pattern_type", "recommended_action"), "pattern_type")
    right = F.avg((F.col("correct_action") == F.col("recommended_action")).cast("double"))
    found = joined.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"))
    return found.withColumn("validated", (F.col("n") >= min_rows) & (F.col("accuracy") >= floor))


def ab_outcomes(log: DataFrame, validated: DataFrame, min_decisions: int = 100, floor: float = 0.80) -> DataFrame:
    """Promote, reject or continue each rule from its logged test decisions (rule_name, correct)."""
    counted = log.groupBy("rule_name").agg(F.count(F.lit(1)).alias("decisions"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    joined = counted.join(validated.select("rule_name", "validated"), "rule_name", "left")
    good = (F.col("accuracy") >= floor) & F.coalesce("validated", F.lit(False))
    return joined.select("rule_name", "decisions", "accuracy",
                         F.when(F.col("decisions") < min_decisions, "continue").when(good, "promote").otherwise("reject").alias("outcome"))


def rule_status(rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rules with their stage: production, rejected or testing."""
    stage = F.when(F.col("outcome") == "promote", "production").when(F.col("outcome") == "reject", "rejected").otherwise("testing")
    return rules.join(outcomes.select("rule_name", "outcome", "accuracy"), "rule_name", "left").withColumn("stage", stage).withColumn(
        "is_active", F.col("stage") != "rejected")


def traffic_split(decisions: DataFrame, key: str) -> DataFrame:
    """Half of the decisions see the rules under test, by a stable hash."""
    return decisions.withColumn("in_test", S.stable_bucket(F.col(key), 2) == 0)


def running_accuracy(log: DataFrame) -> DataFrame:
    """Mean outcome per rule over its validation log."""
    return log.groupBy("rule_name").agg(
        F.count_if("correct").alias("successes"), F.count_if(~F.col("correct")).alias("failures"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def range_patterns(recorded: DataFrame, min_support: int = 10, min_share: float = 0.8, examples: int = 5) -> DataFrame:
    """Value ranges and constant flags shared by all corrections towards one action.

    ``examples`` is how many column names, in alphabetical order, illustrate a pattern; it changes nothing else.
    """
    named = recorded.select("correct_action", "column_name").distinct()
    first = named.withColumn("nth", F.row_number().over(W.partitionBy("correct_action").orderBy("column_name"))).where(F.col("nth") <= examples)
    shown = first.groupBy("correct_action").agg(F.array_sort(F.collect_list("column_name")).alias("examples"))
    grouped = recorded.groupBy("correct_action").agg(
        F.count(F.lit(1)).alias("support"), *[F.min(k).alias(f"{k}_min") for k in RANGE_KEYS], *[F.max(k).alias(f"{k}_max") for k in RANGE_KEYS],
        *[F.when(F.min(k) == F.max(k), F.min(k)).alias(f"{k}_is") for k in FLAG_KEYS]).join(shown, "correct_action")
    total = recorded.agg(F.count(F.lit(1)).alias("total"))
    return grouped.crossJoin(F.broadcast(total)).withColumn("confidence", F.col("support") / F.col("total")).where(
        (F.col("support") >= min_support) & (F.col("confidence") >= min_share)).drop("total")


def match_ranges(profile: DataFrame, patterns: DataFrame, floor: float = 0.8) -> DataFrame:
    """Columns that meet at least four fifths of a pattern's conditions."""
    met, total = F.lit(0), F.lit(0)
    for k in RANGE_KEYS:
        known = F.col(f"p.{k}_min").isNotNull() & F.col(f"c.{k}").isNotNull()
        total = total + known.cast("int")
        met = met + F.coalesce(F.col(f"c.{k}").between(F.col(f"p.{k}_min"), F.col(f"p.{k}_max")), F.lit(False)).cast("int")
    for k in FLAG_KEYS:
        have = F.coalesce(F.col(f"c.{k}"), F.lit(False))
        total = total + F.col(f"p.{k}_is").isNotNull().cast("int")
        met = met + F.coalesce(F.col(f"p.{k}_is") == have, F.lit(False)).cast("int")
    # Patterns that hold for a share s of all corrections are 1 / s at most, whatever actions corrections name; others come in blocks.
    pairs = _against_all(profile.select(F.struct("table_name", "column_name", *RANGE_KEYS, *FLAG_KEYS).alias("c")),
                         patterns.select(F.struct(*patterns.columns).alias("p"), F.col("correct_action").alias("__key")), "__key")
    return pairs.select("c.table_name", "c.column_name", "p.correct_action", F.when(total > 0, met / total).otherwise(F.lit(0.0)).alias("match")).where(
        F.col("match") >= floor)


def mine_corrections(corrections: DataFrame, since: Column | None = None, least: int = 5, rule_at: int = 10) -> DataFrame:
    """Frequent (original, corrected) pairs among all corrections, or those from ``since`` on."""
    chosen = corrections if since is None else corrections.where(F.col("ts").cast("timestamp") >= since)
    grouped = chosen.groupBy("wrong_action", "correct_action").agg(F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") >= least).select(
        "wrong_action", "correct_action", "n", (F.col("n") >= rule_at).alias("is_rule"), F.least(F.lit(0.95), F.col("n") / 20).alias("confidence"))


def learning_metrics(corrections: DataFrame, now: Column) -> DataFrame:
    """Totals, the last seven days and corrections per day."""
    recent = F.count_if(F.col("ts").cast("timestamp") >= now - F.expr("INTERVAL 7 DAYS"))
    return corrections.agg(F.count(F.lit(1)).alias("total"), recent.alias("last_7_days"), F.countDistinct("correct_action").alias("actions")).withColumn(
        "velocity_per_day", F.col("last_7_days") / 7)


def top_rules(rules: DataFrame, accuracy: DataFrame, n: int = 10) -> DataFrame:
    return rules.join(accuracy, "rule_name", "left").orderBy(F.desc("support_count"), "rule_name").limit(n).select(
        "rule_name", "recommended_action", "support_count", (zero("accuracy") * 100).alias("accuracy"))


def readable_rules(status: DataFrame) -> DataFrame:
    """Rules as sentences."""
    t = F.col("template")
    conditions = F.concat_ws(
        ", ", F.when(t["is_numeric"], "numeric").otherwise("not numeric"),
        F.format_string("nulls about %.0f%%", t["null_pct"] * 100), F.format_string("unique ratio about %.2f", t["unique_ratio"]))
    return status.select("rule_name", F.concat(F.lit("When "), conditions, F.lit(", apply "), F.col("recommended_action")).alias("description"),
                         "support_count", "stage")
