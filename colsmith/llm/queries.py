"""Named queries that apply each operator to its whole table, and their SQL texts where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.llm import contamination, conversations, language, mixing, neardup, negatives, pii, quality, secrets, sharding, sql, suffixes, tokens, urls
from colsmith.session import scratch_path, table

# Production parameters of the queries.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
REJECTED_HOST_WORDS = ("adult", "ads-", "bets", "casino", "pills", "spam")  # weak labels of the url model
PII_KEY = "corpus-key-1"
MIX_TEMPERATURE = 0.5
OLD_SHARDS, NEW_SHARDS = 32, 40
BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every text loses to strings of 100 bytes that also start earlier."""
    found = suffixes.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return contamination.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: one row per copy of a document."""
    mixed = mixing.mix(table(spark, folder, "documents"), temperature=MIX_TEMPERATURE)
    return mixed.select("doc_id", "copy", "source", "text")


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every url; the models learn from hosts with and without tell-tale words."""
    pages = table(spark, folder, "pages")
    host = urls.host(F.col("url"))
    bad = F.lit(False)
    for word in REJECTED_HOST_WORDS:
        bad = bad | host.contains(word)
    labelled = pages.where(host != "").select("url", (~bad).alias("accepted"))
    return urls.judge(pages, urls.fit(labelled, "url", "accepted"), URL_RULES, keep=["page_id"])


def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every text, and digests of their spans."""
    found = secrets.scan(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every text and the verdict of the cascade."""
    judged = quality.judge(table(spark, folder, "documents"), measures=quality.MEASURES)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *quality.MEASURES, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op7_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum in the token shards, from the written files."""
    path = scratch_path(spark, "token-shards")
    tokens.write(table(spark, folder, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return tokens.read(spark, path)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with pseudonyms and how many values of each kind were replaced."""
    found = pii.pseudonymise(table(spark, folder, "documents"), PII_KEY)
    return found.select("doc_id", "text", *[F.col("pii_counts")[k].alias(f"n_{k}") for k in pii.KINDS])


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every document by two-word shingles."""
    return neardup.groups(table(spark, folder, "documents"), words=2)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after a keyed damage of its turns."""
    turns = table(spark, folder, "conversations")

    def space(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(space("role"))
    damaged = turns.select("conv_id", "turn", "role", "text", harm.alias("harm")).select("conv_id", "turn", role.alias("role"), text.alias("text"), "harm")
    damaged = damaged.withColumn("again", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return conversations.summaries(damaged, dropped=F.col("harm") == 0)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of other labels just below each anchor's first rows of its own label."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in 32 shards by a hash of their id, moved to 40 shards of equal bytes and read back."""
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    old = sharding.store(table(spark, folder, "documents"), scratch_path(spark, "shards"), shard, shards=OLD_SHARDS)
    found = sharding.reshard(old, scratch_path(spark, "reshards"), NEW_SHARDS).read()
    text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    return found.select(F.col("row")["doc_id"].alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_mixing, op4_url_filters, op5_secret_scans, op6_quality_rules, op7_token_ids, op8_pii,
                                 op9_minhash_near_dedup, op10_language_id, op11_conversation_repair, op12_hard_negatives, op13_sharding)}
SQL: dict[str, str] = {
    "op2_decontamination": sql.contamination(),
    "op3_mixing": sql.mixing(MIX_TEMPERATURE, mixing.LARGEST_RATE),
    "op6_quality_rules": sql.quality(),
    "op12_hard_negatives": sql.hard_negatives(),
    "op9_minhash_near_dedup": sql.near_duplicates(2),
}
