"""Smooth tf-idf over a bounded vocabulary of the most frequent terms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of two or more word characters, in any script.
TOKEN = r"[\p{L}\p{M}\p{N}_]{2,}"

# English stop words left out of the vocabulary on request (fixed values).
ENGLISH_STOP_WORDS = (
    "a", "about", "above", "across", "after", "afterwards", "again", "against", "all", "almost", "alone", "along",
    "already", "also", "although", "always", "am", "among", "amongst", "amoungst", "amount", "an", "and", "another",
    "any", "anyhow", "anyone", "anything", "anyway", "anywhere", "are", "around", "as", "at", "back", "be", "became",
    "because", "become", "becomes", "becoming", "been", "before", "beforehand", "behind", "being", "below", "beside",
    "besides", "between", "beyond", "bill", "both", "bottom", "but", "by", "call", "can", "cannot", "cant", "co",
    "con", "could", "couldnt", "cry", "de", "describe", "detail", "do", "done", "down", "due", "during", "each",
    "eg", "eight", "either", "eleven", "else", "elsewhere", "empty", "enough", "etc", "even", "ever", "every",
    "everyone", "everything", "everywhere", "except", "few", "fifteen", "fifty", "fill", "find", "fire", "first",
    "five", "for", "former", "formerly", "forty", "found", "four", "from", "front", "full", "further", "get", "give",
    "go", "had", "has", "hasnt", "have", "he", "hence", "her", "here", "hereafter", "hereby", "herein", "hereupon",
    "hers", "herself", "him", "himself", "his", "how", "however", "hundred", "i", "ie", "if", "in", "inc", "indeed",
    "interest", "into", "is", "it", "its", "itself", "keep", "last", "latter", "latterly", "least", "less", "ltd",
    "made", "many", "may", "me", "meanwhile", "might", "mill", "mine", "more", "moreover", "most", "mostly", "move",
    "much", "must", "my", "myself", "name", "namely", "neither", "never", "nevertheless", "next", "nine", "no",
    "nobody", "none", "noone", "nor", "not", "nothing", "now", "nowhere", "of", "off", "often", "on", "once", "one",
    "only", "onto", "or", "other", "others", "otherwise", "our", "ours", "ourselves", "out", "over", "own", "part",
    "per", "perhaps", "please", "put", "rather", "re", "same", "see", "seem", "seemed", "seeming", "seems",
    "serious", "several", "she", "should", "show", "side", "since", "sincere", "six", "sixty", "so", "some",
    "somehow", "someone", "something", "sometime", "sometimes", "somewhere", "still", "such", "system", "take",
    "ten", "than", "that", "the", "their", "them", "themselves", "then", "thence", "there", "thereafter", "thereby",
    "therefore", "therein", "thereupon", "these", "they", "thick", "thin", "third", "this", "those", "though",
    "three", "through", "throughout", "thru", "thus", "to", "together", "too", "top", "toward", "towards", "twelve",
    "twenty", "two", "un", "under", "until", "up", "upon", "us", "very", "via", "was", "we", "well", "were", "what",
    "whatever", "when", "whence", "whenever", "where", "whereafter", "whereas", "whereby", "wherein", "whereupon",
    "wherever", "whether", "which", "while", "whither", "who", "whoever", "whole", "whom", "whose", "why", "will",
    "with", "within", "without", "would", "yet", "you", "your", "yours", "yourself", "yourselves",
)


def tokens(c: Column) -> Column:
    """Lower-cased word tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


@dataclass
class Vocabulary:
    """Terms in alphabetical order with their smooth inverse document frequency."""

    terms: list[str]
    idf: list[float]


def fit_vocabulary(df: DataFrame, column: str, max_features: int = 100,
                   stop_words: tuple[str, ...] = ()) -> Vocabulary:
    """Top terms by corpus count (ties alphabetical) and their document frequencies, from one pass over the texts.

    Each text yields its words once as they occur and once each, so one aggregation, summed on the map side, gives both
    counts of a term; only the vocabulary reaches the driver.
    """
    words = df.select(tokens(F.col(column)).alias("words"))
    # The empty term stands for the row itself, so that rows are counted in the same pass.
    both = words.select(F.posexplode(F.array("words", F.concat(F.array(F.lit("")), F.array_distinct("words")))).alias("once", "terms"))
    terms = both.select("once", F.explode("terms").alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(*stop_words))
    counted = terms.groupBy("term").agg(F.count_if(F.col("once") == 0).alias("uses"), F.count_if(F.col("once") == 1).alias("rows"))
    found = counted.orderBy(F.col("term") != "", F.desc("uses"), "term").limit(max_features + 1).collect()
    rows = {r["term"]: r["rows"] for r in found}
    total = rows.pop("", 0)
    names = sorted(rows)
    return Vocabulary(names, [math.log((1 + total) / (1 + rows[t])) + 1 for t in names])


def with_tfidf(df: DataFrame, column: str, vocabulary: Vocabulary, out: str) -> DataFrame:
    """Adds L2-normalised weights in vocabulary order, per row and without a shuffle.

    The tokens are those the vocabulary was fitted on, counted by a hash lookup; a row without any known term is all zeros.
    """
    model = CountVectorizerModel.from_vocabulary(vocabulary.terms, inputCol="__tokens", outputCol="__counts")
    counted = model.transform(df.withColumn("__tokens", tokens(F.col(column))))
    raw = counted.withColumn("__raw", F.zip_with(vector_to_array("__counts"), F.lit(vocabulary.idf), lambda n, w: n * w))
    norm = raw.withColumn("__norm", F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda t, x: t + x * x)))
    weights = F.transform("__raw", lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(F.lit(0.0)))
    return norm.withColumn(out, weights).drop("__tokens", "__counts", "__raw", "__norm")


def tfidf_weights(df: DataFrame, key: str, column: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, term, weight) of the terms that occur; one row per document and known term.

    Tokens outside the vocabulary are removed before the shuffle and the rest are summed
    on the map side, so at most ``len(vocabulary.terms)`` rows per document move.
    """
    spark = df.sparkSession
    lookup = F.broadcast(spark.createDataFrame(list(zip(vocabulary.terms, vocabulary.idf)), "term string, idf double"))
    found = df.select(key, F.explode(tokens(F.col(column))).alias("term")).join(lookup, "term")
    cells = found.groupBy(key, "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("raw"))
    norms = cells.groupBy(key).agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        F.collect_list(F.struct("term", "raw")).alias("cells"),
    )
    return norms.select(key, "norm", F.explode("cells").alias("cell")).select(
        key, F.col("cell.term").alias("term"), (F.col("cell.raw") / F.col("norm")).alias("weight")
    )


def tfidf_mean(df: DataFrame, key: str, column: str, vocabulary: Vocabulary, out: str) -> DataFrame:
    """Every row of ``df`` with the mean weight over the vocabulary (0 when no term occurs)."""
    size = max(1, len(vocabulary.terms))
    means = tfidf_weights(df, key, column, vocabulary).groupBy(key).agg((F.sum("weight") / size).alias("__mean"))
    return df.join(means, key, "left").withColumn(out, F.coalesce(F.col("__mean"), F.lit(0.0))).drop("__mean")
