"""Every operator on odd and on empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colsmith.llm import contamination, graph, language, mixing, neardup, pii, quality, secrets, suffixes, tokens, urls
from tests.llm.conftest import LONG

EMPTY = hashlib.sha256(b"").hexdigest()
RANKS, BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffixes(odd, nothing):
    found = suffixes.remove_repeats(odd).collect()
    assert len(found) == odd.count() and suffixes.remove_repeats(nothing).count() == 0
    rows = {r["doc_id"]: r for r in found}
    assert rows[1]["n_bytes"] == rows[2]["n_bytes"] == 0 and rows[5]["n_removed"] == 0
    assert rows[4]["n_removed"] == len(LONG) - 5 and rows[4]["n_spans"] == 1  # only the strings at 0 to 4 are first
    assert rows[6]["n_removed"] == 0 and rows[7]["n_removed"] == rows[7]["n_bytes"] and rows[7]["kept"] == b""


def test_contamination(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "The same text twice in this small table of rows"), (2, "one two"), (3, None), (4, ""), (5, None)], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in contamination.contained(odd, bench).collect())
    assert found == [(6, 1), (7, 1), (9, 2)]
    assert contamination.contained(nothing, bench).count() == 0 and contamination.contained(odd, bench.limit(0)).count() == 0
    kept = contamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert contamination.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


def test_mixing(odd, nothing):
    mixed = mixing.mix(odd, {"a": 1.0, "b": 1.0})
    assert mixed.columns == [c for c in odd.columns if c != "copy"] + ["copy", "mix_order"]
    assert {r[0] for r in mixed.select("source").distinct().collect()} <= {"a", "b", None}
    assert mixing.mix(nothing).count() == 0
    assert set(mixing.mix(odd).where("source is null").select("text").distinct().toPandas()["text"]) <= {None, "one"}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no host"), (4, "http://A.Example.NET/en/x?q"), (5, "http://x.net"), (6, "http://x.net/"), (7, "ftp://example.com/de/#"), (8, "HTTP://b.org/fr/" + "y" * 90_000), (8, "http://notorg/fr/")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    model = urls.fit(pages.limit(0).withColumn("ok", F.lit(True)), "url", "ok")
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    found = [tuple(r)[:-1] for r in urls.judge(pages, model, rules, keep=["page_id"]).collect()]
    assert found[:7] == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"),
                         (5, "x.net", "", None, "allow"), (6, "x.net", "/", "net/", "block"), (7, "example.com", "/de/", "example.com/de/", "block")]
    assert found[7][3:] == ("org/fr/", "allow") and found[8][3] is None
    assert urls.judge(pages.limit(0), model, rules).count() == 0


def test_secrets(odd, nothing):
    found = secrets.scan(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == odd.count() and all(r["spans"] == [] for r in found)
    assert secrets.scan(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_quality(odd, nothing):
    found = by_id(quality.judge(odd, measures=quality.MEASURES))
    assert found[1]["n_words"] == found[3]["n_words"] == 0 and found[1]["rejected_by"] is not None
    assert found[4]["n_words"] == found[4]["n_repeat_words"] == 60_000 and found[6]["rejected_by"] is None
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {6, 7}
    assert quality.keep_good(nothing).count() == 0 and quality.judge(nothing).count() == 0


def test_tokens(spark, odd, nothing, tmp_path):
    tokens.write(odd, str(tmp_path / "a"), BPE)
    found = tokens.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert len(found) == odd.count() and [r["doc_id"] for r in found][:2] == [None, None]
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:i]) for i in range(len(found))]
    assert min(r["n_tokens"] for r in found) == 1
    tokens.write(nothing, str(tmp_path / "b"), BPE)
    assert tokens.read(spark, str(tmp_path / "b")).count() == 0


def test_pii(odd, nothing):
    found = pii.pseudonymise(odd, "k")
    assert set(found.columns) == set(odd.columns)
    assert sorted(map(str, (r["text"] for r in found.collect()))) == sorted(map(str, (r["text"] for r in odd.collect())))
    assert pii.pseudonymise(nothing, "k").count() == 0


def test_neardup(odd, nothing):
    found = neardup.groups(odd).collect()
    assert len(found) == odd.count() and neardup.groups(nothing).count() == 0
    rows = {r["doc_id"]: r for r in found}
    assert rows[7]["component_id"] == 6 and not rows[7]["kept"] and rows[6]["kept"] and rows[1]["component_id"] == 1 and rows[3]["n_shingles"] == 0
    assert rows[4]["n_shingles"] == 1 and rows[None]["component_id"] is None and rows[5]["kept"]
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_language(odd, nothing):
    model = language.fit(odd)
    found = by_id(language.predict(odd, model))
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[1]["score"] == 0
    assert found[4]["lang_pred"] == "en" and found[8]["lang_pred"] in ("en", "fr")
    empty = language.fit(nothing)
    assert by_id(language.predict(odd, empty))[4]["lang_pred"] == "und" and language.predict(nothing, model).count() == 0


@pytest.mark.parametrize("n", [0, 1, 33])
def test_components(spark, n):
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(50, 50)] * (n > 0), "a long, b long")
    found = {r["id"]: r["component"] for r in graph.components(chain).collect()}
    assert found == ({**dict.fromkeys(range(n + 1), 0), 50: 50} if n else {})
