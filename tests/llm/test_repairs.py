"""Long and unusual texts, and plain versions of operators that SQL cannot express."""

import hashlib
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colsmith.llm import language, mixing, pii, queries, secrets, sql, tokens, urls
from colsmith.llm import words as W
from colsmith.session import table

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_distinct_values_that_agree_in_upper_bits():
    values, rows = np.array([5, 6, 5, 1 << 20, 5, 6, 5], np.uint64), np.array([0, 0, 0, 0, 1, 1, 1])
    found, of = W.distinct(values, rows)
    assert sorted(zip(of.tolist(), found.tolist())) == [(0, 5), (0, 6), (0, 1 << 20), (1, 5), (1, 6)]


LONG = {
    "labels": "a@" + "b." * 500_000, "named": "see joe@" + "mail." * 200_000 + "org", "one label": "a@" + "b" * 1_000_000, "local": "a" * 1_000_000, "ats": "a@" * 500_000, "dots": "." * 1_000_000,
    "digits": "1" * 1_000_000, "octets": "1." * 500_000, "dashes": "12-" * 300_000, "slashes": "12/12/" * 160_000, "plus": "+1 " * 300_000, "groups": "+49 30 " + "12 " * 300_000, "cards": "4111 " * 200_000,
}


def test_pseudonyms_of_very_long_texts(spark):
    docs = spark.createDataFrame([(k, t + " joe@mail.org") for k, t in LONG.items()], "doc_id string, text string")
    found = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    for k, t in LONG.items():
        assert len(found[k]["text"]) == len(t) + 13 and not found[k]["text"].endswith(" joe@mail.org"), k
        assert found[k]["pii_counts"]["email"] >= 1, k


def test_mixing_sql_draws_large_rates_in_parts(spark, folder, monkeypatch):
    monkeypatch.setattr(mixing, "LARGEST_RATE", 0.4)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = sorted(con.execute(sql.mixing(queries.MIX_TEMPERATURE, 0.4)).fetchall(), key=repr)
    found = mixing.mix(table(spark, folder, "documents"), temperature=queries.MIX_TEMPERATURE).select("doc_id", "copy", "source", "text").collect()
    assert sorted(map(tuple, found), key=repr) == expected


def naive_spans(text):
    found = []
    for kind, pattern, group, least in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
                                         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda f: (f[0], order.index(f[1])))


def test_secrets_of_the_whole_table(spark, folder):
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_secret_scans"](spark, folder).collect()}
    docs = table(spark, folder, "documents").collect()
    assert len(found) == len(docs)
    for r in docs:
        base, row = naive_spans(r["text"] or ""), found[r["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == k for x in base) for k in ("assign", "access", "hex")]
        assert [s for s in row["spans"].split(",") if s and not s.startswith("token")] == [s for s in joined.split(",") if s]


def test_many_spans_in_one_text():
    encoding = secrets._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = np.random.default_rng(1)
    text = " ".join(f"key{i}: {bytes(draw.integers(0, 256, 16, np.uint8)).hex()} K7gNU3sdo9OL0wNhqoVWhr3g{i:06d}" for i in range(10_000))
    start = time.perf_counter()
    found = secrets.spans(text, encoding)
    assert time.perf_counter() - start < 10 and sum(k == "hex" for *_, k in found) == 10_000 and sum(k == "token" for *_, k in found) >= 9_000


def naive_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.match(r"(?s)[^?#]*", tail)[0]
    fits = [(rule, verdict) for verdict, rule in rules
            if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_urls_of_the_whole_table(spark, folder):
    found = {r["page_id"]: r for r in queries.QUERIES["op4_url_filters"](spark, folder).collect()}
    pages = table(spark, folder, "pages").collect()
    assert len(found) == len(pages)
    for r in pages:
        host, path, rule, verdict = naive_verdict(r["url"], queries.URL_RULES)
        row = found[r["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule) and row["verdict"] in ((verdict,) if verdict else ("allow", "block"))


def test_all_of_a_url_is_scored(spark):
    rows = [(f"http://h{i % 50}.org/p?{w}={i}", w == "garden") for w in ("garden", "casino") for i in range(300)]
    model = urls.fit(spark.createDataFrame(rows, "url string, ok boolean"), "url", "ok")
    new = spark.createDataFrame([("http://x.org/p?casino=1",), ("http://x.org/p?garden=1",), ("http://x.org/p#casino",), ("casino casino",), ("garden garden",)], "url string")
    found = urls.judge(new, model, ()).collect()
    assert [r["verdict"] for r in found] == ["block", "allow", "block", "block", "allow"] and len({r["score"] for r in found}) == 5


def test_languages_of_unlisted_scripts(spark):
    texts = {"gu": "આ એક નાની વાર્તા છે જે ગામમાં રહેતા લોકો વિશે છે", "am": "ይህ ስለ አንድ ትንሽ መንደር የሚናገር አጭር ታሪክ ነው", "en": "this is a short story about people of a village", "got": "𐌰𐍄𐍄𐌰 𐌿𐌽𐍃𐌰𐍂 𐌸𐌿 𐌹𐌽"}
    docs = spark.createDataFrame([(i, t * 5, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language.fit(docs)
    new = [(1, "ગામમાં નાની વાર્તા"), (2, "አጭር ታሪክ መንደር"), (3, "people of a story"), (4, "𐌸𐌿 𐌹𐌽"), (5, "12 34")]
    alone = {}
    for row in new:
        r = language.predict(spark.createDataFrame([row], "doc_id long, text string"), model).first()
        alone[row[0]] = (r["lang_pred"], r["score"])
    together = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(new, "doc_id long, text string").coalesce(1), model).collect()}
    assert together == alone and [alone[i][0] for i in range(1, 6)] == ["gu", "am", "en", "got", "und"] and alone[1][1] == 1.0


def naive_language(text, model):
    """Words, trigram sums and the best path with switches, one text at a time."""
    found = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    scores, lengths, scripted = [], [], []
    for _, word in found:
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        padded = b" " + low + b" "
        cells = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(low))]
        script = max(int(language._SCRIPT[low[i] << 8 | padded[i + 2]]) for i in range(len(low)))
        own = np.array([sum(float(model.table[j][c]) for c in cells) for j in range(len(model.languages))]) if script else np.zeros(len(model.languages))
        scores.append(own + np.where(model.allowed[script], 0, -1e4))
        lengths.append(len(word))
        scripted.append(script > 0)
    best, back = scores[0], []
    for s in scores[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - language.SWITCH
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - language.SWITCH) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    weight = np.zeros(len(model.languages))
    for j, n, heard in zip(path, lengths, scripted):
        weight[j] += n * (heard or not any(scripted))
    return model.languages[int(weight.argmax())], weight.max() / weight.sum()


def test_languages_of_the_whole_table(spark, folder):
    docs = table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.where(~held))
    found = {r["doc_id"]: r for r in queries.QUERIES["op10_language_id"](spark, folder).collect()}
    agree = total = 0
    for r in docs.collect():
        text, row = r["text"] or "", found[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert row["lang_pred"] == "und" and row["score"] == 0
            continue
        name, share = naive_language(text, model)
        total += 1
        agree += row["lang_pred"] == name and abs(row["score"] - share) < 1e-6
    assert agree >= 0.99 * total  # sums of floats may tie differently


@pytest.mark.parametrize("special_strings", [False, True])
def test_special_strings_in_texts(spark, tmp_path, special_strings):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = special_strings
    texts = ["<|endoftext|> x", "a<|endoftext|>b c <|endoftext|>", "x <|endoftext|>.\n<|endoftext|>y", "plain text"]
    tokens.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "t"), BPE, special_strings=special_strings)
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.read(spark, str(tmp_path / "t")).collect()}
    assert found == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert tokens.encoder_of(BPE) is tokens.encoder_of(BPE)
