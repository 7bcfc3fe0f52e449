"""The pipeline against plain Python, stage by stage on its own input."""

import public_tokenizers
import pytest

import corpus_pipeline
from colsmith.session import table
from tests.llm.test_methods import naive_groups


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    docs, out = table(spark, folder, "documents"), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, folder).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages_keep_columns_and_shrink(stages):
    names = list(stages)
    for before, after in zip(names, names[1:-2]):
        assert stages[after].columns == stages["start"].columns
        assert stages[after].exceptAll(stages[before]).count() == 0 and stages[after].count() < stages[before].count()
    assert stages["mix_sources"].columns == stages["start"].columns


def test_one_document_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages["quality_rules"].collect()}
    kept = {i for i, (_, _, own) in naive_groups(texts, 5).items() if own}
    assert {r["doc_id"] for r in stages["near_duplicates"].collect()} == kept


def test_tokens_of_the_mix(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = [(r["doc_id"], r["text"]) for r in stages["mix_sources"].collect()]
    expected = sorted((i, len(plain.encode(t, add_special_tokens=False).ids) + 1) for i, t in mixed)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in stages["token_output"].collect()) == expected


def test_run_gives_the_last_stage(spark, folder, stages):
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, folder).select(key).exceptAll(stages["token_output"].select(key)).count() == 0
