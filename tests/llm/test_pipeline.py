import pytest

import corpus_pipeline
from palisade.llm.common import materialize
from tests.llm.helpers import ODD, docs, edited, prose

ITEM = prose(77, 40, 900)
SECRET = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture()
def sf_dir(spark, tmp_path):
    base = prose(1, 150, 900)
    clean = [(k, prose(k, 60, 900), "en", f"src{k % 5}") for k in range(20, 40)]
    rows = [(1, base), (2, base), (3, edited(base, 1, 1)), (4, prose(5, 50, 900) + " " + ITEM), (5, prose(6, 50, 900) + f' token = "{SECRET}"'), (6, "too short"), (7, "again and again it goes on " * 9)]
    docs(spark, [*rows, *clean, *[(i, t, *r) for i, t, *r in ODD if i != 1]]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = d.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        d = materialize(stage(spark, d, sf_dir), name)
        kept[name] = {r.doc_id for r in d.collect()}
        if name != "tokens":
            assert d.columns == columns
    clean = set(range(20, 40))
    assert kept["quality"] == {1, 2, 3, 4, 5} | clean
    assert kept["near_duplicates"] == {1, 4, 5} | clean
    assert kept["decontaminate"] == kept["secrets"] == kept["tokens"] == {1, 5} | clean
    said = {r.doc_id: r.decoded for r in d.collect()}
    assert SECRET not in said[5] and "[secret]" in said[5]


def test_run_equals_stages(spark, sf_dir):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {1, 5} | set(range(20, 40))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "tokens"]


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
