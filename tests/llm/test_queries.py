"""The registered queries: the contract's columns, and SQL where it is given."""

from collections import Counter

import duckdb
import pytest

from palisade.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
FIRST = {
    "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5_near_duplicates": ["doc_id", "class_id"],
    "op6_html_extract": ["page_id", "url", "text", "n_chars"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_decontaminate": ["doc_id", "item_id"],
    "op9_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op10_token_counts": ["doc_id", "n_tokens"],
}


def test_all_ten_are_registered():
    assert set(QUERIES) == set(FIRST)


def compare(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    assert df.columns[: len(FIRST[name])] == FIRST[name]
    columns = sorted(df.columns)
    done = con.execute(ORACLE_SQL[name])
    found = [d[0] for d in done.description]
    theirs = Counter(tuple(dict(zip(found, r, strict=True))[c] for c in columns) for r in done.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, name, SF)


def test_linked_pages_equal_sql(spark, tmp_path):
    from tests.llm.test_urls import URLS

    link = lambda to: f'<link rel="canonical" href="{to}">'
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(50, "http://x.info/a", link("http://a.example.com/en/1")), (51, "http://y.info/", link("//x.info/a/")), (52, "http://z.info/q", link("/r?b=1&utm_x=2")), (53, "http://m.z.info/r?b=1", '<meta http-equiv=refresh content="1;url=http://org/es/">')]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{tmp_path}/p/*.parquet")[0], f"{tmp_path}/pages.parquet")
    for t in ("documents", "conversations"):
        shutil.copy(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    compare(spark, "op9_url_filters", str(tmp_path))


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_bpe", "op6_html_extract", "op10_token_counts", "op8_decontaminate"])
def test_columns(spark, name):
    assert QUERIES[name](spark, SF).columns[: len(FIRST[name])] == FIRST[name]
