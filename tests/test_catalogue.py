"""Every query of the catalogue with SQL, against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from palisade.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = Counter(tuple(repr(r[c]) for c in columns) for r in df.collect())
    done = con.execute(catalogue.ORACLE_SQL[name])
    found = [d[0] for d in done.description]
    theirs = Counter(tuple(repr(dict(zip(found, r, strict=True))[c]) for c in columns) for r in done.fetchall())
    assert sorted(found) == columns and mine == theirs


def test_results_do_not_depend_on_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("q07_hunk_innermost_entity", "q34_waiver_join_active", "q41_finding_dedup_first"):
        seen = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(Counter(map(tuple, catalogue.QUERIES[name](spark, SF).collect())))
        assert seen[0] == seen[1]
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_bootstrap_takes_the_references_resamples(spark):
    from palisade.functions import stats

    events = spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type")
    whole = {r.event_type: r.x for r in events.agg(stats.bootstrap_ci(0.5, 1000)("value").alias("x")).collect()}
    assert {r.event_type: r.interval for r in catalogue.QUERIES["q53_bootstrap_ci"](spark, SF).collect()} == whole


def test_hunks_are_dealt_out_by_the_size_of_their_table(spark, con, monkeypatch):
    from palisade.operators import hunks

    plan = lambda: catalogue.QUERIES["q08_hunk_nesting_conflict"](spark, SF)._jdf.queryExecution().toString()
    # No task holds a map of hunks; a small table is left to Spark.
    assert "HashAggregate" not in plan() and "REPARTITION_BY_NUM" not in plan()
    monkeypatch.setattr(hunks, "PIECE", 4 << 10)
    n = hunks.pieces(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert n > 4 and f", {n}), REPARTITION_BY_NUM" in plan()
    for name in ("q06_hunk_entity_overlap", "q07_hunk_innermost_entity", "q08_hunk_nesting_conflict", "q09_hunk_classification_case"):
        test_query_equals_sql(spark, con, name)
