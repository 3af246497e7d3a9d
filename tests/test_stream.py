from palisade.sources.git_tree import FILES
from palisade.sources.policies import parse_policy, policy_tables
from palisade.streaming.changes import gate_stream


def test_batches_are_gated_once(spark, tmp_path):
    source, got = str(tmp_path / "in"), []
    rows = [("r1", "base", "a.txt", "100644", "1", b"x"), ("r1", "head", "a.txt", "100644", "2", b"y")]
    spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], FILES).coalesce(1).write.parquet(source)
    rules, records = policy_tables(spark, {"r1": parse_policy(b'[deny.R]\npaths = ["a.txt"]\n')})
    keep = lambda tables, n: got.extend((n, r.run_id, r.status) for r in tables["verdicts"].collect())
    for _ in range(2):
        gate_stream(spark, source, str(tmp_path / "ck"), rules, records, "2026-01-01", keep).awaitTermination(120)
    assert got == [(0, "r1", "FAIL")]
