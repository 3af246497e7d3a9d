import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import canonical, names, stats, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("glob", "kind", "yes", "no"),
    [
        ("src/**", "path", ["src/a", "src/a/b.py"], ["src", "xsrc/a"]),
        ("*.py", "path", ["a.py"], ["d/a.py", "a.pyc"]),
        ("a?c", "path", ["abc"], ["a/c", "ac"]),
        ("m:*", "symbol", ["m:f"], ["m:C.f", "n:f"]),
        ("m:**", "symbol", ["m:C.f"], ["n:f"]),
        ("a+b(c)", "path", ["a+b(c)"], ["aab(c)"]),
    ],
)
def test_globs(spark, glob, kind, yes, no):
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    got = {r.v for r in df.where(names.matches_any(F.col("v"), [glob], kind)).collect()}
    assert got == set(yes)


def test_glob_checks():
    assert names.validate_glob("a/**/b?.py") and not any(map(names.validate_glob, ["", "!a", "/a", "a/", "a//b", "a/../b", "[a]", "a\\b"]))
    assert names.globs_are_universal(["**"]) and names.globs_are_universal(["*", "*/**"])
    assert not names.globs_are_universal(["*"]) and not names.globs_are_universal(["a**", "b**"]) and not names.globs_are_universal([])


def test_paths(spark):
    assert one(spark, names.normalize_path(F.col("p")), p=" .\\.//a//b ") == "a/b"
    for p, safe in (("a/b.py", True), ("/a", False), ("a//b", False), ("C:/a", False), ("a/..", False), ("a.", False), ("a /b", False), ("~", False)):
        assert one(spark, names.is_safe_path(F.col("p")), p=p) == safe, p
    assert one(spark, names.simple_name(F.col("p")), p="m/n:C.f") == "f"
    for p, lang in (("a.py", "python"), ("a.TSX", "tsx"), ("LICENSE", "text"), ("d/LICENSE", "unsupported"), ("a.go", "unsupported"), ("a.mjs", "javascript")):
        assert one(spark, names.language_of(F.col("p")), p=p) == lang


def test_text(spark):
    assert one(spark, text.redact(F.col("v")), v="12345678") == "***" and one(spark, text.redact(F.col("v")), v="123456789") == "1234…89 (len=9)"
    for v in ("", "aaaa", "abcd", "aabbé😀x"):
        want = -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) if v else 0
        assert abs(one(spark, text.entropy(F.col("v")), v=v) - want) < 1e-12
    for v in ("a\nb\n", "a\r\nb\rc", "", "x\x0b\x0cy\x1cz\x85 ", "\n\n"):
        assert one(spark, text.lines_of(F.col("v")), v=v) == v.splitlines(), repr(v)
    assert one(spark, text.git_blob_id(F.encode(F.col("v"), "utf-8")), v="hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, text.assignment_name(F.col("v")), v="  const key = 'x'") == "key" and one(spark, text.assignment_name(F.col("v")), v="no sign") is None


def test_canonical_numbers_and_order():
    for value, want in ((0.0, "0"), (-0.0, "0"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (333333333.33333329, "333333333.3333333"), (4.5, "4.5"), (2e-3, "0.002"), (1e300, "1e+300"), (5e-324, "5e-324"), (100.0, "100")):
        assert canonical.canonical(value) == want
    assert canonical.canonical({"\ufb33": 1, "\U0001f600": 2, "1": 3, "\r": 4, "é": [True, None, "€\"\\\n"]}) == '{"\\r":4,"1":3,"é":[true,null,"€\\"\\\\\\n"],"\U0001f600":2,"\ufb33":1}'
    for bad in (float("nan"), float("inf"), 2**53, {1: 2}, "\ud800"):
        with pytest.raises((ValueError, TypeError)):
            canonical.canonical(bad)


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_canonical_numbers_round_trip(x):
    assert float(canonical.canonical(x)) == x


def test_fingerprints_do_not_move_with_lines():
    a = canonical.fingerprint("c", "D", 1, "./a//b", "s", {"line": 3, "x": [{"span": 1, "y": 2}]})
    assert a == canonical.fingerprint("c", "D", 1, "a/b", "s", {"line": 9, "x": [{"span": 7, "y": 2}]})
    assert a != canonical.fingerprint("c", "D", 1, "a/b", "s", {"x": [{"y": 3}]})


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 101)] + [("b", 5.0), ("b", 7.0)], "g string, v double")
    by = {r.g: r for r in stats.summary(df, ["g"], "v").collect()}
    assert (by["a"].median, by["a"].p95, by["a"].p99, by["a"].valid) == (50.0, 95.0, 99.0, True)
    ci = {r.g: r for r in stats.mean_ci95(df, ["g"], "v").collect()}
    assert ci["b"].low == 0.0 and abs(ci["b"].high - (6 + 12.706 * math.sqrt(2) / math.sqrt(2))) < 1e-5
    low, high = map(float, df.groupBy("g").agg(stats.bootstrap_ci(0.5, 200)("v").alias("x")).where("g = 'a'").first().x.split(","))
    assert 30 < low <= 50 <= high < 70


def test_bootstrap_of_groups_in_many_tasks_equals_resamples_drawn_one_by_one(spark, monkeypatch):
    import random

    from palisade.plans import catalogue

    def drawn(own, q, resamples, seed):
        rng, found = random.Random(seed), []
        for _ in range(resamples):
            found.append(sorted(rng.choices(own, k=len(own)))[max(0, math.ceil(q * len(own)) - 1)])
        found.sort()
        return found[int(0.025 * resamples)], found[int(0.975 * resamples) - 1]

    monkeypatch.setattr(stats, "DRAWS", 256)
    monkeypatch.setattr(stats, "FEW", 100)
    for n in (1, 2, 99, 256, 257, 1000):
        for q in (0.0, 0.01, 0.5, 0.95, 1.0):
            assert stats.bootstrap_ranks(n, q, 40, 2**40 + 3) == drawn(range(n), q, 40, 2**40 + 3)
    nan = float("nan")
    groups = {"a": [float(x * x % 811) for x in range(3000)], None: [1.5, None, nan, -2.0], "c": [7.25] * 40 + [0.0, -1e9], "d": [None], "e": [float("inf"), 1e300]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: r.interval for r in stats.bootstrap(df, ["g"], "v", 0.5, 60).collect()}
    greatest = lambda v: (v is None or math.isnan(v), 0 if v is None else v)
    for g, vs in groups.items():
        own = sorted(vs, key=greatest)
        low, high = drawn(range(len(own)), 0.5, 60, 42)
        assert got[g] == ",".join(f"{nan if own[i] is None else own[i]:.6g}" for i in (low, high)), g
    assert len(got) == len(groups) and stats.bootstrap(df.limit(0), ["g"], "v", 0.5).collect() == []
    # No worker is given a whole group's values.
    plan = catalogue.QUERIES["q53_bootstrap_ci"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PythonUDAF" not in plan and "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan


def test_entropy_grows_with_the_length_whatever_the_number_of_characters(spark):
    import time

    assert sorted(text.OFTEN) == [chr(i) for i in range(128)]
    many = "".join(chr(i) for i in range(0x3400, 0x3400 + 20000))
    cases = {"": 0.0, "\x00a\x00a": 1.0, many + many: math.log2(20000), "aé漢😀" * 3: 2.0, " \n": 1.0, "zzzz": 0.0, "e\u0301e": -sum(p * math.log2(p) for p in (2 / 3, 1 / 3))}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)] + [(99, None)], "i int, v string")
    began = time.monotonic()
    got = {r.i: r.x for r in df.select("i", text.entropy(F.col("v")).alias("x")).collect()}
    assert time.monotonic() - began < 20
    assert got.pop(99) is None
    for (v, want), x in zip(cases.items(), (got[i] for i in range(len(cases))), strict=True):
        assert abs(x - want) < 1e-9, v[:10]
