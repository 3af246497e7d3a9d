"""Waivers, acceptances, coverage and the verdict of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Precedence of outcomes, coverages and verdicts, and the verdicts' exit codes.
OUTCOME_RANK = {"ERROR": 5, "FAIL": 4, "INCONCLUSIVE": 3, "PASS": 2, "NOT_APPLICABLE": 1}
COVERAGE_RANK = {"UNKNOWN": 3, "PARTIAL": 2, "COMPLETE": 1}
EXIT_CODE = {"PASS": 0, "FAIL": 1, "INCONCLUSIVE": 2, "ERROR": 3, "REVIEW": 4}


def rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, r in ranks.items():
        out = F.when(value == name, r).otherwise(out)
    return out


def is_active(as_of: Column, created: Column, expires: Column) -> Column:
    return as_of.between(created, expires)


def first_match(rows: DataFrame, records: DataFrame, on: list[str], row_key: list[str], order: str, residual: Column | None = None) -> DataFrame:
    """rows with the first record, by its order, that matches; null records if none does.

    Records are few and sent to all tasks by the planner where their size allows.
    """
    r = records.withColumnsRenamed({c: f"rec_{c}" for c in records.columns})
    cond = [F.col(c) == F.col(f"rec_{c}") for c in on] + ([residual] if residual is not None else [])
    joined = rows.join(r, cond, "left")
    best = F.row_number().over(Window.partitionBy(*row_key).orderBy(F.col(f"rec_{order}").asc_nulls_last()))
    return joined.withColumn("_place", best).where("_place = 1").drop("_place")


def effective_coverage(declared: Column, scope: Column, candidates: Column, open_gap: Column, any_gap: Column, subs: Column) -> Column:
    """Coverage after gaps and acceptances."""
    return (
        F.when(~scope, "UNKNOWN")
        .when(~candidates | open_gap | ~subs, F.when(declared == "UNKNOWN", "UNKNOWN").otherwise("PARTIAL"))
        .when(any_gap, "COMPLETE")
        .otherwise(declared)
    )


def verdict(fault: Column, finding: Column, incomplete: Column, review: Column) -> Column:
    return F.when(fault, "ERROR").when(finding, "FAIL").when(incomplete, "INCONCLUSIVE").when(review, "REVIEW").otherwise("PASS")


def exit_code(status: Column) -> Column:
    return rank(status, EXIT_CODE)


def code_set(code: Column) -> Column:
    """The distinct codes of a group, in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(code)), ",")


def dedup_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")
