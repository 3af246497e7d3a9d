"""The gate: five checks, waivers, acceptances, one verdict for each run, and its evidence."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.canonical import canonical, finding_fingerprint, payload_hash
from palisade.functions.text import uri_path
from palisade.operators import gate as algebra
from palisade.operators import review
from palisade.operators.tables import settle
from palisade.plans import checks

# Gaps that may be accepted, and gaps that leave a check's scope unknown.
ACCEPTABLE = ("mapping_unresolved", "dynamic_target_unresolved", "dynamic_call", "unknown_decorator", "unresolved_import", "unknown_call_on_path", "frontend_capability_missing", "unsupported_language", "unsupported_syntax_version", "lfs_content_unavailable")
# What a check may look at, entities of changed files on both sides and calls.
MOST_ENTITIES, MOST_CALLS = 20_000, 10_000
SCOPE_GAPS = ("unsupported_language", "parse_error", "parse_resource_limit")


def over_budget(change: checks.Change, entities: int = MOST_ENTITIES, calls: int = MOST_CALLS) -> DataFrame:
    """(run_id, check_id, used): checks that would have to look at more than they may."""

    def side(name: str) -> DataFrame:
        paths = change.entries.where("not is_binary").select("run_id", F.col(f"{name}_path").alias("path"))
        return change.entities(name).join(paths, ["run_id", "path"], "left_semi")

    seen = review.enumerated(side("base"), side("head"), ["run_id"], "qname").where(F.col("enumerated") > entities)
    own = seen.select("run_id", F.explode(F.array(*[F.lit(c) for c in checks.CHECKS if c != "security"])).alias("check_id"), F.col("enumerated").alias("used"))
    asked = change.calls().join(change.entries.select("run_id", F.col("head_path").alias("path")), ["run_id", "path"], "left_semi")
    asked = asked.groupBy("run_id").agg(F.count(F.lit(1)).alias("used")).where(F.col("used") > calls)
    return own.union(asked.select("run_id", F.lit("contract"), "used")).groupBy("run_id", "check_id").agg(F.max("used").alias("used"))


def without_exhausted(findings: DataFrame, gaps: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """findings and gaps where a check over its budget has the one gap that says so, whatever it found."""
    null = F.lit(None).cast("string")
    keys = ["run_id", "check_id"]
    told = checks.gap(over, F.col("check_id"), "budget_exhausted", null, null, F.col("used"))
    return findings.join(over, keys, "left_anti").select(findings.columns), gaps.join(over, keys, "left_anti").select(gaps.columns).union(told)


def run_checks(change: checks.Change) -> tuple[DataFrame, DataFrame]:
    """(findings, gaps) of all checks, findings with their fingerprint, the first of each."""
    both = [tuple(settle(t) for t in getattr(checks, name)(change)) for name in checks.CHECKS]
    findings = functools.reduce(DataFrame.union, [f for f, _ in both])
    gaps = functools.reduce(DataFrame.union, [g for _, g in both]).distinct()
    findings = findings.withColumn("fingerprint", finding_fingerprint("check_id", "defect_id", "path", "symbol", "identity"))
    return algebra.dedup_first(findings, ["run_id", "fingerprint"], ["check_id", F.col("line").asc_nulls_last()]), gaps


def apply_waivers(findings: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """findings with disposition, and whether an inactive waiver asks for a review."""
    w = records.where("kind = 'waivers'").select("run_id", "record_no", "record_id", F.col("check_id").alias("check_name"), "defect_id", "fingerprint", "created", "expires")
    same = F.col("rec_check_name") == F.col("check_id")  # a waiver without a check matches nothing
    j = algebra.first_match(findings, w, ["run_id", "defect_id", "fingerprint"], ["run_id", "fingerprint"], "record_no", same)
    active = algebra.is_active(F.lit(as_of), F.col("rec_created"), F.col("rec_expires"))
    return j.select(*findings.columns, F.when(active, "WAIVED").otherwise("OPEN").alias("disposition"), F.col("rec_record_id").alias("waiver_id"), (F.col("rec_record_id").isNotNull() & ~active).alias("stale_waiver"))


def apply_acceptances(gaps: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """gaps with accepted, and whether an inactive acceptance asks for a review."""
    a = records.where("kind = 'acceptances'").select("run_id", "record_no", "record_id", "check_id", "reason_code", "paths", "symbols", "created", "expires", F.transform("paths", _glob_sql).alias("regexes"))
    fits = F.expr("exists(rec_regexes, g -> path rlike g) or array_contains(rec_symbols, symbol)")
    keys = ["run_id", "check_id", "reason_code", "path", "symbol", "detail"]
    j = algebra.first_match(gaps, a, ["run_id", "check_id", "reason_code"], keys, "record_no", F.coalesce(fits, F.lit(False)) & F.col("reason_code").isin(*ACCEPTABLE))
    active = F.coalesce(algebra.is_active(F.lit(as_of), F.col("rec_created"), F.col("rec_expires")), F.lit(False))
    return j.select(*gaps.columns, active.alias("accepted"), (F.col("rec_record_id").isNotNull() & ~active).alias("stale_acceptance"))


def _glob_sql(glob):
    """A path glob as a regular expression, by column functions."""
    quoted = F.regexp_replace(glob, r"([.+()^$|{}])", r"\\$1")
    out = F.replace(quoted, F.lit("**"), F.lit("\x01"))
    out = F.replace(F.replace(out, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(out, F.lit("\x01"), F.lit(".*")), F.lit("$"))


def results(runs: DataFrame, findings: DataFrame, gaps: DataFrame, relevant: DataFrame) -> DataFrame:
    """(run_id, check_id, outcome, coverage, open_findings, open_gaps, reason_codes, reviews) of each run and check.

    relevant: (run_id, check_id) where a check had something to look at.
    """
    every = runs.select("run_id").distinct().join(F.broadcast(runs.sparkSession.createDataFrame([(c,) for c in checks.CHECKS], "check_id string")))
    f = findings.groupBy("run_id", "check_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("disposition") == "OPEN").alias("open"), F.collect_set("reason_code").alias("found"), F.bool_or("stale_waiver").alias("stale_f"))
    g = gaps.groupBy("run_id", "check_id").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(~F.col("accepted")).alias("open_gaps"), F.collect_set("reason_code").alias("missed"), F.bool_or(F.col("reason_code").isin(*SCOPE_GAPS) & ~F.col("accepted")).alias("unknown"), F.bool_or("stale_acceptance").alias("stale_g"))
    j = every.join(f, ["run_id", "check_id"], "left").join(g, ["run_id", "check_id"], "left").join(relevant.withColumn("relevant", F.lit(True)), ["run_id", "check_id"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    outcome = F.when(n("findings") > 0, "FAIL").when(n("open_gaps") > 0, "INCONCLUSIVE").when(F.col("relevant").isNull(), "NOT_APPLICABLE").otherwise("PASS")
    coverage = F.when(F.coalesce("unknown", F.lit(False)), "UNKNOWN").when(n("open_gaps") > 0, "PARTIAL").otherwise("COMPLETE")
    none = F.array().cast("array<string>")
    return j.select("run_id", "check_id", outcome.alias("outcome"), coverage.alias("coverage"), n("open").alias("open_findings"), n("open_gaps").alias("open_gaps"), F.array_sort(F.array_union(F.coalesce("found", none), F.coalesce("missed", none))).alias("reason_codes"), F.array_compact(F.array(F.when(F.col("stale_g"), "coverage_acceptance_review"), F.when(F.col("stale_f"), "waiver_review"))).alias("reviews"))


def fatal_results(checked: DataFrame, fatal: DataFrame) -> DataFrame:
    """checked, with the rows of runs that could not be looked at in place of theirs. fatal: run_id, code."""
    rows = review.fan_out(fatal, checks.CHECKS)
    rows = rows.select("run_id", "check_id", "outcome", "coverage", F.lit(0).cast("long").alias("open_findings"), F.lit(1).cast("long").alias("open_gaps"), "reason_codes", F.array().cast("array<string>").alias("reviews"))
    return checked.join(fatal.select("run_id").distinct(), "run_id", "left_anti").select(rows.columns).union(rows)


def verdicts(checked: DataFrame, faults: DataFrame | None = None, asked: DataFrame | None = None, proposal: DataFrame | None = None, drifted: DataFrame | None = None) -> DataFrame:
    """(run_id, status, exit_code, reason_codes) of each run.

    faults: run_id, code of further faults. asked: run_id, codes of further reviews.
    proposal: what ``policy_review`` gives; it asks for a review, and one with records
    that are not valid is a fault. drifted: run_id of runs whose target must not have moved on, but has.
    """
    none = F.array().cast("array<string>")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    error = F.bool_or(F.col("outcome") == "ERROR")
    v = checked.groupBy("run_id").agg(F.sum("open_findings").alias("findings"), F.sum("open_gaps").alias("gaps"), error.alias("error"), every("reviews").alias("reviews"), every("reason_codes").alias("reason_codes"))
    nothing = checked.sparkSession.createDataFrame([], "run_id string, code string, codes array<string>, superseded long, invalid long")
    facts = lambda df, *cols: (nothing if df is None else df).groupBy("run_id").agg(*cols)
    v = v.join(facts(faults, F.collect_set("code").alias("faults")), "run_id", "left")
    v = v.join(facts(asked, every("codes").alias("asked")), "run_id", "left")
    v = v.join(facts(proposal, F.max("superseded").alias("superseded"), F.max("invalid").alias("invalid"), every("codes").alias("proposed")), "run_id", "left")
    v = v.join(facts(drifted, F.first(F.lit(True)).alias("drifted")), "run_id", "left")
    proposes = F.when(F.col("proposed").isNotNull(), F.array(F.lit("policy_change_review"))).otherwise(none)
    codes = F.array_union(F.array_union("reviews", F.coalesce("asked", none)), proposes)
    broken = F.coalesce(F.col("invalid") > 0, F.lit(False))
    proposed = F.when(broken, F.array(F.lit("gate_integrity_review"))).otherwise(F.coalesce("proposed", none))
    codes = review.after_proposal(codes, proposed, F.coalesce("superseded", F.lit(0)), F.col("findings"), F.col("gaps"))
    wrong = F.array_union(F.coalesce("faults", none), F.when(broken, F.array(F.lit("invalid_policy"))).otherwise(none))
    moved = F.coalesce("drifted", F.lit(False))
    v = v.select("*", codes.alias("codes"), wrong.alias("wrong"), moved.alias("moved"))
    status = algebra.verdict(F.col("error") | (F.size("wrong") > 0), F.col("findings") > 0, (F.col("gaps") > 0) | F.col("moved"), F.size("codes") > 0)
    told = F.array_union(F.array_union("reason_codes", "codes"), F.array_union("wrong", F.when(F.col("moved"), F.array(F.lit("target_drift"))).otherwise(none)))
    return v.select("run_id", status.alias("status"), algebra.exit_code(status).alias("exit_code"), F.array_sort(told).alias("reason_codes"))


def gate(files: DataFrame, rules: DataFrame, records: DataFrame, as_of: str, faults: DataFrame | None = None, fatal: DataFrame | None = None, proposed: DataFrame | None = None, drifted: DataFrame | None = None, policy: str = review.POLICY, most_entities: int = MOST_ENTITIES, most_calls: int = MOST_CALLS) -> dict[str, DataFrame]:
    """All tables of a gate: findings, gaps, results and verdicts.

    fatal: run_id, code of runs that could not be looked at. proposed: records of the
    policies that changes propose, as policies gives them. Changes of protected paths, and of the policy
    at ``policy``, ask for a review.
    """
    change = checks.Change(files, rules)
    findings, gaps = without_exhausted(*run_checks(change), settle(over_budget(change, most_entities, most_calls)))
    findings = settle(apply_waivers(findings, records, as_of))
    gaps = settle(apply_acceptances(gaps, records, as_of))
    named = lambda df, *names: functools.reduce(DataFrame.union, [df.select("run_id", F.lit(n).alias("check_id")) for n in names]).distinct()
    relevant = functools.reduce(
        DataFrame.union,
        [
            named(change.entries, "grounding", "security"),
            named(change.removed, "deletion"),
            named(change.changed, "contract"),
            named(change.mapped.where("change = 'modified'"), "semantic"),
        ],
    ).distinct()
    checked = results(files, findings, gaps, relevant)
    if fatal is not None:
        checked = fatal_results(checked, fatal)
    paths = change.entries.select("run_id", F.explode(F.array_compact(F.array("base_path", "head_path"))).alias("path"))
    asked = review.integrity(paths, policy).select("run_id", "codes")
    proposal = None
    if proposed is not None:
        held = records.join(proposed.select("run_id").distinct(), "run_id", "left_semi")
        proposal = review.policy_review(held.drop("record_no"), proposed.drop("record_no"), F.lit(as_of))
    return {"findings": findings, "gaps": gaps, "results": checked, "verdicts": verdicts(checked, faults, asked, proposal, drifted)}


def sarif(findings: DataFrame) -> DataFrame:
    """(run_id, sarif): one SARIF 2.1.0 log for each run; results in a fixed order."""
    line = F.coalesce("line", F.lit(1))
    level = F.when(F.col("disposition") == "WAIVED", "note").otherwise("error")
    place = F.struct(F.struct(F.struct(uri_path(F.col("path")).alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("defect_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("finding")).alias("partialFingerprints"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("check_id", "path", line.alias("line"), "fingerprint", result.alias("result")))), lambda x: x["result"])
    logs = findings.groupBy("run_id").agg(ordered.alias("results"), F.array_sort(F.collect_set("defect_id")).alias("rules"))
    driver = F.struct(F.struct(F.lit("palisade").alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.col("results"))
    return logs.select("run_id", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def bundle(tables: dict[str, DataFrame], run_id: str) -> dict:
    """One run's evidence as canonical JSON with its hash: a result for a reader, bounded by one change."""
    rows = lambda name: [json.loads(r.j) for r in tables[name].where(F.col("run_id") == run_id).select(F.to_json(F.struct("*")).alias("j")).collect()]
    payload = {name: sorted(rows(name), key=canonical) for name in tables}
    return {"payload": payload, "envelope": {"payload_hash": payload_hash(payload)}}


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, summary): a few lines of text for each run."""
    f = tables["findings"].groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("defect_id", F.lit(" "), "path", F.lit(":"), F.coalesce("line", F.lit(1)).cast("string"), F.lit(" "), "message"))), "\n").alias("lines"))
    return tables["verdicts"].join(f, "run_id", "left").select("run_id", F.concat_ws("\n", F.concat(F.lit("verdict: "), "status"), F.concat(F.lit("reasons: "), F.array_join("reason_codes", ", ")), "lines").alias("summary"))
