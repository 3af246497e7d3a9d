"""What decides beside findings: protected paths, policy reviews, budgets, faults, gradings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import gate

# Files and folders that the gate's own integrity rests on, beside the policy's folder.
PROTECTED_FILES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
PROTECTED_FOLDERS = (".github/workflows/", ".github/actions/")
POLICY = ".palisade/policy.toml"
# Gaps whose acceptance narrows the scope, and review codes that owners can clear.
SCOPE_EXCLUSIONS = ("unsupported_language", "frontend_capability_missing")
CLEARABLE = ("policy_change_review", "gate_integrity_review")
STALE_REVIEWS = ("waiver_review", "coverage_acceptance_review")
# Gaps; where one keeps a run from being looked at, its checks are undecided, with any other code in error.
GAPS = (
    "mapping_unresolved", "dynamic_target_unresolved", "dynamic_call", "unknown_decorator", "unresolved_import", "unknown_call_on_path", "frontend_capability_missing", "unsupported_language", "unsupported_syntax_version", "lfs_content_unavailable",
    "taint_path_unresolved", "secret_candidate_ambiguous", "solver_unknown", "semantic_alignment_unresolved", "parse_error", "parse_resource_limit", "budget_exhausted", "watchdog_interrupted",
)
#: Candidates of renames, on both sides together and as a product, beyond which likeness is not looked for.
RENAME_LIMIT = 2000
LFS_POINTER = "version https://git-lfs.github.com/spec/"
# Starts of tokens that no message may show.
RAW_TOKENS = ("ghp_", "AKIA", "sk_live_")


def protected_path(path: Column, policy: str = POLICY) -> Column:
    folders = (policy.rsplit("/", 1)[0] + "/", *PROTECTED_FOLDERS)
    out = path.isin(*PROTECTED_FILES)
    for folder in folders:
        out = out | F.startswith(path, F.lit(folder))
    return out


def integrity(paths: DataFrame, policy: str = POLICY) -> DataFrame:
    """(run_id, protected, first_protected, policy_changed, codes) of runs by their changed paths.

    Both paths of a rename count; so a file moved out of a protected folder does.
    Only counts and the least path are kept of each run, combined before the shuffle.
    """
    safe = protected_path(F.col("path"), policy)
    changed = paths.groupBy("run_id").agg(F.count_if(safe).alias("protected"), F.min(F.when(safe, F.col("path"))).alias("first_protected"), F.coalesce(F.bool_or(F.col("path") == policy), F.lit(False)).alias("policy_changed"))
    codes = F.array(F.when(F.col("protected") > 0, "gate_integrity_review"), F.when(F.col("policy_changed"), "policy_change_review"))
    return changed.withColumn("codes", F.array_compact(codes))


def policy_review(records: DataFrame, proposed: DataFrame, as_of: Column) -> DataFrame:
    """(run_id, invalid, superseded, codes): what a proposed policy's records ask for.

    records, proposed: run_id, kind, record_id, created, expires and further columns
    alike in both; days as text or dates. invalid counts records that are new or
    changed and begin after the day; superseded counts inactive records that the
    proposal drops or renews. An inactive record that it holds asks for a review.
    """
    keys = ["run_id", "kind", "record_id"]
    more = [c for c in records.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*more).alias(name))
    j = side(records, "old").join(side(proposed, "new"), keys, "full_outer")
    active = lambda r: gate.is_active(as_of, F.col(f"{r}.created"), F.col(f"{r}.expires"))
    has = lambda r: F.col(r).isNotNull()
    late = has("new") & ~F.col("old").eqNullSafe(F.col("new")) & (F.col("new.created") > as_of)
    gone = has("old") & ~active("old") & (~has("new") | active("new"))
    stale = has("new") & ~active("new")
    asked = lambda kind, code: F.when(F.bool_or(stale & (F.col("kind") == kind)), code)
    codes = F.array_compact(F.array(asked("acceptances", "coverage_acceptance_review"), asked("waivers", "waiver_review")))
    return j.groupBy("run_id").agg(F.count_if(late).alias("invalid"), F.count_if(gone).alias("superseded"), codes.alias("codes"))


def after_proposal(codes: Column, proposed: Column, superseded: Column, open_findings: Column, open_gaps: Column) -> Column:
    """Review codes with those that a proposal asks for.

    A proposal that asks for none and drops or renews inactive records settles the
    reviews of those, but only where nothing else blocks the run.
    """
    every = F.array_union(codes, proposed)
    settled = (superseded > 0) & (open_findings == 0) & (open_gaps == 0) & (F.size(proposed) == 0)
    return F.array_sort(F.when(settled, F.filter(every, lambda c: ~c.isin(*STALE_REVIEWS))).otherwise(every))


def review_cleared(status: Column, codes: Column, owners_proven: Column, by_owners: Column) -> Column:
    """Whether proven owners' review settles all that a verdict asks for."""
    clearable = F.array(*[F.lit(c) for c in CLEARABLE])
    return (status == "REVIEW") & owners_proven & by_owners & (F.size(F.array_except(codes, clearable)) == 0)


def scope_lifted(gaps: Column, open_gaps: Column, codes: Column) -> Column:
    """Whether accepted gaps leave a narrower scope that was looked at whole."""
    return (gaps > 0) & (open_gaps == 0) & (F.size(F.array_except(codes, F.array(*[F.lit(c) for c in SCOPE_EXCLUSIONS]))) == 0)


def fan_out(faults: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """(run_id, check_id, outcome, coverage, reason_codes): a row for each check of a run that could not be looked at.

    faults: run_id, code. Gaps leave the checks undecided, anything else is an error;
    of several codes an error decides.
    """
    f = faults.groupBy("run_id").agg(F.array_sort(F.collect_set("code")).alias("reason_codes"))
    limited = F.size(F.array_except("reason_codes", F.array(*[F.lit(c) for c in GAPS]))) == 0
    row = F.explode(F.array(*[F.lit(c) for c in checks])).alias("check_id")
    return f.select("run_id", row, F.when(limited, "INCONCLUSIVE").otherwise("ERROR").alias("outcome"), F.when(limited, "PARTIAL").otherwise("UNKNOWN").alias("coverage"), "reason_codes")


def enumerated(base: DataFrame, head: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, enumerated): distinct names over both sides."""
    return base.select(*keys, name).union(head.select(*keys, name)).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("enumerated"))


def within_budget(outcome: Column, used: Column, budget: Column) -> Column:
    """A check that had to look at more than its budget is undecided, whatever it found."""
    return F.when(used > budget, "INCONCLUSIVE").otherwise(outcome)


def rename_limited(added: Column, deleted: Column) -> Column:
    return (added > 0) & (deleted > 0) & ((added + deleted > RENAME_LIMIT) | (added * deleted > RENAME_LIMIT))


def blob_flags(base_mode: Column, head_mode: Column, base: Column, head: Column) -> Column:
    """(is_submodule, is_symlink, is_binary, is_lfs) of an entry; a submodule has no content."""
    either = lambda test, a, b: F.coalesce(test(a), F.lit(False)) | F.coalesce(test(b), F.lit(False))
    sub = either(lambda m: m == "160000", base_mode, head_mode)
    zero, pointer = F.unhex(F.lit("00")), F.encode(F.lit(LFS_POINTER), "utf-8")
    binary = either(lambda x: F.position(zero, x) > 0, base, head)
    lfs = either(lambda x: F.startswith(x, pointer), base, head)
    return F.struct(sub.alias("is_submodule"), either(lambda m: m == "120000", base_mode, head_mode).alias("is_symlink"), (~sub & binary).alias("is_binary"), (~sub & lfs).alias("is_lfs"))


def excluded_scope(entries: DataFrame, accepted: DataFrame, drifted: DataFrame) -> DataFrame:
    """(run_id, kind, path, reason_code): what a verdict does not speak of.

    entries: run_id, path and the flags; accepted: run_id, path, reason_code of accepted
    gaps; drifted: run_id of runs whose target has moved on.
    """
    null = F.lit(None).cast("string")
    lfs = "lfs_content_unavailable"
    kinds = F.array_compact(F.array(F.when(F.col("is_binary"), "binary"), F.when(F.col("is_submodule"), "submodule"), F.when(F.col("is_lfs"), lfs)))
    own = entries.select("run_id", F.explode(kinds).alias("kind"), "path").withColumn("reason_code", F.when(F.col("kind") == lfs, lfs))
    moved = drifted.select("run_id", F.lit("target_changes_since_merge_base").alias("kind"), null.alias("path"), null.alias("reason_code"))
    return own.union(accepted.select("run_id", F.lit("accepted_gap"), "path", "reason_code")).union(moved)


def violations(declared: Column, outcome: Column, scope: Column, candidates: Column, findings: Column, open_gaps: Column, partial_subs: Column, told: Column) -> Column:
    """What a result breaks of the rules that hold for all, in their order.

    effective coverage: complete only if scope, candidates and sub-results are, without open gaps.
    """
    complete, found = declared == "COMPLETE", findings > 0
    whole = gate.effective_coverage(declared, scope, candidates, open_gaps > 0, F.lit(False), partial_subs == 0) == "COMPLETE"
    rules = [
        (complete & ~scope, "complete_without_scope"),
        (complete & ~candidates, "complete_without_candidates"),
        (complete & (open_gaps > 0), "complete_with_open_gaps"),
        (complete & (partial_subs > 0), "complete_with_partial_parts"),
        ((outcome == "PASS") & ~whole, "pass_without_coverage"),
        ((outcome == "PASS") & found, "pass_with_findings"),
        ((outcome == "NOT_APPLICABLE") & ~whole, "not_applicable_without_coverage"),
        ((outcome == "NOT_APPLICABLE") & found, "not_applicable_with_findings"),
        ((outcome == "INCONCLUSIVE") & found, "inconclusive_with_findings"),
        ((outcome == "FAIL") & ~found, "fail_without_findings"),
        ((outcome == "ERROR") & ~told, "error_without_reason"),
    ]
    return F.array_compact(F.array(*[F.when(test, code) for test, code in rules]))


def graded(answers: DataFrame) -> DataFrame:
    """answers with errors, matched and false_blocking.

    answers: got and wanted (struct<outcome, coverage, reason_codes, findings>, the lists
    in any order) and messages of the findings.
    """
    wrong = []
    for name in ("outcome", "coverage"):
        wrong.append(F.when(~F.col(f"got.{name}").eqNullSafe(F.col(f"wanted.{name}")), name))
    for name in ("reason_codes", "findings"):
        wrong.append(F.when(~F.array_sort(f"got.{name}").eqNullSafe(F.array_sort(f"wanted.{name}")), name))
    blocking = F.coalesce((F.col("wanted.outcome") != "FAIL") & (F.col("got.outcome") == "FAIL"), F.lit(False))
    raw = F.exists("messages", lambda m: m.rlike("|".join(RAW_TOKENS)))
    errors = F.array_compact(F.array(*wrong, F.when(blocking, "false_blocking"), F.when(raw, "raw_secret")))
    return answers.withColumn("errors", errors).withColumn("matched", F.size("errors") == 0).withColumn("false_blocking", blocking)


def warnings(found: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, count, kinds): how many warnings, and of which kinds."""
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), gate.code_set(F.coalesce(F.col(kind), F.lit("unknown"))).alias("kinds"))


def owner_reasons(target: Column, rules: list[tuple[int, str, list[str]]]) -> Column:
    """Why owners' rules do not prove that a path is covered; empty if they do.

    rules: number, rooted pattern or one for all (``*``, ``**``), owners, in order. The
    last rule that covers the path needs owners, and no later rule that could touch
    what is below it may name others.
    """
    parts = F.split(target, "/")
    everything = ("*", "**", "/**")

    def pieces(pattern: str, tail: bool) -> list[str]:
        body = pattern.strip("/")
        return [p for p in (body[:-3] if tail and body.endswith("/**") else body).split("/") if p]

    def covers(pattern: str) -> Column:
        own = pieces(pattern, True)
        if pattern in everything:
            return F.lit(True)
        if not pattern.startswith("/") or not own:
            return F.lit(False)
        return F.slice(parts, 1, len(own)) == F.array(*map(F.lit, own))

    def touches(pattern: str) -> Column:
        own = pieces(pattern, False)
        if pattern in everything:
            return F.lit(True)
        if not pattern.startswith("/") or not own:
            return F.lit(False)
        out = F.lit(True)
        for k, part in reversed(list(enumerate(own))):
            out = (F.size(parts) <= k) | F.lit(part in ("*", "**")) | ((F.get(parts, F.lit(k)) == part) & out)
        return out

    names = lambda owners: F.array(*map(F.lit, owners)).cast("array<string>")
    hit = lambda test: F.array_compact(F.array(*[F.when(test(p), F.struct(F.lit(i).alias("no"), names(o).alias("owners"))) for i, p, o in rules]))
    if not rules:
        return F.array(F.lit("codeowners_missing_rule"))
    last = F.array_max(hit(covers))
    other = F.exists(hit(touches), lambda r: (r["no"] > last["no"]) & (r["owners"] != last["owners"]))
    found = F.array_compact(F.array(F.when(F.size(last["owners"]) == 0, "codeowners_ownerless_rule"), F.when(other, "codeowners_noninterference_unproven")))
    return F.when(last.isNull(), F.array(F.lit("codeowners_missing_rule"))).otherwise(found)
