"""Scenarios of changes, all gated in one job: one run each."""

import json

import pytest

from palisade.plans import gate
from palisade.sources.policies import parse_policy, policy_tables

LIB = "def helper(a, b):\n    return a + b\n\n\ndef _private(x):\n    return x\n"
USE = "from pkg.lib import helper\n\n\ndef run():\n    return helper(1, 2)\n"
GUARD = "def pay(user, amount):\n    if user.admin and amount > 0:\n        transfer(user, amount)\n"

TS_GUARD = 'export function del(u: any, id: string) {\n  if (u.role === "admin") {\n    purge(id);\n  }\n}\n'

# name: base files, head files, policy, wanted (check, outcome, coverage), wanted defects, wanted gap codes
CASES = {
    "nothing": ({"a.py": LIB}, {"a.py": LIB}, "", ("deletion", "NOT_APPLICABLE", "COMPLETE"), set(), set()),
    "denied_path": ({"src/a.txt": "x"}, {"src/a.txt": "y"}, '[deny.R1]\npaths = ["src/**"]\n', ("grounding", "FAIL", "COMPLETE"), {"GRD-UNGROUNDED-EDIT"}, set()),
    "denied_symbol": ({"a.py": LIB}, {"a.py": LIB.replace("a + b", "a - b")}, '[deny.R1]\nsymbols = ["a:helper"]\n', ("grounding", "FAIL", "COMPLETE"), {"GRD-UNGROUNDED-EDIT"}, set()),
    "binary_denied": ({"b.bin": "a\0b"}, {"b.bin": "a\0c"}, '[deny.R1]\npaths = ["*.bin"]\n', ("grounding", "FAIL", "COMPLETE"), {"GRD-UNGROUNDED-EDIT"}, set()),
    "syntax_error": ({"a.py": "x = 1\n"}, {"a.py": "x = (\n"}, "", ("grounding", "INCONCLUSIVE", "UNKNOWN"), set(), {"parse_error"}),
    "module_constant": ({"a.py": "X = 1\n"}, {"a.py": "import os\nX = [-2, int('3'), {'k': Path('a')}]\n"}, "", ("grounding", "PASS", "COMPLETE"), set(), set()),
    "module_effect": ({"a.py": "X = 1\n"}, {"a.py": "X = load(1)\n"}, "", ("grounding", "INCONCLUSIVE", "PARTIAL"), set(), {"mapping_unresolved"}),
    "module_effect_gone": ({"a.py": "X = 1\nrun()\n"}, {"a.py": "X = 1\n"}, "", ("grounding", "INCONCLUSIVE", "PARTIAL"), set(), {"mapping_unresolved"}),
    "effect_untouched": ({"a.py": "run()\nX = 1\n"}, {"a.py": "run()\nX = 2\n"}, "", ("grounding", "PASS", "COMPLETE"), set(), set()),
    "script_statement": ({"a.ts": "let x = 1;\n"}, {"a.ts": "let x = 2;\n"}, "", ("grounding", "INCONCLUSIVE", "PARTIAL"), set(), {"mapping_unresolved"}),
    "go": ({"a.go": "package a\n"}, {"a.go": "package b\n"}, "", ("contract", "INCONCLUSIVE", "UNKNOWN"), set(), {"unsupported_language"}),
    "public_removed": ({"pkg/lib.py": "__all__ = ['helper']\n" + LIB}, {"pkg/lib.py": "def _private(x):\n    return x\n"}, "", ("deletion", "FAIL", "COMPLETE"), {"DEL-REACHABLE-SYMBOL"}, set()),
    "policy_public": ({"pkg/lib.py": LIB}, {"pkg/lib.py": "X = 1\n"}, '[public_api]\nsymbols = ["pkg/lib:helper"]\n', ("deletion", "FAIL", "COMPLETE"), {"DEL-REACHABLE-SYMBOL", "CTR-EXPORT-BREAK"}, set()),
    "dangling_import": ({"pkg/lib.py": LIB, "pkg/use.py": USE}, {"pkg/lib.py": "def _private(x):\n    return x\n", "pkg/use.py": USE}, "", ("deletion", "FAIL", "COMPLETE"), {"DEL-DANGLING-REFERENCE"}, set()),
    "dangling_call": ({"a.py": "def _f():\n    pass\n\n\ndef g():\n    _f()\n"}, {"a.py": "def g():\n    _f()\n"}, "", ("deletion", "FAIL", "COMPLETE"), {"DEL-DANGLING-REFERENCE"}, set()),
    "private_unused": ({"pkg/lib.py": LIB}, {"pkg/lib.py": LIB.split("\n\n\n")[0] + "\n"}, "", ("deletion", "PASS", "COMPLETE"), set(), set()),
    "lookup": ({"a.py": "def f():\n    pass\n", "b.py": "import a\n"}, {"a.py": "X = 1\n", "b.py": "import a\ngetattr(a, 'f')()\n"}, "", ("deletion", "FAIL", None), {"DEL-DYNAMIC-REFERENCE"}, set()),
    "signature": ({"pkg/lib.py": LIB, "pkg/use.py": USE}, {"pkg/lib.py": LIB.replace("a, b", "a, b, c"), "pkg/use.py": USE}, "", ("contract", "FAIL", "COMPLETE"), {"CTR-SIGNATURE-BREAK"}, set()),
    "optional_added": ({"pkg/lib.py": LIB, "pkg/use.py": USE}, {"pkg/lib.py": LIB.replace("a, b", "a, b, c=1"), "pkg/use.py": USE}, "", ("contract", "PASS", "COMPLETE"), set(), set()),
    "async": ({"pkg/lib.py": LIB, "pkg/use.py": USE}, {"pkg/lib.py": LIB.replace("def helper", "async def helper"), "pkg/use.py": USE}, "", ("contract", "FAIL", "COMPLETE"), {"CTR-SIGNATURE-BREAK"}, set()),
    "caller_broke": ({"pkg/lib.py": LIB, "pkg/use.py": USE}, {"pkg/lib.py": LIB, "pkg/use.py": USE.replace("helper(1, 2)", "helper(1)")}, "", ("contract", "FAIL", "COMPLETE"), {"CTR-CALL-INCOMPATIBLE"}, set()),
    "star_call": ({"pkg/lib.py": LIB, "pkg/use.py": USE}, {"pkg/lib.py": LIB, "pkg/use.py": USE.replace("helper(1, 2)", "helper(*x)")}, "", ("contract", "INCONCLUSIVE", "PARTIAL"), set(), {"dynamic_call"}),
    "ts_signature": ({"a.ts": "export function f(a, b) { return a; }\n", "b.ts": "import { f } from './a';\nf(1, 2);\n"}, {"a.ts": "export function f(a, b, c) { return a; }\n", "b.ts": "import { f } from './a';\nf(1, 2);\n"}, "", ("contract", "FAIL", "COMPLETE"), {"CTR-SIGNATURE-BREAK"}, set()),
    "guard_removed": ({"a.py": GUARD}, {"a.py": "def pay(user, amount):\n    transfer(user, amount)\n"}, '[protected_guards.G]\neffects = ["transfer"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-GUARD-REMOVED"}, set()),
    "guard_weakened": ({"a.py": GUARD}, {"a.py": GUARD.replace(" and amount > 0", "")}, '[protected_guards.G]\neffects = ["transfer"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-GUARD-WEAKENED"}, set()),
    "guard_inverted": ({"a.py": GUARD}, {"a.py": GUARD.replace("user.admin and amount > 0", "not (user.admin and amount > 0)")}, '[protected_guards.G]\neffects = ["transfer"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-GUARD-INVERTED"}, set()),
    "guard_stronger": ({"a.py": GUARD}, {"a.py": GUARD.replace("amount > 0", "amount > 0 and user.active")}, '[protected_guards.G]\neffects = ["transfer"]\n', ("semantic", "PASS", "COMPLETE"), set(), set()),
    "guard_rewritten": ({"a.py": GUARD}, {"a.py": "def pay(user, amount):\n    if not user.admin:\n        return\n    if amount <= 0:\n        return\n    transfer(user, amount)\n"}, '[protected_guards.G]\neffects = ["transfer"]\n', ("semantic", "PASS", "COMPLETE"), set(), set()),
    "guard_beside": ({"a.py": GUARD}, {"a.py": GUARD + "    transfer(user, 2)\n"}, '[protected_guards.G]\neffects = ["transfer"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-GUARD-REMOVED"}, set()),
    "guards_swapped": ({"a.py": "def f(a, b):\n    if a:\n        go(1)\n    if b:\n        go(2)\n"}, {"a.py": "def f(a, b):\n    if b:\n        go(1)\n    if a:\n        go(2)\n"}, '[protected_guards.G]\neffects = ["go"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-GUARD-WEAKENED"}, set()),
    "guard_once_of_two": ({"a.py": "def f(a, b):\n    if a:\n        go(1)\n    if b:\n        go(1)\n"}, {"a.py": "def f(a, b):\n    if a or b:\n        go(1)\n"}, '[protected_guards.G]\neffects = ["go"]\n', ("semantic", "PASS", "COMPLETE"), set(), set()),
    "ts_guard_removed": ({"s/a.ts": TS_GUARD}, {"s/a.ts": "export function del(u: any, id: string) {\n  purge(id);\n}\n"}, '[protected_guards.G]\neffects = ["purge"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-GUARD-REMOVED"}, set()),
    "ts_guard_kept": ({"s/a.ts": TS_GUARD}, {"s/a.ts": TS_GUARD.replace("purge(id)", "log(id); purge(id)")}, '[protected_guards.G]\neffects = ["purge"]\n', ("semantic", "PASS", "COMPLETE"), set(), set()),
    "ts_guard_other": ({"s/a.ts": TS_GUARD}, {"s/a.ts": TS_GUARD.replace("admin", "guest")}, '[protected_guards.G]\neffects = ["purge"]\n', ("semantic", "INCONCLUSIVE", None), set(), {"solver_unknown"}),
    "error_removed": ({"a.py": "def f(x):\n    if x is None:\n        raise ValueError('x')\n    return x\n"}, {"a.py": "def f(x):\n    return x\n"}, '[protected_errors.E]\nraises = ["ValueError"]\n', ("semantic", "FAIL", "COMPLETE"), {"SEM-EXCEPTION-REMOVED"}, set()),
    "swap": ({"a.py": "def f(a, b):\n    return a, b\n"}, {"a.py": "def f(a, b):\n    return b, a\n"}, "", ("semantic", "FAIL", "COMPLETE"), {"SEM-BINDING-SWAP"}, set()),
    "eval_gap": ({"a.py": "def f(a):\n    return a\n"}, {"a.py": "def f(a):\n    return eval(a)\n"}, "", ("semantic", "INCONCLUSIVE", "PARTIAL"), {"SEC-DANGEROUS-CALL"}, {"dynamic_call"}),
    "secret": ({"c.txt": "a\n"}, {"c.txt": "a\nkey = AKIA" + "QWERTYUIOPASDFGH" + "\n"}, "", ("security", "FAIL", "COMPLETE"), {"SEC-SECRET"}, set()),
    "secret_allowed": ({"c.txt": "a\n"}, {"c.txt": "a\nkey = AKIA" + "QWERTYUIOPASDFGH" + "\n"}, '[secrets]\nallowlist_paths = ["c.txt"]\n', ("security", "PASS", "COMPLETE"), set(), set()),
    "secret_unchanged": ({"c.txt": "key = AKIA" + "QWERTYUIOPASDFGH" + "\n"}, {"c.txt": "key = AKIA" + "QWERTYUIOPASDFGH" + "\nnew\n"}, "", ("security", "PASS", "COMPLETE"), set(), set()),
    "secret_flows": ({"c.py": "x = 1\n"}, {"c.py": "x = 1\napi_key = 'q8Zt4Lw0Xc7Vb2Nm'\nprint(api_key)\n"}, "", ("security", "FAIL", "COMPLETE"), {"SEC-SECRET", "SEC-SECRET-TO-SINK"}, set()),
    "bad_jwt": ({"c.txt": ""}, {"c.txt": "v eyJabcdefgh.eyJabcdefgh.abcdefghi\n"}, "", ("security", "INCONCLUSIVE", "PARTIAL"), set(), {"secret_candidate_ambiguous"}),
    "taint": ({"t.py": "x = 1\n"}, {"t.py": "x = 1\ncursor.execute(request.args)\n"}, '[taint]\nsources = ["s"]\nsinks = ["t"]\n', ("security", "FAIL", "COMPLETE"), {"SEC-TAINT-TO-SINK"}, set()),
    "forbidden": ({"t.py": "x = 1\n"}, {"t.py": "x = 1\nlib.drop(x)\n"}, '[forbidden_calls.F]\nsymbols = ["lib.drop"]\n', ("security", "FAIL", "COMPLETE"), {"SEC-DANGEROUS-CALL"}, set()),
    "secret_after_stand_in": ({"c.txt": "a\n"}, {"c.txt": "a\nu postgres://u:example" + "@h.io/d postgres://app:q8Zt4Lw0" + "@db.corp.io/x\n"}, "", ("security", "FAIL", "COMPLETE"), {"SEC-SECRET"}, set()),
    "assigned_bad_jwt": ({"c.txt": "a\n"}, {"c.txt": "a\ntoken = eyJabcdefghij.eyJklmnopqrst.uvwxyzqkpw\n"}, "", ("security", "FAIL", None), {"SEC-SECRET"}, {"secret_candidate_ambiguous"}),
    "call_by_alias": ({"t.py": "x = 1\n"}, {"t.py": "x = 1\nfrom os import system as s\ns(x)\n"}, "", ("security", "FAIL", "COMPLETE"), {"SEC-DANGEROUS-CALL"}, set()),
    "call_of_module": ({"t.py": "x = 1\n"}, {"t.py": "x = 1\nimport subprocess as sp\nsp.run(x)\n"}, "", ("security", "FAIL", "COMPLETE"), {"SEC-DANGEROUS-CALL"}, set()),
    "call_over_lines": ({"t.py": "import os\nos.system(\n    1,\n)\n"}, {"t.py": "import os\nos.system(\n    2,\n)\n"}, "", ("security", "FAIL", "COMPLETE"), {"SEC-DANGEROUS-CALL"}, set()),
    "forbidden_alias": ({"t.py": "x = 1\n"}, {"t.py": "x = 1\nfrom lib import drop as d\nd(x)\n"}, '[forbidden_calls.F]\nsymbols = ["lib.drop"]\n', ("security", "FAIL", "COMPLETE"), {"SEC-DANGEROUS-CALL"}, set()),
    "secret_to_taint_sink": ({"c.js": "x\n"}, {"c.js": "x\napi_key = 'q8Zt4Lw0Xc7Vb2Nm'\na.innerHTML = api_key\n"}, "", ("security", "FAIL", None), {"SEC-SECRET", "SEC-SECRET-TO-SINK", "SEC-DANGEROUS-CALL"}, set()),
    "secret_to_alias": ({"c.py": "x = 1\n"}, {"c.py": "from logging import info as say\napi_key = 'q8Zt4Lw0Xc7Vb2Nm'\nsay(api_key)\n"}, "", ("security", "FAIL", None), {"SEC-SECRET", "SEC-SECRET-TO-SINK"}, set()),
    "renamed": ({"old.txt": "same\n"}, {"new.txt": "same\n"}, "", ("security", "PASS", "COMPLETE"), set(), set()),
}


@pytest.fixture(scope="module")
def tables(spark):
    from palisade.sources.facts import source_facts  # noqa: F401

    rows, policies = [], {}
    for name, (base, head, policy, *_) in CASES.items():
        for side, tree in (("base", base), ("head", head)):
            for path, body in tree.items():
                raw = body.encode()
                import hashlib

                rows.append((name, side, path, "100644", hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest(), bytearray(raw)))
        policies[name] = parse_policy(policy.encode())
    files = spark.createDataFrame(rows, "run_id string, side string, path string, mode string, blob_id string, content binary")
    rules, records = policy_tables(spark, policies)
    out = gate.gate(files, rules, records, "2026-01-01")
    return {k: v.persist() for k, v in out.items()} | {"files": files, "rules": rules}


def test_every_case(tables):
    results = {(r.run_id, r.check_id): (r.outcome, r.coverage) for r in tables["results"].collect()}
    defects, gaps = {}, {}
    for r in tables["findings"].collect():
        defects.setdefault(r.run_id, set()).add(r.defect_id)
    for r in tables["gaps"].collect():
        gaps.setdefault((r.run_id, r.check_id), set()).add(r.reason_code)
    wrong = []
    for name, (_, _, _, (check, outcome, coverage), want, missed) in CASES.items():
        got = results[name, check]
        if got[0] != outcome or coverage and got[1] != coverage or defects.get(name, set()) != want or missed and gaps.get((name, check)) != missed:
            wrong.append((name, got, defects.get(name), gaps.get((name, check))))
    assert not wrong, wrong


def test_verdicts_and_evidence(spark, tables):
    v = {r.run_id: (r.status, r.exit_code) for r in tables["verdicts"].collect()}
    assert v["nothing"] == ("PASS", 0) and v["secret"] == ("FAIL", 1) and v["go"] == ("INCONCLUSIVE", 2)
    logs = {r.run_id: json.loads(r.sarif) for r in gate.sarif(tables["findings"]).collect()}
    assert logs["secret"]["runs"][0]["results"][0]["ruleId"] == "SEC-SECRET"
    told = {r.run_id: r.summary for r in gate.summary(tables).collect()}
    assert told["secret"].startswith("verdict: FAIL\nreasons: secret_detected")
    four = {k: tables[k] for k in ("findings", "gaps", "results", "verdicts")}
    assert gate.bundle(four, "secret") == gate.bundle(four, "secret")


def test_waivers_and_acceptances(spark, tables):
    f = tables["findings"].where("run_id = 'secret'").first()
    dated = lambda name, created, expires, more: f'[[{name}]]\nid = "{created}"\ncreated = {created}\nexpires = {expires}\n{more}\n'
    waive = f'check = "security"\ndefect_id = "SEC-SECRET"\nfingerprint = "{f.fingerprint}"'
    accept = 'check = "contract"\nreason_code = "dynamic_call"\npaths = ["pkg/**"]'
    one = ["secret", "star_call"]
    for created, expires, want in (("2025-12-01", "2026-02-01", {"secret": "PASS", "star_call": "PASS"}), ("2025-01-01", "2025-03-01", {"secret": "FAIL", "star_call": "INCONCLUSIVE"})):
        policies = {"secret": parse_policy(dated("waivers", created, expires, waive).encode()), "star_call": parse_policy(dated("acceptances", created, expires, accept).encode())}
        _, records = policy_tables(spark, policies)
        found = gate.apply_waivers(tables["findings"].drop("disposition", "waiver_id", "stale_waiver").where(f"run_id in {tuple(one)}"), records, "2026-01-01")
        gaps = gate.apply_acceptances(tables["gaps"].drop("accepted", "stale_acceptance").where(f"run_id in {tuple(one)}"), records, "2026-01-01")
        relevant = tables["results"].select("run_id", "check_id")
        got = {r.run_id: r.status for r in gate.verdicts(gate.results(tables["files"].where(f"run_id in {tuple(one)}"), found, gaps, relevant)).collect()}
        assert got == want


def test_reviews_faults_and_drift(spark):
    """Protected paths, a proposal, runs that could not be read, and a target that moved on, in one job."""
    record = lambda kind, name, created, expires: f'[[{kind}]]\nid = "{name}"\ncreated = {created}\nexpires = {expires}\nfingerprint = "sha256:{"0" * 64}"\n'
    rows, now, then = [], {}, {}
    for run in ("plain", "flow", "policy", "moved", "drift", "renewed", "stale", "late"):
        path = {"flow": ".github/workflows/a.yml", "policy": ".palisade/policy.toml", "moved": "docs/CODEOWNERS"}.get(run, "a.txt")
        rows += [(run, "base", path, "100644", "1", b"x"), (run, "head", "b.txt" if run == "moved" else path, "100644", "1" if run == "moved" else "2", b"x" if run == "moved" else b"y")]
    old, good = record("waivers", "w", "2025-01-01", "2025-03-01"), record("waivers", "w", "2025-12-01", "2026-03-01")
    now |= {"renewed": old, "stale": old, "late": ""}
    then |= {"renewed": good, "stale": old, "late": record("waivers", "w", "2026-02-01", "2026-03-01")}
    files = spark.createDataFrame(rows, "run_id string, side string, path string, mode string, blob_id string, content binary")
    rules, records = policy_tables(spark, {k: parse_policy(v.encode()) for k, v in now.items()})
    _, proposed = policy_tables(spark, {k: parse_policy(v.encode()) for k, v in then.items()})
    fatal = spark.createDataFrame([("gone", "missing_git_object"), ("huge", "parse_resource_limit")], "run_id string, code string")
    drifted = spark.createDataFrame([("drift",)], "run_id string")
    made = gate.gate(files, rules, records, "2026-01-01", fatal=fatal, proposed=proposed, drifted=drifted)
    got = {r.run_id: (r.status, r.exit_code, r.reason_codes) for r in made["verdicts"].collect()}
    assert got == {
        "plain": ("PASS", 0, []),
        "flow": ("REVIEW", 4, ["gate_integrity_review"]),
        "policy": ("REVIEW", 4, ["gate_integrity_review", "policy_change_review"]),
        "moved": ("REVIEW", 4, ["gate_integrity_review"]),
        "drift": ("INCONCLUSIVE", 2, ["target_drift"]),
        "renewed": ("REVIEW", 4, ["policy_change_review"]),
        "stale": ("REVIEW", 4, ["policy_change_review", "waiver_review"]),
        "late": ("ERROR", 3, ["gate_integrity_review", "invalid_policy", "policy_change_review"]),
        "gone": ("ERROR", 3, ["missing_git_object"]),
        "huge": ("INCONCLUSIVE", 2, ["parse_resource_limit"]),
    }
    outcomes = {(r.run_id, r.check_id): (r.outcome, r.coverage) for r in made["results"].where("run_id in ('gone', 'huge')").collect()}
    assert len(outcomes) == 10 and set(outcomes.values()) == {("ERROR", "UNKNOWN"), ("INCONCLUSIVE", "PARTIAL")}


def test_budgets_decide_whatever_was_found(spark):
    """Entities are counted once over both sides; a check over its budget has no finding and one gap."""
    base, head = "def f(a):\n    return a\n\n\ndef g():\n    return f(1)\n", "def f(a, b):\n    return a\n\n\ndef g():\n    return f(1)\n\n\ndef h():\n    return 1\n"
    rows = [("r", s, "a.py", "100644", s, t.encode()) for s, t in (("base", base), ("head", head))]
    files = spark.createDataFrame(rows, "run_id string, side string, path string, mode string, blob_id string, content binary")
    rules, records = policy_tables(spark, {"r": parse_policy(b'[deny.R]\npaths = ["*.py"]\n')})
    told = lambda **budget: {r.check_id: (r.outcome, r.coverage, r.reason_codes) for r in gate.gate(files, rules, records, "2026-01-01", **budget)["results"].collect()}
    exhausted = ("INCONCLUSIVE", "PARTIAL", ["budget_exhausted"])
    free, tight, calls = told(most_entities=3, most_calls=1), told(most_entities=2), told(most_calls=0)
    assert free["grounding"][0] == free["contract"][0] == "FAIL"
    assert [tight[c] for c in ("grounding", "deletion", "contract", "semantic")] == [exhausted] * 4 and tight["security"][0] == "PASS"
    assert calls["contract"] == exhausted and calls["grounding"] == free["grounding"]
