"""Policies, code owners and cases."""

from __future__ import annotations

import json
import re
import tomllib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.names import glob_regex, validate_glob

RULES = "run_id string, section string, rule_id string, patterns array<string>, regexes array<string>, detail string"
SYMBOL_SECTIONS = frozenset("deny_symbol public_api entrypoints".split())
RECORDS = "run_id string, record_no int, record_id string, kind string, check_id string, defect_id string, reason_code string, fingerprint string, paths array<string>, symbols array<string>, created string, expires string, approved_by string, reason string"
SECTIONS = frozenset("version policy path_classes deny public_api entrypoints secrets taint forbidden_calls protected_guards protected_errors waivers acceptances review deadline".split())
#: Days that an acceptance or waiver may last.
LONGEST = 180


class PolicyError(ValueError):
    code = "invalid_policy"


def _globs(values: object, what: str) -> list[str]:
    if not isinstance(values, list) or not all(isinstance(v, str) and validate_glob(v) for v in values):
        raise PolicyError(f"{what}: a list of globs is needed")
    return values


def _day(value: object, what: str) -> str:
    if isinstance(value, date):
        return value.isoformat()
    try:
        return date.fromisoformat(str(value)).isoformat()
    except ValueError as e:
        raise PolicyError(f"{what}: {e}") from None


def parse_policy(text: bytes) -> dict:
    """A policy, checked: known sections only, well-formed globs, dated records."""
    try:
        raw = tomllib.loads(text.decode("utf-8"))
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise PolicyError(str(e)) from None
    if unknown := raw.keys() - SECTIONS:
        raise PolicyError(f"unknown sections: {sorted(unknown)}")
    for name, values in raw.get("path_classes", {}).items():
        _globs(values, f"path_classes.{name}")
    for section in ("deny", "protected_guards", "protected_errors"):
        for rule, body in raw.get(section, {}).items():
            _globs(body.get("paths", []), f"{section}.{rule}.paths")
    for kind in ("waivers", "acceptances"):
        seen = set()
        for record in raw.get(kind, []):
            created, expires = _day(record.get("created"), kind), _day(record.get("expires"), kind)
            if not 0 <= (date.fromisoformat(expires) - date.fromisoformat(created)).days <= LONGEST:
                raise PolicyError(f"{kind}: it lasts longer than {LONGEST} days, or ends before it starts")
            if kind == "waivers" and not re.fullmatch(r"sha256:[0-9a-f]{64}", record.get("fingerprint", "")):
                raise PolicyError("waivers: no fingerprint")
            if not record.get("id") or record["id"] in seen:
                raise PolicyError(f"{kind}: ids are needed, once each")
            seen.add(record["id"])
            record |= {"created": created, "expires": expires}
    return raw


def policy_tables(spark: SparkSession, policies: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(rules, records) of parsed policies by run."""
    rules, records = [], []
    for run, p in policies.items():
        for name, values in p.get("path_classes", {}).items():
            rules.append((run, "path_class", name, values, None))
        for rule, body in p.get("deny", {}).items():
            rules.append((run, "deny_path", rule, body.get("paths", []), body.get("reason")))
            rules.append((run, "deny_symbol", rule, body.get("symbols", []), body.get("reason")))
        for section in ("public_api", "entrypoints"):
            rules.append((run, section, section, p.get(section, {}).get("symbols", []), None))
        rules.append((run, "secret_allow", "allow", p.get("secrets", {}).get("allowlist_paths", []), None))
        for rule, body in p.get("forbidden_calls", {}).items():
            rules.append((run, "forbidden_call", rule, body.get("symbols", []), body.get("reason")))
        taint = p.get("taint", {})
        rules.append((run, "taint_source", "sources", list(taint.get("sources", [])), None))
        rules.append((run, "taint_sink", "sinks", list(taint.get("sinks", [])), None))
        for section in ("protected_guards", "protected_errors"):
            for rule, body in p.get(section, {}).items():
                rules.append((run, section, rule, body.get("paths", []), json.dumps(body.get("effects", body.get("raises", [])))))
        for kind in ("waivers", "acceptances"):
            for k, r in enumerate(p.get(kind, [])):
                records.append((run, k, r["id"], kind, r.get("check"), r.get("defect_id"), r.get("reason_code"), r.get("fingerprint"), r.get("paths", []), r.get("symbols", []), r["created"], r["expires"], r.get("approved_by"), r.get("reason")))
    regex = lambda section, globs: [glob_regex(g, "symbol" if section in SYMBOL_SECTIONS else "path") for g in globs]
    rules = [(run, section, rule, list(globs), regex(section, globs), detail) for run, section, rule, globs, detail in rules]
    return spark.createDataFrame(rules, RULES), spark.createDataFrame(records, RECORDS)


def parse_codeowners(text: str) -> list[tuple[int, str, list[str]]]:
    """(index, glob, owners) of each rule. Patterns with negation, classes or escapes are refused."""
    out = []
    for line in text.splitlines():
        line = line.split(" #", 1)[0].strip()
        if not line or line.startswith("#"):
            continue
        pattern, *owners = line.split()
        if re.search(r"[!\[\]\\]", pattern):
            raise PolicyError(f"unsupported pattern: {pattern}")
        anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
        glob = pattern.strip("/") + ("/**" if pattern.endswith("/") else "")
        out.append((len(out), glob if anchored else "**" if pattern == "*" else f"**/{glob}", owners))
    return out


def owners_of(paths: DataFrame, rules: list[tuple[int, str, list[str]]], path: str = "path") -> DataFrame:
    """The last rule that covers each path, with its owners; a folder's rule covers what is in it."""
    fits = [F.when(F.col(path).rlike(f"{glob_regex(g)[:-1]}(/.*)?$") | (F.lit(g.startswith("**/")) & F.col(path).rlike(f"{glob_regex(g.removeprefix('**/'))[:-1]}(/.*)?$")), F.struct(F.lit(i).alias("rule"), F.array(*map(F.lit, o)).cast("array<string>").alias("owners"))) for i, g, o in rules]
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<rule:int,owners:array<string>>")
    return paths.withColumn("_owned", best).select("*", F.col("_owned.rule").alias("rule"), F.col("_owned.owners").alias("owners")).drop("_owned")


def read_cases(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(cases, repeated ids) of a JSON Lines corpus."""
    cases = spark.read.schema(schema).json(path)
    return cases, cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
