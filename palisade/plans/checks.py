"""The five checks over snapshots of many runs at once.

Each check returns findings and gaps as rows; run_id is part of every key, so one
job gates any number of changes. Rules are joined by run with their patterns as
residual; the planner sends them to all tasks where they are few.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import names, text
from palisade.functions.modules import imported_module, module_of
from palisade.operators import hunks as hunk_ops
from palisade.operators import references, snapshots
from palisade.operators.tables import settle
from palisade.sources import diffs, facts

FINDING = ["run_id", "check_id", "defect_id", "reason_code", "path", "symbol", "line", "evidence_kind", "identity", "message"]
GAP = ["run_id", "check_id", "reason_code", "path", "symbol", "detail"]
CHECKS = ("grounding", "deletion", "contract", "semantic", "security")
# Reason code and evidence kind of each defect.
DEFECTS = {
    "GRD-UNGROUNDED-EDIT": ("policy_prohibited", "provenance"),
    "DEL-REACHABLE-SYMBOL": ("symbol_live", "reference"),
    "DEL-DANGLING-REFERENCE": ("dangling_reference", "reference"),
    "DEL-DYNAMIC-REFERENCE": ("dynamic_reference_removed", "reference"),
    "CTR-SIGNATURE-BREAK": ("signature_break", "call_site"),
    "CTR-EXPORT-BREAK": ("export_break", "reference"),
    "CTR-CALL-INCOMPATIBLE": ("call_incompatible", "call_site"),
    "SEM-GUARD-REMOVED": ("guard_removed", "solver"),
    "SEM-GUARD-WEAKENED": ("guard_weakened", "solver"),
    "SEM-GUARD-INVERTED": ("guard_inverted", "solver"),
    "SEM-BINDING-SWAP": ("binding_swap", "solver"),
    "SEM-EXCEPTION-REMOVED": ("exception_removed", "solver"),
    "SEC-SECRET": ("secret_detected", "secret_validation"),
    "SEC-SECRET-TO-SINK": ("secret_to_sink", "taint_path"),
    "SEC-TAINT-TO-SINK": ("taint_to_sink", "taint_path"),
    "SEC-DANGEROUS-CALL": ("dangerous_call", "call_site"),
}
# Endings of code files, analysable or not.
CODE_ENDINGS = ("py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "go", "rs", "java", "kt", "kts", "c", "cc", "cpp", "cxx", "h", "hpp", "cs", "rb", "php", "swift", "scala", "lua", "ex", "exs", "erl", "hrl")
SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")
BUILTINS = tuple(sorted(n for n in dir(__builtins__ if not isinstance(__builtins__, dict) else __import__("builtins")) if n[0].islower()))


def finding(rows: DataFrame, check: str, defect: Column | str, path: Column, symbol: Column, line: Column, identity: Column, message: Column) -> DataFrame:
    d = F.lit(defect) if isinstance(defect, str) else defect
    code = F.create_map(*[F.lit(x) for k, (c, _) in DEFECTS.items() for x in (k, c)])
    kind = F.create_map(*[F.lit(x) for k, (_, e) in DEFECTS.items() for x in (k, e)])
    return rows.select("run_id", F.lit(check).alias("check_id"), d.alias("defect_id"), F.try_element_at(code, d).alias("reason_code"), path.alias("path"), symbol.alias("symbol"), line.cast("int").alias("line"), F.try_element_at(kind, d).alias("evidence_kind"), F.to_json(identity).alias("identity"), message.alias("message"))


def gap(rows: DataFrame, check: Column | str, code: Column | str, path: Column, symbol: Column, detail: Column) -> DataFrame:
    return rows.select("run_id", (F.lit(check) if isinstance(check, str) else check).alias("check_id"), (F.lit(code) if isinstance(code, str) else code).alias("reason_code"), path.alias("path"), symbol.alias("symbol"), detail.cast("string").alias("detail"))


def union(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


class Change:
    """The tables of a set of runs. files: run_id, side, path, blob_id, content. rules: as policies gives them."""

    def __init__(self, files: DataFrame, rules: DataFrame):
        self.files, self.rules = files, rules
        code = names.path_suffix(F.col("path")).isin(*CODE_ENDINGS)
        self.facts = settle(facts.source_facts(files.where(code)))
        self.entries = settle(diffs.diff_entries(files))
        self.hunks = settle(diffs.hunks(self.entries))

    def side(self, side: str) -> DataFrame:
        return self.facts.where(F.col("side") == side)

    @functools.cache  # noqa: B019  one object lives for one gate
    def entities(self, side: str) -> DataFrame:
        e = self.side(side).select("run_id", "path", F.posexplode("entities").alias("entity_no", "e"))
        return settle(e.select("run_id", "path", "entity_no", "e.*"))

    def calls(self, side: str = "head") -> DataFrame:
        c = self.side(side).select("run_id", "path", "language", F.posexplode("calls").alias("call_no", "c"))
        return c.select("run_id", "path", "language", "call_no", "c.*")

    def imports(self, side: str) -> DataFrame:
        i = self.side(side).select("run_id", "path", F.posexplode("imports").alias("imp_no", "i"))
        return i.select("run_id", "path", "imp_no", "i.*").withColumn("target", imported_module(F.col("module"), F.col("path"), F.col("level")))

    def matching(self, rows: DataFrame, section: str, value: str) -> DataFrame:
        """rows with rule_id of each rule of a section that fits; one row for each."""
        r = self.rules.where(F.col("section") == section).select(F.col("run_id").alias("_run"), "rule_id", "regexes")
        return rows.join(r, (F.col("run_id") == F.col("_run")) & F.expr(f"exists(regexes, g -> {value} rlike g)")).drop("_run", "regexes")

    def without(self, rows: DataFrame, classes: list[str], path: str = "path") -> DataFrame:
        """rows whose path is of none of the classes."""
        r = self.rules.where((F.col("section") == "path_class") & F.col("rule_id").isin(*classes)).select(F.col("run_id").alias("_run"), "regexes")
        return rows.join(r, (F.col("run_id") == F.col("_run")) & F.expr(f"exists(regexes, g -> {path} rlike g)"), "left_anti")

    @functools.cached_property
    def changed_lines(self) -> DataFrame:
        here = self.hunks.join(self.entries.where("status <> 'deleted'").select("run_id", "path"), ["run_id", "path"])
        return settle(hunk_ops.changed_lines(here, ["run_id", "path"], "new_start", "new_count"))

    @functools.cached_property
    def mapped(self) -> DataFrame:
        """(run_id, path, hunk_no, qname, change) of each hunk; qname is null if it maps to nothing."""
        keys = ["run_id", "path", "hunk_no"]

        def inner(side: str, start: str, count: str) -> DataFrame:
            e = self.entities(side).select("run_id", "path", "entity_no", "qname", "start_line", "end_line")
            found = hunk_ops.innermost(hunk_ops.overlaps(self.hunks, e, ["run_id", "path"], start, count), keys)
            return found.select(*keys, F.col("innermost").alias(side), F.col("conflict").alias(f"{side}_conflict"))

        h = self.hunks.join(inner("base", "old_start", "old_count"), keys, "left").join(inner("head", "new_start", "new_count"), keys, "left")
        names_of = lambda side, c: self.entities(side).select(F.col("run_id").alias(f"_{c}r"), F.col("qname").alias(f"_{c}q")).distinct()
        h = h.join(names_of("base", "b"), (F.col("run_id") == F.col("_br")) & (F.col("head") == F.col("_bq")), "left").join(names_of("head", "h"), (F.col("run_id") == F.col("_hr")) & (F.col("base") == F.col("_hq")), "left")
        conflict = F.coalesce("base_conflict", F.lit(False)) | F.coalesce("head_conflict", F.lit(False))
        # Beside entities, only lines of plain declarations may change.
        for side in ("base", "head"):
            h = h.join(self.side(side).select("run_id", "path", F.col("unsafe").alias(f"{side}_unsafe")), ["run_id", "path"], "left")
        met = hunk_ops.touches(F.col("base_unsafe"), F.col("old_start"), F.col("old_count")) | hunk_ops.touches(F.col("head_unsafe"), F.col("new_start"), F.col("new_count"))
        safe = ~conflict & ~met & ((F.col("old_count") > 0) | (F.col("new_count") > 0))
        change = hunk_ops.classify(F.col("base"), F.col("head"), F.col("new_count"), F.col("_bq").isNotNull(), F.col("_hq").isNotNull(), safe)
        return settle(h.select(*keys, F.when(~conflict, F.coalesce("head", "base")).alias("qname"), F.when(conflict, "mapping_unresolved").otherwise(change).alias("change")))

    @functools.cached_property
    def changed(self) -> DataFrame:
        """(run_id, path, qname): entities that hunks change, and all of files that came, went or moved."""
        whole = self.entries.where("status in ('added', 'deleted', 'renamed')").select("run_id", "path")
        every = union(*[self.entities(s).select("run_id", "path", "qname") for s in ("base", "head")]).distinct()
        by_hunk = self.mapped.where("qname is not null and change <> 'mapping_unresolved'").select("run_id", "path", "qname")
        gone = self.removed.select("run_id", "path", "qname")  # also where a hunk spans several entities
        return settle(by_hunk.union(every.join(whole, ["run_id", "path"]).select("run_id", "path", "qname")).union(gone).distinct())

    @functools.cached_property
    def removed(self) -> DataFrame:
        gone = snapshots.removed(self.entities("base"), self.entities("head"), ["run_id", "qname"])
        return settle(self.without(gone, ["generated", "vendored"]).withColumn("module", module_of(F.col("path"))))

    def scope_gaps(self, check: str) -> DataFrame:
        """Changed code that has no facts: languages without a reader, and parse errors."""
        e = self.entries.select("run_id", "path").join(self.facts.groupBy("run_id", "path").agg(F.max_by(F.struct("language", "supported", "parse_error"), F.when(F.col("side") == "head", 1).otherwise(0)).alias("f")), ["run_id", "path"])
        e = e.where("not f.supported or f.parse_error is not null")
        code = F.when(~F.col("f.supported"), "unsupported_language").when(F.startswith("f.parse_error", F.lit("parse_resource_limit")), "parse_resource_limit").otherwise("parse_error")
        return gap(e, check, code, F.col("path"), F.lit(None).cast("string"), F.coalesce("f.parse_error", "f.language"))


def grounding(c: Change) -> tuple[DataFrame, DataFrame]:
    """Edits that policy prohibits, by path and by symbol; hunks that map to nothing are gaps."""
    paths = c.matching(c.entries.select("run_id", "path"), "deny_path", "path").groupBy("run_id", "path").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    symbols = c.matching(c.changed, "deny_symbol", "qname").groupBy("run_id", "path", "qname").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    null = F.lit(None).cast("string")

    def found(rows, symbol, kind):
        identity = F.struct(F.array_min("rules").alias("primary_rule_id"), F.col("rules").alias("matched_rule_ids"), F.lit(kind).alias("matched_kind"))
        return finding(rows, "grounding", "GRD-UNGROUNDED-EDIT", F.col("path"), symbol, F.lit(1), identity, F.concat(F.lit("policy prohibits this edit: "), F.array_join("rules", ", ")))

    unresolved = c.without(c.mapped.where("change = 'mapping_unresolved'"), ["generated", "vendored"])
    unresolved = unresolved.join(c.side("head").where("supported and parse_error is null").select("run_id", "path").distinct(), ["run_id", "path"], "left_semi")
    return union(found(paths, null, "path"), found(symbols, F.col("qname"), "symbol")), union(c.scope_gaps("grounding"), gap(unresolved, "grounding", "mapping_unresolved", F.col("path"), null, F.col("hunk_no")))


def deletion(c: Change) -> tuple[DataFrame, DataFrame]:
    """Removed symbols that are public or still referenced, dangling imports and calls, dynamic lookups."""
    removed = c.removed
    head_imports = c.imports("head").withColumn("name", F.explode("names"))
    in_init = head_imports.where("path like '%__init__.py'").select("run_id", "name").distinct().withColumn("in_init", F.lit(True))
    exports = c.side("base").select("run_id", "path", F.explode("exports").alias("name")).distinct().withColumn("in_all", F.lit(True))
    declared = union(*[c.matching(removed, s, "qname").select("run_id", "qname") for s in ("public_api", "entrypoints")]).distinct().withColumn("declared", F.lit(True))
    r = removed.join(in_init, ["run_id", "name"], "left").join(exports, ["run_id", "path", "name"], "left").join(declared, ["run_id", "qname"], "left")
    python = F.endswith("path", F.lit(".py"))
    public = F.coalesce("declared", F.lit(False)) | F.when(python, F.coalesce("in_all", F.lit(False)) | F.coalesce("in_init", F.lit(False))).otherwise(F.col("is_export"))
    r = r.withColumn("public", public)
    # Live references: calls by name in the symbol's own file or in files that import it from its module, and those imports.
    imported = head_imports.select("run_id", F.col("target").alias("module"), "name", F.col("path").alias("from_path"), F.col("line").alias("at")).where("module is not null")
    uses = r.select("run_id", "qname", "module", "name", "path", "public")
    by_import = uses.join(imported, ["run_id", "module", "name"]).select("run_id", "qname", F.col("from_path").alias("ref_path"), F.col("at").alias("ref_line"), F.lit("import").alias("ref_kind"))
    called = c.calls().select("run_id", F.col("path").alias("ref_path"), F.col("line").alias("ref_line"), F.substring_index("callee", ".", -1).alias("name"))
    files = union(uses.select("run_id", "qname", "name", F.col("path").alias("ref_path")), uses.join(imported, ["run_id", "module", "name"]).select("run_id", "qname", "name", F.col("from_path").alias("ref_path"))).distinct()
    by_call = files.join(called, ["run_id", "name", "ref_path"]).select("run_id", "qname", "ref_path", "ref_line", F.lit("call").alias("ref_kind"))
    first = references.first_reference(by_call.union(by_import), ["run_id", "qname"], ["ref_path", "ref_line", "ref_kind"])
    live = r.where("public").join(first, ["run_id", "qname"], "left")
    identity = F.struct("qname", "ref_path", "ref_kind")
    reachable = finding(live, "deletion", "DEL-REACHABLE-SYMBOL", F.col("path"), F.col("qname"), F.coalesce("ref_line", "start_line"), identity, F.concat(F.lit("removed symbol is still reachable: "), F.col("qname")))
    # Dangling imports of Python files: a name, or a submodule, that base had and head has not.
    asks = head_imports.where("path like '%.py' and path not like '%__init__.py' and name <> '' and name <> '*'")
    has_module = lambda side: c.side(side).select("run_id", module_of(F.col("path")).alias("target")).distinct()
    known = asks.join(has_module("base"), ["run_id", "target"], "left_semi")
    sub = known.withColumn("sub", F.concat_ws(".", F.when(F.col("target") != "", F.col("target")), "name"))
    subs = lambda side: has_module(side).withColumnRenamed("target", "sub")
    lost_module = sub.join(subs("base"), ["run_id", "sub"], "left_semi").join(subs("head"), ["run_id", "sub"], "left_anti")
    ordinary = sub.join(subs("base"), ["run_id", "sub"], "left_anti")
    base_names = c.entities("base").select("run_id", "name", module_of(F.col("path")).alias("target"), "qname")
    # A package hands on what its __init__ imports.
    handed = c.imports("base").where("path like '%__init__.py'").withColumn("name", F.explode("names")).select("run_id", module_of(F.col("path")).alias("target"), "name", F.col("target").alias("origin"))
    handed = handed.join(base_names.select("run_id", "name", F.col("target").alias("origin"), "qname"), ["run_id", "name", "origin"]).select("run_id", "name", "target", "qname")
    handed = handed.join(base_names.select("run_id", "name", "target").distinct(), ["run_id", "name", "target"], "left_anti")
    lost = union(base_names, handed).join(removed.select("run_id", "qname").distinct(), ["run_id", "qname"], "left_semi")
    lost_name = ordinary.join(lost.select("run_id", "name", "target").distinct(), ["run_id", "name", "target"], "left_semi")
    dangling_import = union(*[x.select("run_id", "path", "name", "line", F.lit("import").alias("kind")) for x in (lost_module, lost_name)])
    own = removed.select("run_id", "path", "name").distinct()
    calls = c.calls().where("path not like '%__init__.py'").withColumn("name", F.substring_index("callee", ".", -1)).join(own, ["run_id", "path", "name"], "left_semi")
    calls = calls.join(r.where("public").select("run_id", "path", "name").distinct(), ["run_id", "path", "name"], "left_anti").join(dangling_import.select("run_id", "path", "name").distinct(), ["run_id", "path", "name"], "left_anti")
    calls = calls.groupBy("run_id", "path", "name").agg(F.min("line").alias("line"), F.lit("call").alias("kind"))
    dangles = dangling_import.union(calls.select("run_id", "path", "name", "line", "kind"))
    dangling = finding(dangles, "deletion", "DEL-DANGLING-REFERENCE", F.col("path"), F.col("name"), F.col("line"), F.struct("path", "name", "kind"), F.concat(F.lit("head uses what it no longer defines: "), F.col("name")))
    # Dynamic lookups of a removed name in changed files.
    lines = _head_lines(c).join(c.entries.select("run_id", "path"), ["run_id", "path"], "left_semi").where("line not like '%__all__%'")
    literal = F.regexp_extract_all("line", F.lit(r"(?:getattr\s*\(\s*[^,()]+,\s*|\[\s*)['\"]([A-Za-z_]\w*)['\"]"), F.lit(1))
    looked = lines.select("run_id", F.col("path").alias("at_path"), "line_no", F.explode(F.array_distinct(literal)).alias("name"))
    dynamic = removed.select("run_id", "path", "qname", "name").join(looked, ["run_id", "name"])
    by_lookup = finding(dynamic, "deletion", "DEL-DYNAMIC-REFERENCE", F.col("path"), F.col("qname"), F.col("line_no"), F.struct("qname", "at_path"), F.concat(F.lit("removed symbol is looked up by name: "), F.col("qname")))
    # Gaps, where something was removed.
    had = removed.select("run_id").distinct()
    null = F.lit(None).cast("string")
    lost_way = asks.where("target is not null").join(has_module("base"), ["run_id", "target"], "left_anti")
    unknown = union(*[x.select("run_id", "path") for x in (asks.where("target is null"), lost_way)]).distinct().join(had, "run_id", "left_semi")
    unknown = unknown.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))
    proven = dynamic.select("run_id", F.col("at_path").alias("path")).distinct()
    shifty = c.side("head").where("dynamic").select("run_id", "path").join(proven, ["run_id", "path"], "left_anti").join(had, "run_id", "left_semi").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))
    gaps = union(c.scope_gaps("deletion"), gap(unknown, "deletion", "mapping_unresolved", null, null, F.col("paths")), gap(shifty, "deletion", "dynamic_target_unresolved", null, null, F.col("paths")))
    return union(reachable, dangling, by_lookup), gaps


def _head_lines(c: Change) -> DataFrame:
    t = c.files.where("side = 'head'").join(c.entries.where("not is_binary").select("run_id", "path"), ["run_id", "path"], "left_semi")
    return t.select("run_id", "path", F.posexplode(text.lines_of(F.make_valid_utf8(F.col("content").cast("string")))).alias("k", "line")).select("run_id", "path", (F.col("k") + 1).alias("line_no"), "line")


def _resolved(calls: DataFrame, c: Change) -> DataFrame:
    """calls joined with candidate entities (t_*), with how the callee resolves: MATCH, NO_MATCH or AMBIGUOUS.

    The first import, in order, that binds the called name or its receiver decides.
    """
    aliases = c.imports("head").select("run_id", "path", "imp_no", "target", F.posexplode("aliases").alias("alias_no", "a"))
    bind = aliases.groupBy("run_id", "path", F.col("a.local").alias("local")).agg(F.min_by(F.struct("target", F.col("a.orig").alias("orig")), F.struct("imp_no", "alias_no")).alias("imp"))
    head = F.when(F.contains("callee", F.lit(".")), F.regexp_replace("callee", r"\.[^.]*$", "")).otherwise(F.col("callee"))
    calls = calls.withColumn("local", head).join(bind, ["run_id", "path", "local"], "left")
    keyed = calls.withColumn("keys", F.array_distinct(F.array_compact(F.array(F.substring_index("callee", ".", -1), F.when(~F.contains("callee", F.lit(".")), F.substring_index("imp.orig", ".", -1))))))
    return keyed


def _match(c_path: str = "path") -> Column:
    """Resolution of a call (callee, imp, shadowed, local_def) against t_path, t_module, t_name, t_symbol."""
    same = F.col(c_path) == F.col("t_path")
    bound = F.col("imp").isNotNull()
    right = F.coalesce(F.col("imp.target") == F.col("t_module"), F.lit(False))
    named = (F.col("imp.orig") == F.col("t_symbol")) | (F.col("imp.orig") == F.col("t_name"))
    equal = F.col("callee") == F.col("t_name")
    plain_same = F.when(F.col("shadowed"), "NO_MATCH").when(bound & ~right, "NO_MATCH").when(equal, "MATCH").otherwise("NO_MATCH")
    plain_other = F.when(bound, F.when(right & named, "MATCH").otherwise("NO_MATCH")).when(F.col("local_def") | F.col("callee").isin(*BUILTINS), "NO_MATCH").when(equal, "AMBIGUOUS").otherwise("NO_MATCH")
    own = F.col("local").isin("self", "cls", "this")
    dotted = F.when(F.substring_index("callee", ".", -1) != F.col("t_name"), "NO_MATCH").when(own, F.when(same, "MATCH").otherwise("NO_MATCH")).when(bound, F.when(right | F.coalesce(F.concat_ws(".", "imp.target", "imp.orig") == F.col("t_module"), F.lit(False)), "MATCH").otherwise("NO_MATCH")).otherwise("AMBIGUOUS")
    return F.when(F.contains("callee", F.lit(".")), dotted).when(same, plain_same).otherwise(plain_other)


def _signature(e: str) -> dict[str, Column]:
    p = lambda *kinds: F.filter(f"{e}", lambda x: x["kind"].isin(*kinds))
    required = lambda *kinds: F.filter(f"{e}", lambda x: x["kind"].isin(*kinds) & ~x["has_default"])
    return {
        "required": F.size(required("posonly", "positional")),
        "most": F.size(p("posonly", "positional")),
        "vararg": F.size(p("vararg")) > 0,
        "kwarg": F.size(p("kwarg")) > 0,
        "keywords": F.transform(p("positional", "kwonly"), lambda x: x["name"]),
        "needed": F.transform(required("kwonly"), lambda x: x["name"]),
    }


def _problem(params: str) -> Column:
    s = _signature(params)
    script = F.col("language") != "python"
    unknown = ~script & (F.size(F.array_except("keywords", s["keywords"])) > 0)
    missing = ~script & (F.size(F.array_except(s["needed"], F.col("keywords"))) > 0)
    most = F.when(s["vararg"], 2**31 - 1).otherwise(s["most"])
    return references.call_problem(F.col("positional"), s["required"], most, unknown, missing, F.col("star") | F.col("kwargs"), s["kwarg"])


def contract(c: Change) -> tuple[DataFrame, DataFrame]:
    """Signatures that changed incompatibly, public symbols that went, and calls that no longer fit."""
    cols = lambda side, p: c.entities(side).select("run_id", "qname", *[F.col(x).alias(f"{p}_{x}") for x in ("path", "name", "params", "is_async", "is_export", "start_line")])
    both = c.changed.select("run_id", "qname").distinct().join(cols("base", "b"), ["run_id", "qname"], "left").join(cols("head", "t"), ["run_id", "qname"], "left")
    old, new = _signature("b_params"), _signature("t_params")
    flags = {
        "async_changed": F.col("b_is_async") != F.col("t_is_async"),
        "required_positional_parameters_added": new["required"] > old["required"],
        "varargs_removed": old["vararg"] & ~new["vararg"],
        "kwargs_removed": old["kwarg"] & ~new["kwarg"],
        "keyword_parameters_removed": F.size(F.array_except(old["keywords"], new["keywords"])) > 0,
    }
    kept = both.where("b_path is not null and t_path is not null and (b_params <> t_params or b_is_async <> t_is_async)")
    kept = kept.withColumn("problems", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))).withColumns({"t_module": module_of(F.col("t_path")), "t_symbol": F.substring_index("qname", ":", -1)})
    declared = c.matching(c.changed, "public_api", "qname").select("run_id", "qname").distinct().withColumn("declared", F.lit(True))
    kept = kept.join(declared, ["run_id", "qname"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))
    local = c.entities("head").select("run_id", "path", F.col("name").alias("callee")).distinct().withColumn("local_def", F.lit(True))
    calls = _resolved(c.calls(), c).join(local, ["run_id", "path", "callee"], "left").withColumn("local_def", F.coalesce("local_def", F.lit(False)))
    each = calls.withColumn("t_name", F.explode("keys"))
    met = each.join(kept, ["run_id", "t_name"]).withColumn("match", _match())
    hit = met.where("match = 'MATCH'").dropDuplicates(["run_id", "path", "call_no", "qname"]).withColumn("problem", F.coalesce(_problem("t_params"), F.when(~F.col("star") & ~F.col("kwargs") & F.array_contains("problems", "async_changed"), "async_changed")))
    called = hit.select("run_id", "qname").distinct().withColumn("called", F.lit(True))
    broken = kept.join(called, ["run_id", "qname"], "left").where((F.size("problems") > 0) & (F.col("declared") | (F.col("called").isNull() & F.col("t_is_export") & ~F.startswith("t_name", F.lit("_")))))
    by_signature = finding(broken, "contract", "CTR-SIGNATURE-BREAK", F.col("t_path"), F.col("qname"), F.col("t_start_line"), F.struct("qname", "problems"), F.concat(F.lit("signature changed incompatibly: "), F.array_join("problems", ", ")))
    at_call = hit.where("problem is not null and not (declared and size(problems) > 0)")
    by_call = finding(at_call, "contract", "CTR-SIGNATURE-BREAK", F.col("path"), F.col("qname"), F.col("line"), F.struct("qname", "callee", "problem"), F.concat(F.lit("call no longer fits: "), F.col("problem")))
    gone = both.where("b_path is not null and t_path is null").join(declared, ["run_id", "qname"], "left_semi")
    by_export = finding(gone, "contract", "CTR-EXPORT-BREAK", F.col("b_path"), F.col("qname"), F.col("b_start_line"), F.struct("qname"), F.concat(F.lit("public symbol was removed: "), F.col("qname")))
    # Changed calls of entities that did not change.
    still = c.entities("base").join(c.changed.select("run_id", "qname").distinct(), ["run_id", "qname"], "left_anti").select("run_id", "qname", F.col("name").alias("t_name"), F.col("path").alias("t_path"), F.col("params").alias("t_params"), module_of(F.col("path")).alias("t_module"), F.substring_index("qname", ":", -1).alias("t_symbol"))
    fresh = each.join(c.changed_lines, ["run_id", "path", "line"], "left_semi")
    met2 = fresh.where("not star and not kwargs").join(still, ["run_id", "t_name"]).withColumn("match", _match())
    hit2 = met2.where("match = 'MATCH'").withColumn("problem", _problem("t_params")).groupBy("run_id", "path", "call_no", "line", "callee").agg(F.min_by("problem", "qname").alias("problem"), F.min("qname").alias("qname")).where("problem is not null")
    by_change = finding(hit2, "contract", "CTR-CALL-INCOMPATIBLE", F.col("path"), F.col("qname"), F.col("line"), F.struct("qname", "callee", "problem"), F.concat(F.lit("call does not fit: "), F.col("problem")))
    found2 = met2.where("match = 'MATCH'").select("run_id", "path", "call_no").distinct()
    vague2 = met2.where("match = 'AMBIGUOUS'").join(found2, ["run_id", "path", "call_no"], "left_anti")
    spread = union(fresh.where("star or kwargs").select("run_id", "path", "callee", "line"), hit.where("star or kwargs").select("run_id", "path", "callee", "line")).distinct()
    vague = union(met.where("match = 'AMBIGUOUS'").select("run_id", "path", "callee", "line"), vague2.select("run_id", "path", "callee", "line")).distinct()
    order = kept.where("size(problems) = 0 and b_is_async = t_is_async and array_sort(b_params) = array_sort(t_params)").select("run_id", F.col("t_path").alias("path"), F.col("qname").alias("callee"), F.lit("parameter_order_changed").alias("line"))
    decorated = c.side("head").where("unknown_decorator and size(entities) > 0 and supported and parse_error is null").join(c.entries.select("run_id", "path"), ["run_id", "path"], "left_semi")
    null = F.lit(None).cast("string")
    gaps = union(
        c.scope_gaps("contract"),
        gap(spread, "contract", "dynamic_call", F.col("path"), F.col("callee"), F.col("line")),
        gap(vague, "contract", "dynamic_target_unresolved", F.col("path"), F.col("callee"), F.col("line")),
        gap(order, "contract", "dynamic_target_unresolved", F.col("path"), F.col("callee"), F.col("line")),
        gap(decorated, "contract", "unknown_decorator", F.col("path"), null, null),
    )
    return union(by_signature, by_call, by_export, by_change), gaps


def _in_python() -> Column:
    return F.endswith("path", F.lit(".py"))


def _bound(c: Change) -> DataFrame:
    """(run_id, path, local, target): what the names mean that a Python file's imports bind; the last import decides."""
    a = c.imports("head").where(_in_python()).select("run_id", "path", "imp_no", "module", F.posexplode("aliases").alias("alias_no", "a")).select("run_id", "path", "imp_no", "alias_no", "module", "a.*")
    # An imported module has its own name for an origin; without another name for it nothing is bound anew.
    whole = F.col("orig") == F.col("module")
    a = a.where(~(whole & (F.col("local") == F.col("orig"))) & F.col("local").rlike(r"^\w+$"))
    target = F.when(whole | (F.col("module") == ""), F.col("orig")).otherwise(F.concat_ws(".", "module", "orig"))
    return a.groupBy("run_id", "path", "local").agg(F.max_by(target, F.struct("imp_no", "alias_no")).alias("target"))


def _sinks(lines: DataFrame, c: Change) -> DataFrame:
    """The lines with a call that a secret must not reach, aliased loggers included."""
    logs = F.contains(F.lower("target"), F.lit("log")) | F.col("target").isin("print", "requests.post", "requests.get", "cursor.execute")
    loggers = _bound(c).where(logs).groupBy("run_id", "path").agg(F.array_join(F.collect_set("local"), "|").alias("loggers"))
    by_alias = F.rlike("line", F.concat(F.lit(r"\b("), F.col("loggers"), F.lit(r")\s*\(")))
    return lines.join(loggers, ["run_id", "path"], "left").where(F.col("line").rlike(text.SECRET_SINK) | F.col("line").rlike(text.TAINT_SINK) | F.coalesce(by_alias, F.lit(False))).drop("loggers")


def security(c: Change) -> tuple[DataFrame, DataFrame]:
    """Secrets, dangerous calls and flows on changed lines."""
    lines = _head_lines(c)
    allow = c.rules.where("section = 'secret_allow'").select(F.col("run_id").alias("_run"), "regexes")
    changed = lines.join(c.changed_lines.withColumnRenamed("line", "line_no"), ["run_id", "path", "line_no"], "left_semi")
    changed = settle(changed)
    scanned = changed.join(allow, (F.col("run_id") == F.col("_run")) & F.expr("exists(regexes, g -> path rlike g)"), "left_anti")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("line", F.lit(f"({rx})"), 1).alias("values")) for k, rx in text.SECRET_PATTERNS.items()])
    each = scanned.select("run_id", "path", "line_no", F.explode(kinds).alias("x")).select("run_id", "path", "line_no", "x.kind", F.posexplode("x.values").alias("at", "value")).withColumn("stand_in", text.is_placeholder(F.col("value")))
    # A token's head must be JSON that names an algorithm; other kinds are valid by their shape.
    head = F.try_to_binary(F.translate(F.substring_index("value", ".", 1), "-_", "+/"), F.lit("base64"))
    padded = F.try_to_binary(F.rpad(F.translate(F.substring_index("value", ".", 1), "-_", "+/"), ((F.char_length(F.substring_index("value", ".", 1)) + 3) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))
    alg = F.get_json_object(F.try_validate_utf8(F.coalesce(head, padded).cast("string")), "$.alg")
    each = each.withColumn("valid", F.when(F.col("kind") == "JWT_TOKEN", alg.isNotNull()).otherwise(True))
    # Every match is judged; the first good one of a kind stands for its line.
    known = each.where("not stand_in and valid").groupBy("run_id", "path", "line_no", "kind").agg(F.min_by("value", "at").alias("value"))
    value = F.btrim(F.trim(F.expr("substr(line, instr(line, '=') + 1)")), F.lit("\"'"))
    plain = scanned.where("line like '%=%'").join(known, ["run_id", "path", "line_no"], "left_anti").where(F.substring_index("line", "=", 1).rlike(text.SECRET_NAME)).withColumn("value", value)
    plain = plain.where((F.char_length("value") >= 16) & ~text.is_placeholder(F.col("value"))).where(text.entropy(F.col("value")) >= 3.5)
    hits = union(known, plain.select("run_id", "path", "line_no", F.lit("high_entropy_assignment").alias("kind"), "value"))
    null = F.lit(None).cast("string")
    secret = finding(hits, "security", "SEC-SECRET", F.col("path"), F.col("kind"), F.col("line_no"), F.struct("kind", text.redact(F.col("value")).alias("redacted")), F.concat(F.lit("secret in a changed line: "), F.col("kind")))
    named = hits.select("run_id", "path", "line_no", "kind").join(lines, ["run_id", "path", "line_no"]).withColumn("name", text.assignment_name(F.col("line")))
    here = _sinks(named, c).select("run_id", "path", "line_no", "kind", F.col("line_no").alias("source_line"))
    sinks = _sinks(lines, c).select("run_id", "path", F.col("line_no").alias("at"), F.col("line").alias("sink"))
    flow = named.where("name is not null").join(sinks, ["run_id", "path"]).where(F.expr(r"at <> line_no and sink rlike concat('(^|[^A-Za-z0-9_])', name, '([^A-Za-z0-9_]|$)')")).select("run_id", "path", F.col("at").alias("line_no"), "kind", F.col("line_no").alias("source_line"))
    flows = here.union(flow).dropDuplicates(["run_id", "path", "line_no", "kind"])
    to_sink = finding(flows, "security", "SEC-SECRET-TO-SINK", F.col("path"), F.col("kind"), F.col("line_no"), F.struct("kind", "source_line"), F.concat(F.lit("secret reaches a sink: "), F.col("kind")))
    # Dangerous calls: by rule on text, and on call sites by the names that a Python file's imports give, over the whole span.
    code = changed.where(names.path_suffix(F.col("path")).isin(*CODE_ENDINGS)).where(~F.startswith(F.ltrim("line"), F.lit("#")) & ~F.startswith(F.ltrim("line"), F.lit("//")))
    rules = F.array_compact(F.array(*[F.when(F.col("line").rlike(rx), F.lit(k)) for k, rx in text.DANGEROUS_CALLS.items()]))
    by_rule = code.select("run_id", "path", "line_no", F.explode(rules).alias("rule_id"))
    spans = c.calls().withColumn("line_no", F.explode(F.sequence("line", "end_line"))).join(changed.select("run_id", "path", "line_no"), ["run_id", "path", "line_no"], "left_semi")
    spans = spans.select("run_id", "path", "call_no", "line", "callee").distinct()
    bound = _bound(c).withColumnRenamed("local", "head")
    spans = spans.withColumn("head", F.substring_index("callee", ".", 1)).join(bound, ["run_id", "path", "head"], "left")
    full = F.when(F.col("target").isNotNull(), F.concat("target", F.expr("substr(callee, length(head) + 1)"))).otherwise(F.col("callee"))
    spans = settle(spans.select("run_id", "path", "line", F.regexp_replace(full, r"^(builtins|__builtin__|__builtins__)\.", "").alias("callee"), _in_python().alias("python")))
    name = F.col("callee")
    rule = F.when(name.isin("eval", "exec", "compile", "os.system", "pickle.loads", "yaml.load"), name).when(F.startswith(name, F.lit("subprocess.")), "subprocess")
    by_name = spans.where("python").withColumn("rule_id", rule).where("rule_id is not null").select("run_id", "path", F.col("line").alias("line_no"), "rule_id")
    own = c.rules.where("section = 'forbidden_call'").select("run_id", "rule_id", F.explode("patterns").alias("symbol"))
    last = lambda x: F.substring_index(F.substring_index(x, ":", -1), ".", -1)
    by_policy = spans.withColumn("last", last("callee")).join(own.withColumn("last", last("symbol")), ["run_id", "last"]).where("python or callee = symbol").select("run_id", "path", F.col("line").alias("line_no"), "rule_id")
    dangerous = finding(by_rule.union(by_name).union(by_policy).distinct(), "security", "SEC-DANGEROUS-CALL", F.col("path"), F.col("rule_id"), F.col("line_no"), F.struct("rule_id"), F.concat(F.lit("dangerous call: "), F.col("rule_id")))
    # Taint: only where the policy names sources and sinks.
    on = c.rules.where("section in ('taint_source', 'taint_sink') and size(patterns) > 0").groupBy("run_id").agg(F.count_distinct("section").alias("n")).where("n = 2").select("run_id")
    marked = code.join(on, "run_id", "left_semi").select("run_id", "path", "line_no", F.col("line").rlike(text.TAINT_SOURCE).alias("source"), F.col("line").rlike(text.TAINT_SINK).alias("sink"))
    taint = finding(marked.where("source and sink"), "security", "SEC-TAINT-TO-SINK", F.col("path"), null, F.col("line_no"), F.struct("path"), F.lit("tainted value reaches a sink"))
    lone = marked.where("source <> sink").select("run_id").distinct()
    doubt = each.where("not stand_in and not valid")
    gaps = union(c.scope_gaps("security"), gap(lone, "security", "taint_path_unresolved", null, null, null), gap(doubt, "security", "secret_candidate_ambiguous", F.col("path"), F.col("kind"), F.col("line_no")))
    return union(secret, to_sink, dangerous, taint), gaps


def semantic(c: Change) -> tuple[DataFrame, DataFrame]:
    """Guards, errors and bindings of changed functions that protect less than before; of scripts, guards."""
    from palisade.plans.semantics import compare

    read = names.path_suffix(F.col("path")).isin("py", *SCRIPTS)
    pairs = c.entries.where("status = 'modified' and not is_binary").where(read).select("run_id", "path", F.col("base_content").alias("base"), F.col("head_content").alias("head"))
    rules = c.rules.where("section in ('protected_guards', 'protected_errors')").groupBy("run_id").agg(F.to_json(F.collect_list(F.struct("section", "rule_id", "regexes", "detail"))).alias("rules"))
    found = pairs.join(rules, "run_id", "left").mapInPandas(compare, "run_id string, path string, kind string, code string, symbol string, line int, identity string")
    found = settle(found)
    null = F.lit(None).cast("string")
    f = found.where("kind = 'finding'")
    findings = finding(f, "semantic", F.col("code"), F.col("path"), F.col("symbol"), F.col("line"), F.struct("identity"), F.concat(F.lit("behaviour of "), F.col("symbol"), F.lit(" protects less than before")))
    return findings, union(c.scope_gaps("semantic"), gap(found.where("kind = 'gap'"), "semantic", F.col("code"), F.col("path"), F.col("symbol"), null))
