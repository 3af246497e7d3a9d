"""The driver's query catalogue: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL.

The tables stand for a repository's: documents are files of two snapshots, part and
lineitem are entities and calls, orders are files, events are findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.functions import canonical, names, stats, text
from palisade.operators import gate, hunks, references, review, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- snapshots: every document is in both, some moved (path), some changed (text)

BASE_SQL = "SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, md5(text) AS blob_id, source, doc_id FROM documents"
HEAD_SQL = "SELECT source || '/' || lang || CASE WHEN doc_id % 5 = 0 THEN '/moved' ELSE '' END || '/doc_' || doc_id || '.txt' AS path, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS blob_id, source, doc_id FROM documents"
DIFF_SQL = f"base AS ({BASE_SQL}), head AS ({HEAD_SQL}), diff AS (SELECT coalesce(b.path, h.path) AS path, b.blob_id AS base_blob, h.blob_id AS head_blob, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted' WHEN b.blob_id <> h.blob_id THEN 'modified' ELSE 'unchanged' END AS status FROM base b FULL OUTER JOIN head h ON b.path = h.path)"


def _path(moved) -> F.Column:
    return F.concat("source", F.lit("/"), "lang", moved, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _base(t: Tables) -> DataFrame:
    return t.documents.select(_path(F.lit("")).alias("path"), F.md5("text").alias("blob_id"), "source", "doc_id")


def _head(t: Tables) -> DataFrame:
    moved = F.when(F.col("doc_id") % 5 == 0, "/moved").otherwise("")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return t.documents.select(_path(moved).alias("path"), F.md5(changed).alias("blob_id"), "source", "doc_id")


def _diff(t: Tables) -> DataFrame:
    return snapshots.snapshot_diff(_base(t), _head(t))


@query(f"""WITH {DIFF_SQL} SELECT split_part(path, '/', 1) AS source, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged,
CASE WHEN count(*) FILTER (status = 'modified') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'deleted') > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM diff GROUP BY 1""")
def q01_snapshot_diff_status(t: Tables) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    out = _diff(t).groupBy(F.substring_index("path", "/", 1).alias("source")).agg(*[count(s).alias(s) for s in ("added", "deleted", "modified", "unchanged")])
    return out.withColumn("verdict", F.when(F.col("modified") > 0, "FAIL").when(F.col("deleted") > 0, "REVIEW").otherwise("PASS"))


@query(f"""WITH {DIFF_SQL}, gone AS (SELECT path AS base_key, base_blob AS blob, row_number() OVER (PARTITION BY base_blob ORDER BY path) AS k FROM diff WHERE status = 'deleted'),
new AS (SELECT path AS head_key, head_blob AS blob, row_number() OVER (PARTITION BY head_blob ORDER BY path) AS k FROM diff WHERE status = 'added') SELECT base_key, head_key, blob FROM gone JOIN new USING (blob, k)""")
def q02_exact_rename_detection(t: Tables) -> DataFrame:
    return snapshots.exact_renames(_diff(t))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem b WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = b.l_orderkey AND h.l_partkey = b.l_partkey AND h.l_returnflag <> 'R') GROUP BY 1, 2")
def q03_removed_entities_anti(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey"]
    return snapshots.removed(t.lineitem, t.lineitem.where("l_returnflag <> 'R'"), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders h WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = h.o_custkey AND b.o_orderstatus <> 'P') GROUP BY 1")
def q04_added_entities_anti(t: Tables) -> DataFrame:
    return snapshots.added(t.orders.where("o_orderstatus <> 'P'"), t.orders, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


# --- hunks: an order is a file, its lines are entities and hunks

ENTITIES_SQL = "SELECT l_orderkey AS path, l_linenumber AS entity_no, 'e' || l_linenumber AS qname, (l_linenumber - 1) * 10 + 1 AS start_line, (l_linenumber - 1) * 10 + 1 + CAST(l_quantity AS INT) AS end_line FROM lineitem"
HUNKS_SQL = "SELECT l_orderkey AS path, l_linenumber AS hunk_no, CAST(l_partkey % 60 AS INT) + 1 AS start, CAST(l_suppkey % 7 AS INT) AS count FROM lineitem"
OVERLAP_SQL = f"e AS ({ENTITIES_SQL}), h AS ({HUNKS_SQL}), o AS (SELECT h.*, e.entity_no, e.qname, e.start_line, e.end_line FROM h JOIN e ON h.path = e.path AND h.count > 0 AND h.start <= e.end_line AND e.start_line <= h.start + h.count - 1)"
INNER_SQL = f"{OVERLAP_SQL}, r AS (SELECT path, hunk_no, qname, coalesce(lag(start_line) OVER w > start_line OR lag(end_line) OVER w < end_line, false) AS apart, row_number() OVER w AS place FROM o WINDOW w AS (PARTITION BY path, hunk_no ORDER BY end_line - start_line DESC, entity_no)), i AS (SELECT path, hunk_no, arg_max(qname, place) AS innermost, bool_or(apart) AS conflict, count(*) AS touched FROM r GROUP BY 1, 2)"


def _entities(t: Tables) -> DataFrame:
    start = (F.col("l_linenumber") - 1) * 10 + 1
    return t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("entity_no"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("qname"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"))


def _hunks(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("hunk_no"), ((F.col("l_partkey") % 60).cast("int") + 1).alias("start"), (F.col("l_suppkey") % 7).cast("int").alias("count"))


def _overlaps(t: Tables) -> DataFrame:
    return hunks.overlaps(_hunks(t), _entities(t), ["path"], parts=hunks.pieces(t.lineitem))


def _innermost(t: Tables) -> DataFrame:
    return hunks.innermost(_overlaps(t), ["path", "hunk_no"])


@query(f"WITH h AS ({HUNKS_SQL}), l AS (SELECT DISTINCT path, unnest(range(start, start + greatest(count, 1))) AS line FROM h) SELECT path, count(*) AS lines, CAST(min(line) AS BIGINT) AS first_line, CAST(max(line) AS BIGINT) AS last_line FROM l GROUP BY 1")
def q05_changed_lines_expand(t: Tables) -> DataFrame:
    lines = hunks.changed_lines(_hunks(t), ["path"], "start", "count")
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("line").cast("long").alias("first_line"), F.max("line").cast("long").alias("last_line"))


@query(f"WITH {OVERLAP_SQL} SELECT path, hunk_no, qname, start, count, start_line, end_line FROM o")
def q06_hunk_entity_overlap(t: Tables) -> DataFrame:
    return _overlaps(t).select("path", "hunk_no", "qname", "start", "count", "start_line", "end_line")


@query(f"WITH {INNER_SQL} SELECT path, hunk_no, innermost FROM i WHERE NOT conflict")
def q07_hunk_innermost_entity(t: Tables) -> DataFrame:
    return _innermost(t).where("not conflict").select("path", "hunk_no", "innermost")


@query(f"WITH {INNER_SQL} SELECT path, hunk_no, touched FROM i WHERE conflict")
def q08_hunk_nesting_conflict(t: Tables) -> DataFrame:
    return _innermost(t).where("conflict").select("path", "hunk_no", "touched")


@query(f"""WITH {INNER_SQL}, s AS (SELECT h.path, h.hunk_no, h.count, CASE WHEN NOT i.conflict THEN i.innermost END AS head, CASE WHEN h.hunk_no % 3 = 0 THEN NULL ELSE 'e' || h.hunk_no END AS base FROM h LEFT JOIN i USING (path, hunk_no))
SELECT path, hunk_no, CASE WHEN base IS NOT NULL AND head IS NOT NULL AND base = head THEN 'modified' WHEN base IS NULL AND head IS NOT NULL THEN CASE WHEN hunk_no % 2 = 0 THEN 'modified' ELSE 'added' END
WHEN base IS NOT NULL AND head IS NULL THEN CASE WHEN count = 0 THEN 'modified' ELSE 'removed' END WHEN base IS NULL AND head IS NULL AND count > 0 THEN 'other_text' ELSE 'mapping_unresolved' END AS change FROM s""")
def q09_hunk_classification_case(t: Tables) -> DataFrame:
    s = _hunks(t).join(_innermost(t), ["path", "hunk_no"], "left")
    head = F.when(~F.col("conflict"), F.col("innermost"))
    base = F.when(F.col("hunk_no") % 3 != 0, F.concat(F.lit("e"), F.col("hunk_no").cast("string")))
    change = hunks.classify(base, head, F.col("count"), F.col("hunk_no") % 2 == 0, F.lit(True), F.col("count") > 0)
    return s.select("path", "hunk_no", change.alias("change"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS change, max(event_id) FILTER (WHERE true) AS newest FROM events GROUP BY 1")
def q10_entity_change_last_wins(t: Tables) -> DataFrame:
    last = hunks.last_change(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])
    newest = t.events.groupBy("user_id").agg(F.max("event_id").alias("newest"))
    return last.join(newest, "user_id").select("user_id", F.col("event_type").alias("change"), "newest")


# --- names, paths and globs

URL_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1)"


def _url_path() -> F.Column:
    return F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1)


@query(f"""WITH p AS (SELECT page_id, {URL_PATH_SQL} AS path FROM pages), s AS (SELECT *, CASE WHEN contains(path, '.') THEN lower(split_part(path, '.', -1)) ELSE '' END AS suffix FROM p)
SELECT page_id, suffix, CASE WHEN suffix = 'py' THEN 'python' WHEN suffix = 'tsx' THEN 'tsx' WHEN suffix IN ('ts', 'mts', 'cts') THEN 'typescript' WHEN suffix IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript'
WHEN suffix IN {names.TEXT_SUFFIXES} OR (NOT contains(path, '/') AND NOT contains(path, '.')) THEN 'text' ELSE 'unsupported' END AS language FROM s""")
def q11_path_suffix_language(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", _url_path().alias("path"))
    return p.select("page_id", names.path_suffix(F.col("path")).alias("suffix"), names.language_of(F.col("path")).alias("language"))


@query(f"""WITH p AS (SELECT page_id, {URL_PATH_SQL} AS path FROM pages) SELECT page_id, path, NOT regexp_matches(path, '^[A-Za-z]:') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..', '~') OR ends_with(x, '.') OR ends_with(x, ' '))) = 0 AS safe FROM p""")
def q12_safe_path_filter(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", _url_path().alias("path"))
    return p.withColumn("safe", names.is_safe_path(F.col("path")))


PATH_RULES = [("R1", "src0/**"), ("R2", "*/en/doc_?.txt"), ("R3", "**/de/*.txt"), ("R4", "src1/*/doc_1*.txt")]
PATH_RULES_SQL = "rules(rule_id, rx) AS (VALUES " + ", ".join(f"('{r}', '{names.glob_regex(g)}')" for r, g in PATH_RULES) + ")"


def _by_rule(df: DataFrame, value: F.Column, rules: list[tuple[str, str]], kind: str) -> DataFrame:
    """Rules are part of the plan: each row gets the list of those that match, so nothing is joined."""
    found = F.array_compact(F.array(*[F.when(value.rlike(names.glob_regex(g, kind)), F.lit(r)) for r, g in rules]))
    return df.withColumn("rules", found)


@query(f"WITH base AS ({BASE_SQL}), {PATH_RULES_SQL} SELECT rule_id, count(*) AS paths, min(path) AS first_path FROM base JOIN rules ON regexp_matches(path, rx) GROUP BY 1")
def q13_glob_path_rules(t: Tables) -> DataFrame:
    hit = _by_rule(_base(t), F.col("path"), PATH_RULES, "path").select("path", F.explode("rules").alias("rule_id"))
    return hit.groupBy("rule_id").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first_path"))


SYMBOL_RULES = [("S1", "STANDARD*:**"), ("S2", "*:Brand?1*"), ("S3", "**:*.*")]
SYMBOL_SQL = "replace(p_type, ' ', '_') || ':' || replace(p_brand, '#', '') || '.' || p_partkey"
SYMBOL_RULES_SQL = "rules(rule_id, rx) AS (VALUES " + ", ".join(f"('{r}', '{names.glob_regex(g, 'symbol')}')" for r, g in SYMBOL_RULES) + ")"


@query(f"WITH s AS (SELECT p_partkey, {SYMBOL_SQL} AS symbol FROM part), {SYMBOL_RULES_SQL} SELECT p_partkey, symbol, split_part(split_part(symbol, ':', -1), '.', -1) AS simple, rule_id FROM s JOIN rules ON regexp_matches(symbol, rx)")
def q14_glob_symbol_rules(t: Tables) -> DataFrame:
    symbol = F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(":"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.col("p_partkey").cast("string"))
    s = t.part.select("p_partkey", symbol.alias("symbol"))
    return _by_rule(s, F.col("symbol"), SYMBOL_RULES, "symbol").select("p_partkey", "symbol", names.simple_name(F.col("symbol")).alias("simple"), F.explode("rules").alias("rule_id"))


@query(f"WITH base AS ({BASE_SQL}), {PATH_RULES_SQL} SELECT path, min(rule_id) AS primary_rule, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM base JOIN rules ON regexp_matches(path, rx) GROUP BY 1")
def q15_deny_primary_rule(t: Tables) -> DataFrame:
    hit = _by_rule(_base(t), F.col("path"), PATH_RULES, "path").where(F.size("rules") > 0)
    return hit.select("path", F.array_min("rules").alias("primary_rule"), F.array_join(F.array_sort("rules"), ",").alias("rules"))


@query("SELECT page_id, regexp_replace(regexp_replace(trim(replace('.//' || replace(url, '/', '\\'), '\\', '/')), '/+', '/', 'g'), '^(\\./)+', '') AS path FROM pages")
def q16_normalize_paths(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(".//"), F.replace("url", F.lit("/"), F.lit("\\")))
    return t.pages.select("page_id", names.normalize_path(raw).alias("path"))


# --- text

@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob_id FROM documents")
def q17_git_blob_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.git_blob_id(F.encode("text", "utf-8")).alias("blob_id"))


LINES_SQL = "SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') AS parts FROM documents"
LINE_SQL = f"s AS ({LINES_SQL}), lines AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM s), line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM lines)"


def _lines(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text").union(t.rows("doc_id long, text string", *CODE))
    return docs.select("doc_id", F.posexplode(text.lines_of(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


@query(f"WITH s AS ({LINES_SQL}) SELECT doc_id, CAST(CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END AS BIGINT) AS lines FROM s")
def q18_splitlines_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.lines_of(F.col("text"))).cast("long").alias("lines"))


ENTROPY_SQL = "(SELECT coalesce(sum(-c / n * log2(c / n)), 0.0) FROM (SELECT CAST(count(*) AS DOUBLE) AS c, CAST(length({v}) AS DOUBLE) AS n FROM (SELECT unnest(string_split({v}, '')) AS ch) GROUP BY ch, n))"
CODE = [(-1, "api_key = 'q8Zt4Lw0Xc7Vb2Nm'\nclient.open()\nprint(api_key)\nsend(api_key)"), (-2, "token = input()\nlog(mytoken)")]
CODE_SQL = "SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, c.replace("'", "''")) for i, c in CODE) + ") c(doc_id, text) UNION ALL SELECT doc_id, text FROM documents"
SECRET_LINES_SQL = LINE_SQL.replace("FROM documents", f"FROM ({CODE_SQL})") + f""", named AS (SELECT doc_id, line_no, line, split_part(line, '=', 1) AS lhs, trim(trim(substr(line, instr(line, '=') + 1)), '"''') AS value FROM line WHERE contains(line, '=') AND regexp_matches(split_part(line, '=', 1), '{text.SECRET_NAME}'))"""


def _secret_lines(t: Tables) -> DataFrame:
    named = _lines(t).where(F.contains("line", F.lit("=")) & F.substring_index("line", "=", 1).rlike(text.SECRET_NAME))
    value = F.btrim(F.trim(F.expr("substr(line, instr(line, '=') + 1)")), F.lit("\"'"))
    return named.select("doc_id", "line_no", "line", value.alias("value"))


@query(f"WITH {SECRET_LINES_SQL} SELECT doc_id, line_no, length(value) AS n, round({ENTROPY_SQL.format(v='value')}, 6) AS entropy FROM named WHERE length(value) >= 16")
def q19_secret_assignment_scan(t: Tables) -> DataFrame:
    s = _secret_lines(t).where(F.char_length("value") >= 16)
    return s.select("doc_id", "line_no", F.char_length("value").cast("long").alias("n"), F.round(text.entropy(F.col("value")), 6).alias("entropy"))


SAMPLES = [("s1", "key AKIA" + "ABCDEFGHIJKLMNOP" + " end"), ("s2", "ghp_" + "a1B2" * 9), ("s3", "xoxb-" + "1234567890ab"), ("s4", "sk_live_" + "0123456789abcdefg"), ("s5", "AIza" + "B" * 35), ("s6", "postgres://user:pw12345@host/db"), ("s7", "nothing here")]
PATTERNS = {k: v for k, v in text.SECRET_PATTERNS.items()}
SAMPLES_SQL = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SAMPLES)
# RE2 knows no lookahead; no sample needs it.
PATTERNS_SQL = "VALUES " + ", ".join("('{}', '{}')".format(k, v.replace(r"(?!(?:learn|learning|sklearn)\b)", "")) for k, v in PATTERNS.items())


@query(f"WITH t(id, body) AS (SELECT * FROM ({SAMPLES_SQL}) UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations UNION ALL SELECT 'd' || doc_id, text FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages), pat(kind, rx) AS ({PATTERNS_SQL}) SELECT id, kind, CAST(len(regexp_extract_all(body, rx)) AS BIGINT) AS n FROM t JOIN pat ON regexp_matches(body, rx)")
def q20_secret_pattern_scan(t: Tables) -> DataFrame:
    body = t.rows("id string, body string", *SAMPLES)
    body = body.union(t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")), "text"))
    body = body.union(t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text")).union(t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "url"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(text.secret_matches(F.col("body"), k)).cast("long").alias("n")) for k in PATTERNS])
    return body.select("id", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("x")).select("id", "x.kind", "x.n")


WORDS_FOR = [("ChangeMe",), ("your_key_here",), ("<token>",), (" real-Value-9f8e7d ",), ("my-example-key",), ("${VAR}",), ("resampled",)]
PLACEHOLDER_SQL = "lower(trim(v)) IN " + str(text.PLACEHOLDERS) + " OR " + " OR ".join(f"starts_with(lower(trim(v)), '{p}')" for p in text.PLACEHOLDER_STARTS) + f" OR regexp_matches(lower(trim(v)), '{text.PLACEHOLDER_INSIDE}')"


@query("WITH w(v) AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for (w,) in WORDS_FOR) + f") UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents) SELECT v, ({PLACEHOLDER_SQL}) AS placeholder, count(*) AS n FROM w GROUP BY 1, 2")
def q21_placeholder_filter(t: Tables) -> DataFrame:
    w = t.rows("v string", *WORDS_FOR).union(t.documents.select(F.explode(F.split("text", " "))))
    # Each distinct word is judged once.
    return w.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v", text.is_placeholder(F.col("v")).alias("placeholder"), "n")


@query("SELECT doc_id, CASE WHEN length(text) <= 8 THEN '***' ELSE left(text, 4) || '…' || right(text, 2) || ' (len=' || length(text) || ')' END AS shown FROM documents")
def q22_redaction(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.redact(F.col("text")).alias("shown"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, CAST(count(*) AS DOUBLE) AS c FROM c WHERE ch <> '' GROUP BY 1, 2), s AS (SELECT doc_id, sum(c) AS n FROM n GROUP BY 1) SELECT doc_id, round(sum(-c / s.n * log2(c / s.n)), 6) AS entropy FROM n JOIN s USING (doc_id) GROUP BY 1")
def q23_entropy_by_doc(t: Tables) -> DataFrame:
    return t.documents.where("length(text) > 0").select("doc_id", F.round(text.entropy(F.col("text")), 6).alias("entropy"))


@query("WITH r(rule, rx) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in [*text.DANGEROUS_CALLS.items(), ("track", r"track *\(")]) + ") SELECT page_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM pages JOIN r ON regexp_matches(html, rx) GROUP BY 1")
def q24_dangerous_call_scan(t: Tables) -> DataFrame:
    rules = {**text.DANGEROUS_CALLS, "track": r"track *\("}
    hit = F.array_compact(F.array(*[F.when(F.col("html").rlike(rx), F.lit(k)) for k, rx in rules.items()]))
    return t.pages.select("page_id", F.array_sort(hit).alias("r")).where(F.size("r") > 0).select("page_id", F.array_join("r", ",").alias("rules"))


@query(f"SELECT page_id, regexp_extract(body, '({text.TAINT_SOURCE})', 1) AS source, regexp_extract(body, '({text.TAINT_SINK})', 1) AS sink FROM (SELECT page_id, replace(html, 'track(', 'eval(input(') AS body FROM pages) WHERE regexp_matches(body, '{text.TAINT_SOURCE}') AND regexp_matches(body, '{text.TAINT_SINK}')")
def q25_taint_same_line(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.replace("html", F.lit("track("), F.lit("eval(input(")).alias("body"))  # each page's script, made to flow
    p = p.where(F.col("body").rlike(text.TAINT_SOURCE) & F.col("body").rlike(text.TAINT_SINK))
    return p.select("page_id", F.regexp_extract("body", f"({text.TAINT_SOURCE})", 1).alias("source"), F.regexp_extract("body", f"({text.TAINT_SINK})", 1).alias("sink"))


@query(f"""WITH {SECRET_LINES_SQL}, v AS (SELECT doc_id, line_no, list_last(regexp_split_to_array(trim(lhs), '[ \\t]+')) AS name FROM named), u AS (SELECT * FROM v WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$'))
SELECT u.doc_id, u.line_no, u.name, count(*) AS uses, min(l.line_no) AS first_use FROM u JOIN line l ON l.doc_id = u.doc_id AND l.line_no <> u.line_no AND regexp_matches(l.line, '(^|[^A-Za-z0-9_])' || u.name || '([^A-Za-z0-9_]|$)') GROUP BY 1, 2, 3""")
def q26_secret_to_sink_join(t: Tables) -> DataFrame:
    v = _secret_lines(t).select("doc_id", "line_no", text.assignment_name(F.col("line")).alias("name")).where("name is not null")
    lines = _lines(t).select(F.col("doc_id").alias("d"), F.col("line_no").alias("at"), "line")
    used = F.expr(r"line rlike concat('(^|[^A-Za-z0-9_])', name, '([^A-Za-z0-9_]|$)')")
    j = lines.join(v, (F.col("d") == F.col("doc_id")) & (F.col("at") != F.col("line_no")) & used)
    return j.groupBy("doc_id", "line_no", "name").agg(F.count(F.lit(1)).alias("uses"), F.min("at").alias("first_use"))


# --- calls and references

@query("WITH c AS (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_partkey % 97]) AS name FROM lineitem) SELECT p_brand, count(*) AS calls, count(DISTINCT l_orderkey) AS files FROM c JOIN part ON p_partkey = name GROUP BY 1")
def q27_call_entity_join(t: Tables) -> DataFrame:
    calls = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_partkey", F.col("l_partkey") % 97).alias("names"))
    hit = references.calls_to_entities(calls, t.part.select(F.col("p_partkey").alias("name"), "p_brand"), [])
    return hit.groupBy("p_brand").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("l_orderkey").alias("files"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber < p_size % 5 THEN 'too_few_positional' WHEN l_linenumber > p_size % 5 + 2 THEN 'too_many_positional' WHEN l_linestatus = 'O' THEN NULL WHEN l_quantity > 25 THEN 'unknown_keyword' WHEN l_discount > 0.05 THEN 'missing_keyword' END AS problem
FROM lineitem JOIN part ON p_partkey = l_partkey""")
def q28_call_problem_case(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    c = F.col
    problem = references.call_problem(c("l_linenumber"), c("p_size") % 5, c("p_size") % 5 + 2, c("l_quantity") > 25, c("l_discount") > 0.05, c("l_returnflag") == "R", c("l_linestatus") == "O")
    return j.select("l_orderkey", "l_linenumber", problem.alias("problem"))


@query("WITH e AS (SELECT l_orderkey AS path, unnest([l_suppkey, l_suppkey % 10]) AS module, l_partkey % 50 AS name FROM lineitem) SELECT module, name, count(DISTINCT path) AS files, min(path) AS first_file FROM e GROUP BY 1, 2")
def q29_reverse_import_index(t: Tables) -> DataFrame:
    imports = t.lineitem.select(F.col("l_orderkey").alias("path"), F.array("l_suppkey", F.col("l_suppkey") % 10).alias("modules"), F.array(F.col("l_partkey") % 50).alias("names"))
    return references.importers(imports, [])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem r WHERE r.l_partkey IN (SELECT p_partkey FROM part) AND r.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def q30_dangling_reference(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return references.dangling(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), part, part.where("p_size > 10"), ["l_partkey"])


@query("WITH f AS (SELECT l_partkey, min((l_orderkey, l_linenumber)) AS first, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, first[1] AS l_orderkey, first[2] AS l_linenumber, n FROM f".replace("first[1]", "struct_extract(first, 1)").replace("first[2]", "struct_extract(first, 2)"))
def q31_reachable_symbol_first_ref(t: Tables) -> DataFrame:
    return references.first_reference(t.lineitem, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("""WITH b AS (SELECT user_id, event_id AS base_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'error'), h AS (SELECT user_id, event_id AS head_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'click')
SELECT user_id, k, base_at, head_at FROM b JOIN h USING (user_id, k)""")
def q32_function_pairing_kth(t: Tables) -> DataFrame:
    e = t.events
    pairs = references.pair_in_order(e.where("event_type <> 'error'"), e.where("event_type <> 'click'"), ["user_id"], "event_id")
    return pairs.select("user_id", F.col("k").cast("long").alias("k"), "base_at", "head_at")


ARGS_SQL = "SELECT user_id, list(event_type ORDER BY event_id) AS args FROM events GROUP BY user_id, event_id // 600"


@query(f"""WITH a AS (SELECT user_id % 20 AS callee, args FROM ({ARGS_SQL})), b AS (SELECT callee, args AS base_args, list_sort(args) AS s, count(*) AS n FROM a GROUP BY 1, 2, 3)
SELECT x.callee, array_to_string(x.base_args, ',') AS base_args, array_to_string(y.base_args, ',') AS head_args FROM b x JOIN b y ON x.callee = y.callee AND x.s = y.s AND x.base_args <> y.base_args""")
def q33_permuted_args_pairs(t: Tables) -> DataFrame:
    args = t.events.groupBy("user_id", F.floor(F.col("event_id") / 600)).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("args"))
    a = args.select((F.col("user_id") % 20).alias("callee"), "args").distinct()
    return references.permuted(a, a, ["callee"]).select("callee", F.array_join("base_args", ",").alias("base_args"), F.array_join("head_args", ",").alias("head_args"))


# --- gate

WAIVERS = [(1, "error", 3, "2024-01-01", "2030-01-01"), (2, "error", 3, "2020-01-01", "2020-06-30"), (3, "click", 5, "2020-01-01", "2021-01-01"), (4, "view", 7, "2024-01-01", "2031-01-01"), (5, None, 7, "2024-01-01", "2031-01-01")]
WAIVER_SCHEMA = "record_id int, defect string, fingerprint long, created string, expires string"
WAIVERS_SQL = "w(record_id, defect, fingerprint, created, expires) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in WAIVERS) + ")"
AS_OF = "2026-01-01"
FINDINGS_SQL = "f AS (SELECT event_id, event_type AS defect, event_id % 9 AS fingerprint, user_id FROM events)"
WAIVED_SQL = f"{WAIVERS_SQL}, {FINDINGS_SQL}, j AS (SELECT f.*, w.record_id, w.created, w.expires, row_number() OVER (PARTITION BY event_id ORDER BY w.record_id NULLS LAST) AS place FROM f LEFT JOIN w ON f.defect = w.defect AND f.fingerprint = w.fingerprint), m AS (SELECT * FROM j WHERE place = 1)"


def _waived(t: Tables) -> DataFrame:
    f = t.events.select("event_id", F.col("event_type").alias("defect"), (F.col("event_id") % 9).alias("fingerprint"), "user_id")
    return gate.first_match(f, t.rows(WAIVER_SCHEMA, *WAIVERS), ["defect", "fingerprint"], ["event_id"], "record_id")


def _active() -> F.Column:
    return gate.is_active(F.lit(AS_OF), F.col("rec_created"), F.col("rec_expires"))


@query(f"WITH {WAIVED_SQL} SELECT event_id, defect, CAST(record_id AS INT) AS waiver, CASE WHEN record_id IS NOT NULL AND '{AS_OF}' BETWEEN created AND expires THEN 'WAIVED' ELSE 'OPEN' END AS disposition FROM m")
def q34_waiver_join_active(t: Tables) -> DataFrame:
    return _waived(t).select("event_id", "defect", F.col("rec_record_id").alias("waiver"), F.when(_active(), "WAIVED").otherwise("OPEN").alias("disposition"))


@query(f"WITH {WAIVED_SQL} SELECT CAST(record_id AS INT) AS waiver, 'stale_waiver_present' AS diagnostic, count(*) AS findings FROM m WHERE record_id IS NOT NULL AND NOT '{AS_OF}' BETWEEN created AND expires GROUP BY 1")
def q35_stale_waiver_review(t: Tables) -> DataFrame:
    stale = _waived(t).where(F.col("rec_record_id").isNotNull() & ~_active())
    return stale.groupBy(F.col("rec_record_id").alias("waiver")).agg(F.first(F.lit("stale_waiver_present")).alias("diagnostic"), F.count(F.lit(1)).alias("findings"))


ACCEPTANCES = [(1, "fr", "^src[0-4]/.*$", "2024-01-01", "2030-01-01"), (2, "fr", "^src5/.*$", "2019-01-01", "2020-01-01"), (3, "de", "^.*$", "2025-01-01", "2027-01-01")]
ACCEPT_SQL = "a(record_id, reason, rx, created, expires) AS (VALUES " + ", ".join(str(r) for r in ACCEPTANCES) + f"), g AS (SELECT doc_id, lang AS reason, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents), j AS (SELECT g.*, a.record_id, a.created, a.expires, row_number() OVER (PARTITION BY doc_id ORDER BY a.record_id NULLS LAST) AS place FROM g LEFT JOIN a ON g.reason = a.reason AND regexp_matches(path, rx)), m AS (SELECT *, coalesce('{AS_OF}' BETWEEN created AND expires, false) AS accepted FROM j WHERE place = 1)"


def _accepted(t: Tables) -> DataFrame:
    gaps = t.documents.select("doc_id", F.col("lang").alias("reason"), _path(F.lit("")).alias("path"))
    records = t.rows("record_id int, reason string, rx string, created string, expires string", *ACCEPTANCES)
    return gate.first_match(gaps, records, ["reason"], ["doc_id"], "record_id", F.expr("path rlike rec_rx")).withColumn("accepted", F.coalesce(_active(), F.lit(False)))


@query(f"WITH {ACCEPT_SQL} SELECT doc_id, CAST(record_id AS INT) AS acceptance, accepted FROM m")
def q36_acceptance_join(t: Tables) -> DataFrame:
    return _accepted(t).select("doc_id", F.col("rec_record_id").alias("acceptance"), "accepted")


COVERAGE_SQL = "CASE WHEN {scope} THEN 'UNKNOWN' WHEN {part} THEN CASE WHEN declared = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PARTIAL' END WHEN gaps > 0 THEN 'COMPLETE' ELSE declared END"


@query("WITH c AS (SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 1 END) WHEN 2 THEN 'PARTIAL' ELSE 'COMPLETE' END AS declared, bool_and(o_totalprice > 1000) AS scope, bool_and(o_orderpriority <> '1-URGENT') AS cand, count(*) FILTER (o_orderpriority = '5-LOW') AS gaps, bool_or(o_orderpriority = '5-LOW' AND o_orderstatus = 'O') AS open_gap FROM orders GROUP BY 1) SELECT o_custkey, " + COVERAGE_SQL.format(scope="NOT scope", part="NOT cand OR open_gap") + " AS coverage FROM c")
def q37_effective_coverage(t: Tables) -> DataFrame:
    c = F.col
    low = c("o_orderpriority") == "5-LOW"
    g = t.orders.groupBy("o_custkey").agg(
        F.max(F.when(c("o_orderstatus") == "P", 2).otherwise(1)).alias("rank"), F.bool_and(c("o_totalprice") > 1000).alias("scope"), F.bool_and(c("o_orderpriority") != "1-URGENT").alias("cand"), F.count_if(low).alias("gaps"), F.bool_or(low & (c("o_orderstatus") == "O")).alias("open_gap")
    )
    declared = F.when(c("rank") == 2, "PARTIAL").otherwise("COMPLETE")
    return g.select("o_custkey", gate.effective_coverage(declared, c("scope"), c("cand"), c("open_gap"), c("gaps") > 0, F.lit(True)).alias("coverage"))


OUTCOME_OF = {"error": "ERROR", "purchase": "FAIL", "signup": "INCONCLUSIVE", "click": "PASS"}
OUTCOME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOME_OF.items()) + " ELSE 'NOT_APPLICABLE' END"
RANK_SQL = "CASE {} WHEN 'ERROR' THEN 5 WHEN 'FAIL' THEN 4 WHEN 'INCONCLUSIVE' THEN 3 WHEN 'PASS' THEN 2 ELSE 1 END"


def _outcome() -> F.Column:
    out = F.lit("NOT_APPLICABLE")
    for k, v in OUTCOME_OF.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


@query(f"SELECT user_id, arg_max({OUTCOME_SQL}, {RANK_SQL.format(OUTCOME_SQL)}) AS outcome FROM events GROUP BY 1")
def q38_outcome_precedence_max(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by(_outcome(), gate.rank(_outcome(), gate.OUTCOME_RANK)).alias("outcome"))


@query(f"WITH s AS (SELECT user_id, {OUTCOME_SQL} AS outcome, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS coverage FROM events) SELECT user_id, coalesce(arg_max(coverage, CASE coverage WHEN 'UNKNOWN' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END) FILTER (outcome <> 'NOT_APPLICABLE'), 'COMPLETE') AS coverage FROM s GROUP BY 1")
def q39_coverage_max_applicable(t: Tables) -> DataFrame:
    m = F.col("event_id") % 3
    cov = F.when(m == 0, "COMPLETE").when(m == 1, "PARTIAL").otherwise("UNKNOWN")
    applicable = F.when(_outcome() != "NOT_APPLICABLE", gate.rank(cov, gate.COVERAGE_RANK))
    return t.events.groupBy("user_id").agg(F.coalesce(F.max_by(cov, applicable), F.lit("COMPLETE")).alias("coverage"))


@query("""WITH v AS (SELECT conv_id, bool_or(length(text) > 4000) AS fault, bool_or(contains(text, '=')) AS finding, bool_or(role = 'system') AS incomplete, count(*) > 4 AS review, string_agg(DISTINCT role, ',' ORDER BY role) AS codes FROM conversations GROUP BY 1),
s AS (SELECT conv_id, codes, CASE WHEN fault THEN 'ERROR' WHEN finding THEN 'FAIL' WHEN incomplete THEN 'INCONCLUSIVE' WHEN review THEN 'REVIEW' ELSE 'PASS' END AS status FROM v) SELECT conv_id, status, CASE status WHEN 'PASS' THEN 0 WHEN 'FAIL' THEN 1 WHEN 'INCONCLUSIVE' THEN 2 WHEN 'ERROR' THEN 3 ELSE 4 END AS exit_code, codes FROM s""")
def q40_verdict_lattice(t: Tables) -> DataFrame:
    v = t.conversations.groupBy("conv_id").agg(F.bool_or(F.char_length("text") > 4000).alias("fault"), F.bool_or(F.contains("text", F.lit("="))).alias("finding"), F.bool_or(F.col("role") == "system").alias("incomplete"), F.count(F.lit(1)).alias("n"), gate.code_set(F.col("role")).alias("codes"))
    status = gate.verdict(F.col("fault"), F.col("finding"), F.col("incomplete"), F.col("n") > 4)
    return v.select("conv_id", status.alias("status"), gate.exit_code(status).alias("exit_code"), "codes")


@query("WITH r AS (SELECT md5(text) AS fingerprint, doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS place FROM documents) SELECT fingerprint, doc_id, source FROM r WHERE place = 1")
def q41_finding_dedup_first(t: Tables) -> DataFrame:
    return gate.dedup_first(t.documents.select(F.md5("text").alias("fingerprint"), "doc_id", "source"), ["fingerprint"], ["source", "doc_id"])


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def q42_reason_code_sets(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(gate.code_set(F.col("event_type")).alias("codes"), F.count_distinct("event_type").alias("n"))


@query("SELECT o_custkey, count(*) AS used, count(DISTINCT o_orderpriority) AS kinds, CASE WHEN count(*) > 12 OR count(DISTINCT o_orderpriority) > 4 THEN 'INCONCLUSIVE' WHEN bool_or(o_orderstatus = 'P') THEN 'FAIL' ELSE 'PASS' END AS outcome FROM orders GROUP BY 1")
def q43_budget_override(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("used"), F.count_distinct("o_orderpriority").alias("kinds"), F.bool_or(F.col("o_orderstatus") == "P").alias("bad"))
    over = (F.col("used") > 12) | (F.col("kinds") > 4)
    return g.select("o_custkey", "used", "kinds", F.when(over, "INCONCLUSIVE").when(F.col("bad"), "FAIL").otherwise("PASS").alias("outcome"))


OWNER_RULES = [(1, "**", "@all"), (2, "src1/**", "@one"), (3, "*/de/**", "@de"), (4, "src1/en/**", "@one")]


@query(f"WITH base AS ({BASE_SQL}), r(idx, rx, owners) AS (VALUES " + ", ".join(f"({i}, '{names.glob_regex(g)}', '{o}')" for i, g, o in OWNER_RULES) + ") SELECT path, max(idx) AS rule, arg_max(owners, idx) AS owners FROM base JOIN r ON regexp_matches(path, rx) GROUP BY 1")
def q44_codeowners_last_rule(t: Tables) -> DataFrame:
    hit = F.array(*[F.when(F.col("path").rlike(names.glob_regex(g)), F.struct(F.lit(i).alias("idx"), F.lit(o).alias("owners"))) for i, g, o in OWNER_RULES])
    return _base(t).select("path", F.array_max(hit).alias("r")).where("r is not null").select("path", F.col("r.idx").alias("rule"), "r.owners")


# --- statistics

@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def q45_percentile_nearest_rank(t: Tables) -> DataFrame:
    p = lambda q: stats.nearest_rank("value", q).alias(f"p{round(q * 100)}")
    return t.events.groupBy("event_type").agg(p(0.5), p(0.95), p(0.99), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(greatest(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 0), 6) AS low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS high FROM lineitem GROUP BY 1")
def q46_mean_ci95(t: Tables) -> DataFrame:
    return stats.mean_ci95(t.lineitem, ["l_returnflag"], "l_quantity")


@query("""WITH j AS (SELECT lang, quality = 0 AS truth, len(regexp_extract_all(text, '[#*$%&|<>]')) * 20 > length(text) AS said FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn FROM j GROUP BY 1)
SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 4) END AS "precision", CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 4) END AS recall FROM c""")
def q47_confusion_matrix(t: Tables) -> DataFrame:
    symbols = F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))
    j = t.labels.join(t.documents, "doc_id").select("lang", (F.col("quality") == 0).alias("truth"), (symbols * 20 > F.char_length("text")).alias("said"))
    return stats.confusion(j, ["lang"], "truth", "said")


@query("""WITH v AS (SELECT user_id, event_id AS version, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM events WHERE event_type IN ('signup', 'purchase')),
j AS (SELECT e.event_id, e.user_id, v.version, row_number() OVER (PARTITION BY e.event_id ORDER BY v.valid_from DESC NULLS LAST, v.version DESC) AS place FROM events e LEFT JOIN v ON e.user_id = v.user_id AND v.valid_from <= e.ts AND (v.valid_until IS NULL OR v.valid_until > e.ts)) SELECT event_id, user_id, version FROM j WHERE place = 1""")
def q48_asof_valid_time(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = t.events.where("event_type in ('signup', 'purchase')").select("user_id", F.col("event_id").alias("version"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_until"))
    j = references.as_of(t.events.select("event_id", "user_id", "ts"), v, "user_id", "ts", "valid_from", "valid_until", "version")
    return j.groupBy("event_id", "user_id").agg(F.max(F.struct("_from", "_value"))["_value"].alias("version"))


@query(f"SELECT doc_id FROM documents WHERE sha256(encode('v1') || '\\x00'::BLOB || encode(text)) < '{2**256 * 5 // 100:064x}'")
def q49_sampler_5_percent(t: Tables) -> DataFrame:
    return t.documents.where(text.sampled(F.col("text"), "v1")).select("doc_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND value > 50 THEN 'warning' ELSE 'note' END AS level, CAST(coalesce(nullif(event_id % 40, 0), nullif(user_id % 30, 0), 1) AS BIGINT) AS line FROM events")
def q50_severity_case_sarif(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when((F.col("event_type") == "purchase") & (F.col("value") > 50), "warning").otherwise("note")
    line = F.coalesce(F.nullif(F.col("event_id") % 40, F.lit(0)), F.nullif(F.col("user_id") % 30, F.lit(0)), F.lit(1)).cast("long")
    return t.events.select("event_id", level.alias("level"), line.alias("line"))


# --- canonical JSON and identities

@query("""SELECT doc_id, 'sha256:' || sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n":[' || n_chars || ',0.5],"source":"' || source || '"}') AS payload_hash FROM documents""")
def q51_canonical_hash(t: Tables) -> DataFrame:
    value = F.to_json(F.struct("source", F.array(F.col("n_chars").cast("string"), F.lit("0.5")).alias("n"), "lang", "doc_id"))
    numbers = F.regexp_replace(value, r'"(\d+)","0\.5"', "$1,5e-1")
    return t.documents.select("doc_id", canonical.canonical_hash(numbers).alias("payload_hash"))


@query("""SELECT doc_id, 'sha256:' || sha256('{"check_id":"security","defect_id":"SEC-SECRET","defect_semantics_version":1,"evidence_identity":{"lang":"' || lang || '"},"path":"' || source || '/' || doc_id || '","symbol":""}') AS fingerprint FROM documents""")
def q52_finding_fingerprint(t: Tables) -> DataFrame:
    identity = F.to_json(F.struct("lang", F.col("n_chars").alias("line")))
    path = F.concat(F.lit("./"), "source", F.lit("//"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", canonical.finding_fingerprint(F.lit("security"), F.lit("SEC-SECRET"), path, F.lit(""), identity).alias("fingerprint"))


@query()
def q53_bootstrap_ci(t: Tables) -> DataFrame:
    return stats.bootstrap(t.events, ["event_type"], "value", 0.5)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, CASE WHEN count(*) < 1000 THEN 'INSUFFICIENT_DATA' WHEN quantile_disc(l_quantity, 0.95) <= 48 THEN 'MET' ELSE 'NOT_MET' END AS state FROM lineitem GROUP BY 1, 2")
def q54_sample_summary(t: Tables) -> DataFrame:
    s = stats.summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return s.select("l_returnflag", "l_linestatus", "n", "least", "median", "p95", "most", F.round("mean", 6).alias("mean"), stats.sufficiency(F.col("n"), F.lit(1000), F.col("p95"), F.lit(48)).alias("state"))


# --- what decides beside findings

CHANGED_SQL = "SELECT source AS run_id, CASE WHEN doc_id % 7 = 0 THEN '.github/workflows/' || doc_id || '.yml' WHEN doc_id % 11 = 0 THEN 'docs/CODEOWNERS' WHEN doc_id % 13 = 0 THEN '.palisade/policy.toml' ELSE lang || '/CODEOWNERS' END AS path FROM documents"


@query(f"WITH c AS ({CHANGED_SQL}), p AS (SELECT *, path IN ('CODEOWNERS', '.github/CODEOWNERS', 'docs/CODEOWNERS') OR starts_with(path, '.palisade/') OR starts_with(path, '.github/workflows/') OR starts_with(path, '.github/actions/') AS safe FROM c), g AS (SELECT run_id, count(*) FILTER (safe) AS protected, min(path) FILTER (safe) AS first_protected, bool_or(path = '.palisade/policy.toml') AS policy_changed FROM p GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN protected > 0 THEN 'gate_integrity_review' END, CASE WHEN policy_changed THEN 'policy_change_review' END) AS codes FROM g")
def q55_gate_integrity(t: Tables) -> DataFrame:
    m = lambda n: F.col("doc_id") % n == 0
    path = F.when(m(7), F.concat(F.lit(".github/workflows/"), F.col("doc_id").cast("string"), F.lit(".yml"))).when(m(11), "docs/CODEOWNERS").when(m(13), review.POLICY).otherwise(F.concat("lang", F.lit("/CODEOWNERS")))
    return review.integrity(t.documents.select(F.col("source").alias("run_id"), path.alias("path"))).withColumn("codes", F.array_join("codes", ","))


RECORDS_SQL = "old AS (SELECT o_custkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'waivers' ELSE 'acceptances' END AS kind, o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS created, CAST(o_orderdate AS DATE) + 90 AS expires FROM orders), new AS (SELECT run_id, kind, record_id, created, CASE WHEN record_id % 5 = 0 THEN expires + 900 ELSE expires END AS expires FROM old WHERE record_id % 3 <> 0)"


def _records(t: Tables) -> tuple[DataFrame, DataFrame]:
    day = F.to_date("o_orderdate")
    old = t.orders.select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "waivers").otherwise("acceptances").alias("kind"), F.col("o_orderkey").alias("record_id"), day.alias("created"), F.date_add(day, 90).alias("expires"))
    new = old.where("record_id % 3 <> 0").withColumn("expires", F.when(F.col("record_id") % 5 == 0, F.date_add("expires", 900)).otherwise(F.col("expires")))
    return old, new


@query(f"""WITH {RECORDS_SQL}, p AS (SELECT *, DATE '1996-06-30' AS day FROM old o FULL OUTER JOIN (SELECT run_id AS r, kind AS k, record_id AS i, created AS c, expires AS e FROM new) n ON o.run_id = n.r AND o.kind = n.k AND o.record_id = n.i)
SELECT coalesce(run_id, r) AS run_id, count(*) FILTER (i IS NOT NULL AND (record_id IS NULL OR expires <> e OR created <> c) AND c > day) AS invalid, count(*) FILTER (record_id IS NOT NULL AND NOT day BETWEEN created AND expires AND (i IS NULL OR day BETWEEN c AND e)) AS superseded,
concat_ws(',', CASE WHEN bool_or(k = 'acceptances' AND NOT day BETWEEN c AND e) THEN 'coverage_acceptance_review' END, CASE WHEN bool_or(k = 'waivers' AND NOT day BETWEEN c AND e) THEN 'waiver_review' END) AS codes FROM p GROUP BY 1""")
def q56_policy_review(t: Tables) -> DataFrame:
    found = review.policy_review(*_records(t), F.lit("1996-06-30").cast("date"))
    return found.withColumn("codes", F.array_join("codes", ","))


@query("""WITH g AS (SELECT event_id % 2000 AS run_id, count(*) FILTER (event_type = 'error' AND value > 90) AS findings, count(*) FILTER (event_type = 'signup' AND value > 90) AS gaps, count(*) FILTER (event_type = 'purchase') AS superseded, bool_or(event_type = 'click' AND value > 80) AS asked FROM events GROUP BY 1),
c AS (SELECT *, superseded > 0 AND findings = 0 AND gaps = 0 AS settled FROM g), r AS (SELECT *, concat_ws(',', CASE WHEN asked THEN 'coverage_acceptance_review' END, 'gate_integrity_review', CASE WHEN NOT settled OR asked THEN 'waiver_review' END) AS codes FROM c),
s AS (SELECT *, CASE WHEN findings > 0 THEN 'FAIL' WHEN gaps > 0 THEN 'INCONCLUSIVE' ELSE 'REVIEW' END AS status FROM r) SELECT run_id, status, codes, status = 'REVIEW' AND run_id % 2 = 0 AND codes = 'gate_integrity_review' AS cleared FROM s""")
def q57_review_boundary(t: Tables) -> DataFrame:
    kind = lambda k, least=None: (F.col("event_type") == k) & (F.lit(True) if least is None else F.col("value") > least)
    g = t.events.groupBy((F.col("event_id") % 2000).alias("run_id")).agg(F.count_if(kind("error", 90)).alias("findings"), F.count_if(kind("signup", 90)).alias("gaps"), F.count_if(kind("purchase")).alias("superseded"), F.bool_or(kind("click", 80)).alias("asked"))
    codes = F.array(F.lit("gate_integrity_review"), F.lit("waiver_review"))
    proposed = F.when(F.col("asked"), F.array(F.lit("coverage_acceptance_review"))).otherwise(F.array().cast("array<string>"))
    g = g.withColumn("codes", review.after_proposal(codes, proposed, F.col("superseded"), F.col("findings"), F.col("gaps")))
    g = g.withColumn("status", gate.verdict(F.lit(False), F.col("findings") > 0, F.col("gaps") > 0, F.size("codes") > 0))
    cleared = review.review_cleared(F.col("status"), F.col("codes"), F.col("run_id") % 2 == 0, F.lit(True))
    return g.select("run_id", "status", F.array_join("codes", ",").alias("codes"), cleared.alias("cleared"))


CHECK_NAMES = ("grounding", "deletion", "contract", "semantic", "security")


@query(f"WITH f AS (SELECT user_id AS run_id, string_agg(DISTINCT code, ',' ORDER BY code) AS reason_codes, bool_and(code <> 'shallow_history') AS limited FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'shallow_history' WHEN 'signup' THEN 'budget_exhausted' ELSE 'parse_resource_limit' END AS code FROM events WHERE value > 150 OR event_type = 'signup') GROUP BY 1) SELECT run_id, check_id, CASE WHEN limited THEN 'INCONCLUSIVE' ELSE 'ERROR' END AS outcome, CASE WHEN limited THEN 'PARTIAL' ELSE 'UNKNOWN' END AS coverage, reason_codes FROM f, (SELECT unnest({list(CHECK_NAMES)}) AS check_id)")
def q58_fault_fan_out(t: Tables) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "shallow_history").when(F.col("event_type") == "signup", "budget_exhausted").otherwise("parse_resource_limit")
    faults = t.events.where("value > 150 or event_type = 'signup'").select(F.col("user_id").alias("run_id"), code.alias("code"))
    return review.fan_out(faults, CHECK_NAMES).withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS enumerated, CASE WHEN count(DISTINCT l_suppkey) > 4 THEN 'INCONCLUSIVE' ELSE 'FAIL' END AS outcome FROM lineitem GROUP BY 1")
def q59_entity_budget(t: Tables) -> DataFrame:
    side = lambda s: t.lineitem.where(F.col("l_linestatus") == s)
    seen = review.enumerated(side("F"), side("O"), ["l_orderkey"], "l_suppkey")
    return seen.withColumn("outcome", review.within_budget(F.lit("FAIL"), F.col("enumerated"), F.lit(4)))


GAP_CODE_SQL = "CASE source WHEN 'src1' THEN 'unsupported_language' WHEN 'src2' THEN 'frontend_capability_missing' ELSE 'dynamic_call' END"


@query(f"WITH g AS (SELECT n_chars % 500 AS run_id, count(*) AS gaps, count(*) FILTER (lang = 'fr') AS open_gaps, bool_and({GAP_CODE_SQL} <> 'dynamic_call') AS narrow FROM documents GROUP BY 1) SELECT run_id, gaps, open_gaps, open_gaps = 0 AND narrow AS lifted FROM g")
def q60_scope_lift(t: Tables) -> DataFrame:
    code = F.when(F.col("source") == "src1", "unsupported_language").when(F.col("source") == "src2", "frontend_capability_missing").otherwise("dynamic_call")
    g = t.documents.groupBy((F.col("n_chars") % 500).alias("run_id")).agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("lang") == "fr").alias("open_gaps"), F.collect_set(code).alias("codes"))
    return g.select("run_id", "gaps", "open_gaps", review.scope_lifted(F.col("gaps"), F.col("open_gaps"), F.col("codes")).alias("lifted"))


@query("""WITH a AS (SELECT doc_id, quality, toxic, contains(text, 'AKIA') OR contains(text, 'ghp_') OR contains(text, 'sk_live_') AS raw FROM labels JOIN documents USING (doc_id))
SELECT doc_id, concat_ws(',', CASE WHEN quality <> toxic THEN 'outcome' END, CASE WHEN doc_id % 3 = 0 THEN 'coverage' END, CASE WHEN doc_id % 4 = 0 THEN 'reason_codes' END, CASE WHEN quality = 0 AND toxic = 1 THEN 'false_blocking' END, CASE WHEN raw THEN 'raw_secret' END) AS errors, quality = toxic AND doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND NOT raw AS matched, quality = 0 AND toxic = 1 AS false_blocking FROM a""")
def q61_case_grading(t: Tables) -> DataFrame:
    outcome = lambda c: F.when(F.col(c) == 1, "FAIL").otherwise("PASS").alias("outcome")
    texts = lambda *x: F.array(*map(F.lit, x))
    coverage = F.when(F.col("doc_id") % 3 == 0, "PARTIAL").otherwise("COMPLETE").alias("coverage")
    codes = F.when(F.col("doc_id") % 4 == 0, texts("a")).otherwise(texts("b", "a")).alias("reason_codes")
    same = texts("SEC-SECRET").alias("findings")
    got = F.struct(outcome("toxic"), coverage, codes, same)
    wanted = F.struct(outcome("quality"), F.lit("COMPLETE").alias("coverage"), texts("a", "b").alias("reason_codes"), same)
    answers = t.labels.join(t.documents, "doc_id").select("doc_id", got.alias("got"), wanted.alias("wanted"), F.array("text").alias("messages"))
    return review.graded(answers).select("doc_id", F.array_join("errors", ",").alias("errors"), "matched", "false_blocking")


@query(f"""WITH r AS (SELECT event_id, {OUTCOME_SQL} AS outcome, event_id % 3 > 0 AS complete, event_id % 5 > 0 AS scope, event_id % 7 > 0 AS cand, value > 50 AS found, event_id % 11 = 0 AS gap, event_id % 13 = 0 AS sub FROM events), w AS (SELECT *, complete AND scope AND cand AND NOT gap AND NOT sub AS whole FROM r)
SELECT event_id, concat_ws(',', CASE WHEN complete AND NOT scope THEN 'complete_without_scope' END, CASE WHEN complete AND NOT cand THEN 'complete_without_candidates' END, CASE WHEN complete AND gap THEN 'complete_with_open_gaps' END, CASE WHEN complete AND sub THEN 'complete_with_partial_parts' END, CASE WHEN outcome = 'PASS' AND NOT whole THEN 'pass_without_coverage' END, CASE WHEN outcome = 'PASS' AND found THEN 'pass_with_findings' END, CASE WHEN outcome = 'NOT_APPLICABLE' AND NOT whole THEN 'not_applicable_without_coverage' END, CASE WHEN outcome = 'NOT_APPLICABLE' AND found THEN 'not_applicable_with_findings' END, CASE WHEN outcome = 'INCONCLUSIVE' AND found THEN 'inconclusive_with_findings' END, CASE WHEN outcome = 'FAIL' AND NOT found THEN 'fail_without_findings' END, CASE WHEN outcome = 'ERROR' AND event_id % 2 = 0 THEN 'error_without_reason' END) AS violations FROM w""")
def q62_result_validator(t: Tables) -> DataFrame:
    m = lambda n: F.col("event_id") % n
    number = lambda test: F.when(test, 1).otherwise(0)
    found = review.violations(F.when(m(3) > 0, "COMPLETE").otherwise("PARTIAL"), _outcome(), m(5) > 0, m(7) > 0, number(F.col("value") > 50), number(m(11) == 0), number(m(13) == 0), m(2) > 0)
    return t.events.select("event_id", F.array_join(found, ",").alias("violations"))


@query("SELECT user_id, count(*) AS count, string_agg(DISTINCT CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END, ',' ORDER BY CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END) AS kinds FROM events GROUP BY 1")
def q63_warning_summary(t: Tables) -> DataFrame:
    return review.warnings(t.events.select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind")), ["user_id"], "kind")


OWNED = [(0, "*", ["@all"]), (1, "/src1/", ["@one"]), (2, "/src2/en", []), (3, "/src1/de/**", ["@de"]), (4, "/src3/*/x", ["@all"]), (5, "/src4/fr", ["@four"])]


@query("SELECT DISTINCT source || '/' || lang AS target, CASE WHEN source = 'src1' AND lang <> 'de' THEN '' WHEN source = 'src2' AND lang = 'en' THEN 'codeowners_ownerless_rule' ELSE '' END AS reasons FROM documents UNION SELECT DISTINCT source, CASE source WHEN 'src1' THEN 'codeowners_noninterference_unproven' WHEN 'src2' THEN 'codeowners_noninterference_unproven' WHEN 'src4' THEN 'codeowners_noninterference_unproven' ELSE '' END FROM documents")
def q64_owner_interference(t: Tables) -> DataFrame:
    folders = t.documents.select(F.concat_ws("/", "source", "lang").alias("target")).union(t.documents.select("source")).distinct()
    return folders.select("target", F.array_join(review.owner_reasons(F.col("target"), OWNED), ",").alias("reasons"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS added, count(*) FILTER (o_orderstatus = 'F') AS deleted, added > 0 AND deleted > 0 AND (added * 100 + deleted * 100 > 2000 OR added * 100 * deleted * 100 > 2000) AS limited FROM orders GROUP BY 1")
def q65_rename_limit(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("added"), F.count_if(F.col("o_orderstatus") == "F").alias("deleted"))
    return g.withColumn("limited", review.rename_limited(F.col("added") * 100, F.col("deleted") * 100))


FLAGS_SQL = "SELECT doc_id, source AS run_id, lang || '/' || doc_id AS path, doc_id % 17 = 0 AS is_submodule, doc_id % 19 = 0 AS is_symlink, doc_id % 17 <> 0 AND doc_id % 5 = 0 AS is_binary, doc_id % 17 <> 0 AND doc_id % 7 = 0 AS is_lfs FROM documents"


def _flagged(t: Tables) -> DataFrame:
    m = lambda n: F.col("doc_id") % n == 0
    mode = lambda code, n: F.when(m(n), code).otherwise("100644")
    base = F.encode(F.when(m(7), F.concat(F.lit(review.LFS_POINTER), F.lit("v1\n"))).otherwise(F.lit("x")), "utf-8")
    head = F.encode(F.when(m(5), F.concat(F.lit("a"), F.char(F.lit(0)), F.col("source"))).otherwise(F.lit("y")), "utf-8")
    flags = review.blob_flags(mode("160000", 17), mode("120000", 19), base, head)
    return t.documents.select("doc_id", F.col("source").alias("run_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), flags.alias("f")).select("doc_id", "run_id", "path", "f.*")


@query(FLAGS_SQL)
def q66_blob_flags(t: Tables) -> DataFrame:
    return _flagged(t)


@query(f"WITH e AS ({FLAGS_SQL}) SELECT run_id, 'binary' AS kind, path, NULL AS reason_code FROM e WHERE is_binary UNION ALL SELECT run_id, 'submodule', path, NULL FROM e WHERE is_submodule UNION ALL SELECT run_id, 'lfs_content_unavailable', path, 'lfs_content_unavailable' FROM e WHERE is_lfs UNION ALL SELECT run_id, 'accepted_gap', path, 'dynamic_call' FROM e WHERE doc_id % 23 = 0 UNION ALL SELECT DISTINCT run_id, 'target_changes_since_merge_base', NULL, NULL FROM e WHERE run_id < 'src5'")
def q67_excluded_scope(t: Tables) -> DataFrame:
    e = _flagged(t)
    accepted = e.where("doc_id % 23 = 0").select("run_id", "path", F.lit("dynamic_call").alias("reason_code"))
    return review.excluded_scope(e, accepted, e.where("run_id < 'src5'").select("run_id").distinct())
