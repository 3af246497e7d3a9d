"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import table


#: Of the public vocabulary files; see the tokenizers' README.
BPE_FILE, UNIGRAM_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.lmscore import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palisade.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, digest=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.chat import chat_digest, format_chats

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat_digest(format_chats(turns))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palisade.llm.unigram import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(UNIGRAM_FILE))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_lm_scoring, op3_bpe, op4_chat_format, op5_near_duplicates, op6_html_extract, op7_quality_rules, op8_decontaminate, op9_url_filters, op10_token_counts)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op4_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(s>|/s>|INST\]|/INST\]|PART\])', '\1\\\2', 'g') AS escaped,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN before = role THEN 6 ELSE 3 + length(role) + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END + 4 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM d
),
i AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM i),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT w.r, doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)
),
f AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, n_symbols > n_words AS f3, 100 * n_dup_lines > 30 * n_lines AS f4,
    word_chars > 15 * n_words OR word_chars < 2 * n_words AS f5
  FROM m
),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (f1 OR f2 OR f3 OR f4 OR f5) AS failed FROM f GROUP BY host),
fit AS (SELECT avg(failed / docs) AS mu, var_pop(failed / docs) AS v FROM h),
prior AS (SELECT mu, CASE WHEN v > 0 AND mu * (1 - mu) > v THEN mu * (1 - mu) / v - 1 ELSE 10.0 END AS weight FROM fit),
bad AS (SELECT host, (failed + mu * weight) / (docs + weight) > 0.5 AS rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2 OR f3 OR rejected) AS kept,
  array_to_string(list_filter([CASE WHEN f1 THEN 'short' END, CASE WHEN f2 THEN 'repeats' END, CASE WHEN f3 THEN 'symbols' END, CASE WHEN f4 THEN 'dup_lines' END, CASE WHEN f5 THEN 'word_length' END], lambda x: x IS NOT NULL), ',') AS failed_rules,
  rejected AS host_rejected
FROM f JOIN bad USING (host)
"""


def _url_sql() -> str:
    from palisade.llm.urls import RULES, TRACKING

    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: low.format(f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1)")
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    query = lambda u: rf"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '{TRACKING}', '', 'g'), '^&+', '')"
    key = lambda u: rf"CASE WHEN contains({u}, '://') THEN regexp_replace({host(u)}, '^(www|m)\.', '') || regexp_replace({path(u)}, '/+$', '') || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END END"
    site = "regexp_extract({}, '(?s)^(.*?://[^/?#]*)', 1)"
    code = r"CASE WHEN starts_with(lower(c), 'x') THEN CAST('0' || lower(c) AS INTEGER) ELSE CAST(c AS INTEGER) END"
    sign = f"CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE chr(65533) END"
    reference = r"'(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});'"
    decoded = lambda x: rf"regexp_replace(list_reduce(list_transform(list_zip(regexp_split_to_array({x}, {reference}), list_transform(regexp_extract_all({x}, {reference}, 1), lambda c: {sign})), lambda z: z[1] || coalesce(z[2], '')), lambda s, t: s || t), '(?i)&amp;', '&', 'g')"
    folded = lambda p: f"array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]), lambda seen, x: CASE WHEN x[1] = '..' THEN CASE WHEN len(seen) > 1 THEN seen[1:len(seen) - 1] ELSE seen END WHEN x[1] = '.' THEN seen ELSE list_concat(seen, x) END), '/')"
    dotless = lambda p: rf"CASE WHEN regexp_matches({p}, '(?s)/\.\.?(/|\z)') THEN {folded(p)} || CASE WHEN regexp_matches({p}, '(?s)/\.\.?\z') AND NOT ends_with({folded(p)}, '/') THEN '/' ELSE '' END ELSE {p} END"
    folder = lambda u: f"CASE WHEN contains({path(u)}, '/') THEN regexp_extract({path(u)}, '(?s)^(.*/)', 1) ELSE '/' END"

    def absolute(x: str, u: str) -> str:
        before, after = f"regexp_extract({x}, '(?s)^([^?#]*)', 1)", f"regexp_extract({x}, '(?s)^[^?#]*(.*)', 1)"
        return f"CASE WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {x} WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains({u}, '://') THEN NULL WHEN starts_with({x}, '//') THEN regexp_extract({u}, '(?s)^(.*?)://', 1) || ':' || {x} WHEN starts_with({x}, '/') THEN {site.format(u)} || {dotless(before)} || {after} WHEN {before} = '' THEN {site.format(u)} || {path(u)} || {after} ELSE {site.format(u)} || {dotless(f'({folder(u)} || {before})')} || {after} END"

    value = r"""\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
    base = rf"regexp_extract(coalesce(html, ''), '(?is)<base\b[^>]*\shref{value}', 1)"
    unquoted = lambda v: f"trim(CASE WHEN regexp_matches({v}, '^[\"'']') THEN {v}[2:-2] ELSE {v} END, ' ')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {rules}),
own AS (SELECT row_number() OVER () AS r, page_id, url, html, {host("url")} AS host, {path("url")} AS path, {key("url")} AS key FROM pages),
ruled AS (SELECT r, arg_max((h || p, v), (length(h || p), h || p)) AS hit FROM own JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
o AS (SELECT own.*, struct_extract(hit, 1) AS rule, struct_extract(hit, 2) AS ruled FROM own LEFT JOIN ruled USING (r)),
based AS (SELECT *, {unquoted(base)} AS base FROM own),
own2 AS (SELECT *, CASE WHEN base = '' THEN url ELSE coalesce({absolute("d", "url")}, url) END AS seen FROM (SELECT *, {decoded("base")} AS d FROM based)),
tags AS (
  SELECT key, seen, {unquoted("v")} AS x FROM (SELECT key, seen, regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1)), '(?is)\shref{value}', 1) AS v FROM own2)
  UNION ALL
  SELECT key, seen, regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1)), '(?is)\burl\s*=\s*[''"]?([^"''\s>;]+)', 1) AS x FROM own2
),
linked AS (SELECT key AS a, {absolute("y", "seen")} AS y FROM (SELECT key, seen, {decoded("x")} AS y FROM tags WHERE x <> '')),
e AS (SELECT a, {key("y")} AS b FROM linked),
named AS (SELECT DISTINCT y, {key("y")} AS key, {host("y")} AS host, {path("y")} AS path FROM linked WHERE contains(y, '://')),
met AS (SELECT key, ruled FROM o WHERE ruled IS NOT NULL UNION ALL SELECT arg_max(key, 0), arg_max(v, (length(h || p), h || p)) FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY y),
links AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT DISTINCT key, key FROM (SELECT key FROM own UNION SELECT key FROM named) WHERE key IS NOT NULL UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
part AS (SELECT a AS key, min(b) AS component FROM reach GROUP BY a),
grouped AS (SELECT component, bool_or(ruled = 'allow') AS allow, bool_or(ruled = 'block') AS block FROM met JOIN part USING (key) GROUP BY component)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN allow THEN 'allow' WHEN block THEN 'block' END, 'allow') AS verdict, ruled IS NULL AND (coalesce(allow, false) OR coalesce(block, false)) AS propagated
FROM o LEFT JOIN part USING (key) LEFT JOIN grouped USING (component)
"""


ORACLE_SQL["op9_url_filters"] = _url_sql()
