"""Lines, blob identity, redaction, entropy and secret predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's splitlines() takes for a line's end.
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085  ]"

# Words that mark a stand-in for a secret.
PLACEHOLDERS = ("placeholder", "example", "changeme", "your_key_here", "mysecretpassword", "dummy", "test", "fake", "null", "none", "<secret>", "your-api-key")
PLACEHOLDER_STARTS = ("your_", "replace_", "example", "changeme", "enter_", "mock_", "dummy_")
PLACEHOLDER_INSIDE = r"(^|[^a-z0-9_])(your|replace|example|changeme|enter|mock|dummy)([^a-z0-9_]|$)"

# Fixed value: names of variables that hold secrets, between other characters than letters and digits.
SECRET_NAME = r"(?i)(^|[^A-Za-z0-9])(secret|password|passwd|api_key|token|auth_key|private_key|deploy_key)([^A-Za-z0-9]|$)"

# Shapes of known kinds of secret.
SECRET_PATTERNS = {
    "AWS_KEY": r"\b(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b",
    "GITHUB_TOKEN": r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,255}|github_pat_[A-Za-z0-9_]{82})\b",
    "SLACK_TOKEN": r"\bxox[baprs]-[A-Za-z0-9-]{10,120}\b",
    "SLACK_WEBHOOK": r"https://hooks\.slack\.com/services/T[0-9A-Za-z_]{8,14}/B[0-9A-Za-z_]{8,14}/[0-9A-Za-z_]{20,36}",
    "STRIPE_KEY": r"\b[rs]k_live_[0-9a-zA-Z]{16,99}\b",
    "OPENAI_KEY": r"\bsk-(?!(?:learn|learning|sklearn)\b)(?:proj-|svcacct-|admin-|live-)?[A-Za-z0-9_-]{20,128}\b",
    "GOOGLE_KEY": r"\bAIza[0-9A-Za-z_-]{30,50}\b",
    "PRIVATE_KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "JWT_TOKEN": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "URI_CREDENTIAL": r"\b(?:postgres(?:ql)?|mysql|mariadb|mongodb\+srv|mongodb|redis|rediss|amqps?|mssql|sqlserver|ftps?|ssh|ldap|jdbc)://[^\s:/@]{1,64}:[^\s@]{4,128}@[^\s]{3,}",
}

#: Of each kind, texts of which every match holds one.
SECRET_MARKS = {
    "AWS_KEY": ("AKIA", "ABIA", "ACCA", "ASIA"),
    "GITHUB_TOKEN": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "SLACK_TOKEN": ("xox",),
    "SLACK_WEBHOOK": ("hooks.slack.com",),
    "STRIPE_KEY": ("k_live_",),
    "OPENAI_KEY": ("sk-",),
    "GOOGLE_KEY": ("AIza",),
    "PRIVATE_KEY": ("PRIVATE KEY-----",),
    "JWT_TOKEN": ("eyJ",),
    "URI_CREDENTIAL": ("://",),
}

# Calls that run text as code or shell, by rule.
DANGEROUS_CALLS = {
    "eval": r"\beval\s*\(",
    "exec": r"\bexec\s*\(",
    "compile": r"\bcompile\s*\(",
    "os.system": r"\bos\.system\s*\(",
    "subprocess": r"\bsubprocess\.(?:run|call|Popen|check_output|check_call)\s*\(",
    "pickle.loads": r"\bpickle\.loads\s*\(",
    "yaml.load": r"\byaml\.load\s*\(",
    "innerHTML": r"\.innerHTML\s*=",
}

# What a secret must not reach, where tainted values come from, and what they must not reach.
SECRET_SINK = r"logger\.(?:info|error|warn|warning|debug|critical|exception)\s*\(|logging\.(?:info|error|warn|warning|debug|critical|exception)\s*\(|console\.(?:log|warn|error|info|debug)\s*\(|print\s*\(|requests\.(?:get|post|put|delete|patch|head|request)\s*\(|urllib\.request|http\.client|fetch\s*\(|axios\.(?:get|post|put|delete)\s*\(|(?:cursor\.)?(?:execute|executemany)\s*\(|open\s*\(|subprocess\.|os\.system\s*\(|pickle\.dump|yaml\.dump"
TAINT_SOURCE = r"request\.(?:args|form|json|data|values|get_json)|input\s*\(|sys\.argv|os\.environ|location\.(?:search|hash)|req\.(?:query|body|params)"
TAINT_SINK = r"execute\s*\(|executemany\s*\(|subprocess\.|os\.system\s*\(|open\s*\(|\.innerHTML\s*=|eval\s*\(|exec\s*\(|pickle\.loads\s*\("


def secret_matches(text: Column, kind: str) -> Column:
    """All matches of a kind of secret; the expression runs only on texts that hold one of the kind's marks."""
    marked = F.lit(False)
    for mark in SECRET_MARKS[kind]:
        marked = marked | F.contains(text, F.lit(mark))
    return F.when(marked, F.regexp_extract_all(text, F.lit(SECRET_PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def lines_of(text: Column) -> Column:
    """The lines of a text, without a last empty one."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def git_blob_id(content: Column) -> Column:
    """The name that Git gives a blob of this binary content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), content))


def redact(value: Column) -> Column:
    n = F.char_length(value)
    return F.when(n <= 8, "***").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(2)), F.lit(" (len="), n.cast("string"), F.lit(")")))


def assignment_name(line: Column) -> Column:
    """The identifier before the first equals sign; null if there is none."""
    last = F.element_at(F.split(F.trim(F.substring_index(line, "=", 1)), r"[ \t]+"), -1)
    return F.when(F.contains(line, F.lit("=")) & last.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), last)


#: ASCII characters, those first that are frequent in prose; any order gives the same counts.
OFTEN = " etaonirshdlcumfpgywbvk"
OFTEN += "".join(sorted({chr(i) for i in range(128)} - set(OFTEN)))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text.

    ASCII characters are taken out of the text one after the other, so that each is
    looked for only in what the ones before it left. The characters then left are
    sorted and their runs counted, however many are distinct.
    """
    state = lambda rest, left, bits: F.struct(rest.alias("rest"), left.alias("left"), bits.alias("bits"))

    def term(count: Column, n: Column) -> Column:
        return F.when(count > 0, count / n * F.log2(count / n)).otherwise(0.0)

    def whole(n: Column) -> Column:
        def take(s: Column, c: Column) -> Column:
            put = lambda rest: _once(F.char_length(rest), lambda left: state(rest, left, s["bits"] - term(s["left"] - left, n)))
            return F.when(s["left"] == 0, s).otherwise(_once(F.replace(s["rest"], c, F.lit("")), put))

        def runs(s: Column) -> Column:
            step = lambda r, c: F.when(r["rest"] == c, state(c, r["left"] + 1, r["bits"])).otherwise(state(c, F.lit(1), r["bits"] - term(r["left"], n)))
            characters = F.array_remove(F.sort_array(F.split(s["rest"], "")), "")
            return F.aggregate(characters, state(F.lit(""), F.lit(0), s["bits"]), step, lambda r: r["bits"] - term(r["left"], n))

        ascii_out = F.aggregate(F.array(*[F.lit(c) for c in OFTEN]), state(value, n, F.lit(0.0)), take)
        return _once(ascii_out, lambda s: F.when(s["left"] == 0, s["bits"]).otherwise(runs(s)))

    return F.when(value.isNotNull(), _once(F.char_length(value), whole))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_placeholder(value: Column) -> Column:
    v = F.lower(F.trim(value))
    starts = F.lit(False)
    for p in PLACEHOLDER_STARTS:
        starts = starts | F.startswith(v, F.lit(p))
    return v.isin(*PLACEHOLDERS) | starts | v.rlike(PLACEHOLDER_INSIDE)


def safe_detail(text: Column) -> Column:
    """A message without paths or control characters, 200 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(/[^\s/]+)+/?", "<path>"), r"[^\x20-\x7E]", ""), 1, 200)


def uri_path(path: Column) -> Column:
    """A path quoted for a URI, slashes kept."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def sampled(key: Column, version: str, percent: int = 5) -> Column:
    """Whether a key is among the ``percent`` of all that a digest picks."""
    limit = f"{2**256 * percent // 100:064x}"
    return F.sha2(F.concat(F.lit(version), F.unhex(F.lit("00")), F.encode(key, "utf-8")), 256) < limit
