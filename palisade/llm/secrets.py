"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fresh, materialize, text_of

#: Base kinds in their order: pattern, group that holds the secret, least length of that group.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
]
#: A base pattern is only tried on texts that hold one of these (lower-cased for the first).
HINTS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("AKIA",)}
#: Further kinds: hint that must be in the text, pattern, group.
MORE = [
    ("vendor", ("ghp_", "gho_", "ghs_", "sk_live_", "xox", "AIza"), re.compile(r"(?<![A-Za-z0-9])(?:gh[pos]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"), 0),
    ("jwt", ("eyJ",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("pem", ("PRIVATE KEY-----",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END (?:[A-Z]+ )*PRIVATE KEY-----"), 0),
    ("uri", ("://",), re.compile(r"://[^\s/:@\"'<>]+:([^\s/:@\"'<>]{6,})@"), 1),
]
#: The last kind: a secret itself, within a span of any kind, that is live by its ownership over the corpus.
KINDS = [k for k, *_ in BASE] + [k for k, *_ in MORE] + ["live"]
#: A secret that this many owners, or repositories, hold is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6

#: Holds for every text that can hold a candidate (and for some others).
MAY_HOLD = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|gh[pos]_|sk_live_|xox|AIza|eyJ|PRIVATE KEY-----|://"

CANDIDATE = "struct<start:int,rank:int,stop:int,base:boolean,hash:string,at:int,to:int>"
SCANNED = f"id {{id}}, repo string, owner string, text_key string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{CANDIDATE}>"


def find_secrets(text: str) -> list[tuple[int, int, int, bool, str, int, int]]:
    """(start, rank of kind, end, base kind?, hash of the secret, the secret's start and end), sorted."""
    found = []
    low = None
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign":
            low = text.lower()
        if any(h in (low if kind == "assign" else text) for h in HINTS.get(kind, ("",))):
            found += [(m.start(), rank, m.end(), True, *m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    # What base spans cover, as disjoint stretches in order: further kinds stay out of them.
    begins, ends = [], []
    for a, _, b, *_ in sorted(found):
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            begins.append(a)
            ends.append(b)
    for rank, (_, hints, pattern, group) in enumerate(MORE, len(BASE)):
        if any(h in text for h in hints):
            for m in pattern.finditer(text):
                k = bisect.bisect_right(ends, m.start())
                if k == len(ends) or begins[k] >= m.end():
                    found.append((m.start(), rank, m.end(), False, *m.span(group)))
    return sorted((a, k, b, base, hashlib.blake2b(text[s:e].encode("utf-8", "replace"), digest_size=16).hexdigest(), s, e) for a, k, b, base, s, e in found)


def spans_text(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in found)


def _scan(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("hash", pa.string()), ("at", pa.int32()), ("to", pa.int32())]))
    names = ("start", "rank", "stop", "base", "hash", "at", "to")
    for batch in batches:
        out = {k: [] for k in ("text_key", "n_assign", "n_access", "n_hex", "base_sha256", "found")}
        for text in batch.column("text").to_pylist():
            found = find_secrets(text)
            base = [x for x in found if x[3]]
            for r, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == r for x in base))
            out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            out["text_key"].append(hashlib.sha256(text.encode()).hexdigest() if found else None)
            out["found"].append([dict(zip(names, x, strict=True)) for x in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("repo"), batch.column("owner"), pa.array(out["text_key"], pa.string())]
            + [pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")]
            + [pa.array(out["base_sha256"], pa.string()), pa.array(out["found"], kind)],
            ["id", "repo", "owner", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each document with its candidates, written to the shared folder.

    Null texts are empty. Null owners count as the owner ''. Repeated rows each
    give a row; ``row`` tells them apart.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    take = docs.select(F.col(id_col).alias("id"), F.concat_ws("/", *[part(c) for c in repo_cols]).alias("repo"), part(owner_col).alias("owner"), text_of(text_col).alias("text"))
    scanned = take.mapInArrow(_scan, SCANNED.format(id=take.schema["id"].dataType.simpleString()))
    return materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(hash, owners, repos, live) of each candidate secret over the corpus.

    Live: few owners and few repositories hold it. Counts level by level, each
    combined before its shuffle, so a secret that stands in a third of all documents
    reaches no task as that many rows.
    """
    seen = scanned.where("size(found) > 0").select("owner", "repo", F.explode("found.hash").alias("hash")).distinct()
    # One row for each owner and each repository of a secret; then both are counted at once.
    side = lambda c, is_owner: seen.select("hash", F.col(c).alias("by"), F.lit(is_owner).alias("is_owner"))
    by = side("owner", True).union(side("repo", False)).distinct()
    counted = by.groupBy("hash").agg(F.count_if("is_owner").alias("owners"), F.count_if(~F.col("is_owner")).alias("repos"))
    return counted.withColumn("live", (F.col("owners") < example_owners) & (F.col("repos") < example_repos))


def judged(scanned: DataFrame, key: str, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(key, hits): each document's candidates with the counts and the verdict on their secrets."""
    each = scanned.where("size(found) > 0").select(key, F.explode("found").alias("c")).select(key, "c", F.col("c.hash").alias("hash"))
    each = each.join(ownership(scanned, example_owners, example_repos), "hash")
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c.start", "c.rank", "c.stop", "c.base", "live", "c.at", "c.to", "owners", "repos"))).alias("hits"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Counts and spans of secrets in each document.

    Base spans always stay. Spans of further kinds are added where the secret is
    live: fewer than ``example_owners`` owners and ``example_repos`` repositories hold
    it. A live secret of any kind also gives a span of its own, without what it is
    assigned to, of the kind ``live``; equal ones are one. n_live and n_example tell
    how many of a document's candidates, base ones included, are of either sort;
    most_owners and most_repos how many hold its most widely copied secret (0: none).
    Empty and null texts have no spans, null owners and repositories count as ''.
    Repeated rows each give a row but count once. An empty table gives an empty result.
    """
    scanned = scan_documents(docs, id_col, text_col, owner_col, repo_cols)
    hits = judged(scanned, "row", example_owners, example_repos).withColumnRenamed("row", "r")
    none = scanned.where("size(found) = 0").select("*", F.lit(None).cast(hits.schema["hits"].dataType).alias("hits"))
    some = scanned.where("size(found) > 0").join(hits, F.col("row") == F.col("r")).select(none.columns)
    kinds = F.array(*map(F.lit, KINDS))
    span = lambda start, rank, stop: F.struct(start.alias("start"), rank.alias("rank"), stop.alias("stop"))
    kept = F.transform(F.filter("hits", lambda h: h["base"] | h["live"]), lambda h: span(h["start"], h["rank"], h["stop"]))
    live = F.array_distinct(F.transform(F.filter("hits", lambda h: h["live"]), lambda h: span(h["at"], F.lit(len(KINDS) - 1), h["to"])))
    spans = F.array_sort(F.concat(kept, live))
    count = lambda test: F.coalesce(F.size(F.filter(F.coalesce("hits", F.array()), test)), F.lit(0)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.col(f"hits.{c}")), F.lit(0)).cast("long")
    return some.union(none).select(
        F.col("id").alias(id_col),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(F.transform(spans, lambda h: F.concat(F.get(kinds, h["rank"]), F.lit(":"), h["start"], F.lit(":"), h["stop"])), ","), F.lit("")).alias("spans"),
        count(lambda h: h["live"]).alias("n_live"),
        count(lambda h: ~h["live"]).alias("n_example"),
        most("owners").alias("most_owners"),
        most("repos").alias("most_repos"),
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), mask: str = "[secret]", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """docs with every live secret's span in the text replaced by ``mask``.

    Widely copied examples stay. Spans that overlap are masked as one. A verdict
    belongs to a text, so documents are matched by text, and only those that hold
    a candidate at all are looked up. Every row stays, repeated ones and those with
    null or empty texts as they are; null owners and repositories count as ''. An
    empty table gives an empty result.
    """
    scanned = scan_documents(docs, id_col, text_col, owner_col, repo_cols).where("text_key is not null")
    once = scanned.groupBy("text_key").agg(F.first("found").alias("found"))
    each = once.select("text_key", F.explode("found").alias("c")).select("text_key", F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.col("c.hash").alias("hash"))
    live = each.join(ownership(scanned, example_owners, example_repos).where("live").select("hash"), "hash")
    key, spans = fresh(docs, "cut_key"), fresh(docs, "cuts")
    cuts = materialize(live.groupBy(F.col("text_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans)), "cuts")
    text = F.col(text_col)
    may = F.coalesce(text.rlike(MAY_HOLD), F.lit(False))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(a, c):
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, c["start"] - a["at"]), F.lit(mask))
        return F.struct(F.greatest(a["at"], c["stop"]).alias("at"), F.when(c["start"] >= a["at"], out).otherwise(a["out"]).alias("out"))

    masked = F.aggregate(spans, start, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**31 - 1))))
    some = docs.where(may).join(cuts, F.sha2(text, 256) == F.col(key), "left")
    some = some.withColumn(text_col, F.when(F.col(spans).isNotNull(), masked).otherwise(text)).select(docs.columns)
    return some.union(docs.where(~may))
