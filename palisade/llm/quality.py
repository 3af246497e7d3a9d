"""Quality rules with host verdicts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import BLANK, let, materialize, row_key, text_of, without, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in the windows that are looked for twice.
WINDOW = 8
#: A host goes if its shrunk share of failing documents is above this.
HOST_SHARE = 0.5
#: Up to so many rejected hosts are broadcast; more are joined by a shuffle.
SENT_HOSTS = 50_000


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows that occur twice or more in the list.

    Each window is hashed from two halves. A list whose hashes all differ, the usual case,
    ends there; in others the hashes are sorted with their places, equal
    neighbours are marked, and the marked windows' union is measured.
    """
    none = F.lit(0).cast("long")
    width = 1
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # Windows of 2, 4, ... words from two halves each; the last width - 1 places have no full window.
    while width < window:
        step = min(width, window - width)
        hashes = let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda x, y: F.xxhash64(x, y)))  # noqa: B023
        width += step
    hashes = F.slice(hashes, F.lit(1), F.size(words) - (window - 1))

    def covered(h: Column) -> Column:
        paired = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(z: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(z, i)["h"] == x["h"], F.lit(False))
            twice = F.filter(z, lambda x, i: same(i - 1, x) | same(i + 1, x))
            start = F.struct(F.lit(-window).alias("last"), none.alias("n"))
            return F.aggregate(
                F.array_sort(F.transform(twice, lambda x: x["i"])),
                start,
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(window))).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(paired, marked))

    return F.when(F.size(words) <= window, none).otherwise(let(hashes, covered))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts that the rules use, a row for each document."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK, "") != "")
    length = lambda c: F.char_length(c).cast("long")
    counted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), text_of(text_col).alias("text")).select("id", "host", "text", words_of(text).alias("words"), lines.alias("lines"))
    return counted.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        length(F.translate(text, BLANK, "")).alias("word_chars"),
        (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


#: name: condition of failure. The first two are the base rules.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
}


def host_verdicts(measured: DataFrame, share: float = HOST_SHARE) -> DataFrame:
    """(host, docs, failed, shrunk, rejected): failures of any rule by host.

    The prior is a beta distribution fitted to the hosts' rates by moments; hosts
    count alike. Without spread between hosts it weighs as ten documents.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("failed").cast("boolean").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    fit = hosts.agg(F.avg(rate).alias("mu"), F.var_pop(rate).alias("var"))
    weight = F.when((F.col("var") > 0) & (F.col("mu") * (1 - F.col("mu")) > F.col("var")), F.col("mu") * (1 - F.col("mu")) / F.col("var") - 1).otherwise(F.lit(10.0))
    fit = fit.select("mu", weight.alias("weight"))
    shrunk = (F.col("failed") + F.col("mu") * F.col("weight")) / (F.col("docs") + F.col("weight"))
    return hosts.join(F.broadcast(fit)).select("host", "docs", "failed", shrunk.alias("shrunk"), (shrunk > share).alias("rejected"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = HOST_SHARE) -> DataFrame:
    """The documents that judge_quality keeps, with all their columns."""
    key = row_key(id_col, text_col, host_col)
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    bad = judge_quality(keyed, "key", "text", "host", share).where("not kept").select("key")
    return without(docs, key, materialize(bad, "rejected"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = HOST_SHARE) -> DataFrame:
    """Measures, failed rules and verdict of each document.

    kept is false if a base rule fails, if symbols outnumber words, or if the
    document's host is rejected. Null texts are empty and fail; documents with a
    null host share the host ''. Repeated rows are judged and counted each. An
    empty table gives an empty result.
    """
    m = measures(docs, id_col, text_col, host_col)
    failed = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in RULES.items()]))
    m = materialize(m.withColumn("failed", failed), "quality")
    bad = host_verdicts(m, share).where("rejected").select(F.col("host").alias("h"), "shrunk")
    # Rejected hosts are few: sent to all tasks if so, documents stay where they are.
    bad = F.broadcast(bad) if bad.limit(SENT_HOSTS + 1).count() <= SENT_HOSTS else bad
    out = m.join(bad, F.col("host") == F.col("h"), "left")
    base = F.array_contains("failed", "short") | F.array_contains("failed", "repeats")
    kept = ~base & ~F.array_contains("failed", "symbols") & F.col("h").isNull()
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"), F.array_join("failed", ",").alias("failed_rules"), F.col("h").isNotNull().alias("host_rejected")
    )
