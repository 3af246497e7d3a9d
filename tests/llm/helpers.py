"""Small tables with every odd case, and brute-force forms of the operators."""

import random
import re

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return BLANKS.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    pool = [f"w{k}x" for k in range(vocabulary)]
    return " ".join(rng.choice(pool) for _ in range(n))


def edited(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def docs(spark, rows, extra=False):
    """rows: (id, text[, lang, source]). With extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src1")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("id", "node", "key", "word", "words", "start", "item", "row", "kept", "host", "digest", "label", "text_key", "n_tokens", "_bad", "bad", "_name", "name", "_cuts", "_cut_key", "cuts", "cut_key", "_owned", "best", "class", "k1", "k2", "code", "size", "hash", "owner"):
            df = df.withColumn(c, F.lit("clash"))
    return df


ODD = [
    (1, None, "en", "src1"),
    (2, "", "en", None),
    (3, " \t\n\x0b\x0c\r ", None, "src1"),
    (4, "one", "en", "src1"),
    (5, "one", "en", "src1"),
    (None, "no id here at all, but some words to read", "en", "src2"),
    (7, "twice", "en", "src1"),
    (7, "twice", "en", "src1"),
    (8, "long " * 30000, "en", "src2"),
    (9, "\x85\xa0 \x1c é漢😀 ſ İ", "fr", "src3"),
]
