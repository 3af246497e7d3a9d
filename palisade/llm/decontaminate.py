"""Benchmark decontamination (DataFrame functions only).

A window is as long as the benchmark item that it is held against, less where the
document begins or ends. Each window gets a 64-bit SimHash of its words; an item's
fingerprint is found by blocks: of five blocks, two fingerprints within 19 bits of
each other agree in one to within three bits, so the items are stored under all
values so near to each of their blocks and a join by (length, block number, block)
finds every item in that radius. Pairs that it finds are verified by the exact
similarity of their shingle bags.

Windows that cannot be verified are never fingerprinted. A bag that reaches the
similarity t shares t * m shingles at least with an item of m, so that

* at least one of any m - t * m + 1 shingles of the item stands in the document: the
  item's rarest ones, by the number of items that hold them, name the documents, and
* at least t * m of the window's places hold shingles of the item, in any order: the
  places of all its shingles, in the documents named, give the windows.

Both hold for every window that reaches the similarity, wherever it stands and
however the item was rearranged, so nothing is lost by them. Equal texts are searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let, materialize, text_of, without, words_of

SHINGLE = 5
#: Bits of each block, bits in which fingerprints may differ there, and in all: some block differs in RADIUS / 5 bits at most.
BLOCK_BITS, BLOCK_RADIUS, RADIUS = (13, 13, 13, 13, 12), 3, 19
SIMILARITY = 0.8
#: Up to so many rows (some 40 bytes each) are broadcast; more are joined by a shuffle.
SENT_ROWS = 1_000_000
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "…“”„‘’«»¡¿–—"


def plain_words(text: Column) -> Column:
    """Lower-cased words without marks; those that are only marks go."""
    return words_of(F.lower(F.translate(text, MARKS, "")))


def shingle_at(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def shingles_of(words: Column) -> Column:
    """array<long>: the shingles of a list of words, repeats included."""
    return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: shingle_at(words, i))).otherwise(F.array().cast("array<long>"))


def simhash(words: Column) -> Column:
    """64 bits: whether more words' hashes have a bit set than not."""
    bits = [F.lit(1 << k if k < 63 else -(2**63)) for k in range(64)]

    def votes(hashes: Column) -> Column:
        more = lambda bit: F.aggregate(hashes, F.lit(0), lambda s, x: s + F.when(x.bitwiseAND(bit) != 0, 1).otherwise(-1)) > 0
        return F.aggregate(F.transform(F.array(*bits), lambda bit: F.when(more(bit), bit).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return let(F.transform(words, lambda w: F.xxhash64(w)), votes)


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, sum(BLOCK_BITS[:k])).bitwiseAND(F.lit((1 << BLOCK_BITS[k]) - 1)).cast("int")


def blocks_of(fingerprint: Column) -> Column:
    """array<struct<k, block>>"""
    return F.array(*[F.struct(F.lit(k).alias("k"), _block(fingerprint, k).alias("block")) for k in range(len(BLOCK_BITS))])


def near_blocks(fingerprint: Column) -> Column:
    """array<struct<k, block>>: all values within BLOCK_RADIUS bits of each block."""

    def near(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS[k]) - 1)), lambda x: x.cast("int"))
        masks = F.filter(every, lambda x: F.bit_count(x) <= BLOCK_RADIUS)
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("k"), _block(fingerprint, k).bitwiseXOR(m).alias("block")))

    return F.concat(*[near(k) for k in range(len(BLOCK_BITS))])


def first_near_block(apart: Column) -> Column:
    """Number of the first block in which fingerprints with this exclusive or are near."""
    found = F.lit(None).cast("int")
    for k in reversed(range(len(BLOCK_BITS))):
        found = F.when(F.bit_count(_block(apart, k)) <= BLOCK_RADIUS, F.lit(k)).otherwise(found)
    return found


def numbered(bag: Column) -> Column:
    """The bag as a set: equal values get different numbers."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True)))
        each = lambda a, b: F.transform(F.sequence(F.lit(0), b - a - 1), lambda j: F.xxhash64(F.get(s, a), j))
        return let(first, lambda f: F.flatten(F.zip_with(f, F.concat(F.slice(f, 2, F.size(s)), F.array(F.size(s))), each)))

    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), F.transform(bag, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(let(F.array_sort(bag), runs))


def bag_similarity(a: Column, b: Column) -> Column:
    """sum(min) / sum(max) of the counts in two bags, given as numbered sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, size) of the items that have five words at least; repeated rows once, null texts never."""
    items = benchmark.select(F.col(item_col).alias("item"), plain_words(text_of(text_col)).alias("words"))
    return items.where(F.size("words") >= SHINGLE).select("item", "words", F.size("words").alias("size")).distinct()


def _least(m: str, similarity: float) -> Column:
    """Shingles that an item of m shares at least with any bag that is similar to it."""
    return F.ceil(F.col(m) * similarity - 1e-9).cast("int")


def _sent(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Each row's text, known by two hashes of it."""
    text = text_of(text_col)
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _leaks(docs: DataFrame, items: DataFrame, text_col: str, similarity: float, radius: int) -> DataFrame:
    """(k1, k2, item, start, similarity) of each text and item."""
    if not 0 < similarity <= 1 or radius >= (BLOCK_RADIUS + 1) * len(BLOCK_BITS):
        raise ValueError("similarity in (0, 1], and fingerprints within the radius near each other in some block")
    code = F.xxhash64("words")
    known = items.groupBy(code.alias("code"), "size").agg(F.first("words").alias("words"))
    known = materialize(known.select("code", "size", shingles_of(F.col("words")).alias("shingles"), simhash(F.col("words")).alias("fp")), "items")
    places = known.select("code", "size", F.size("shingles").alias("m"), F.explode(F.array_distinct("shingles")).alias("shingle"))

    # Seeds: of each item's shingles the rarest, as many as can't all be missing.
    held = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    each = known.select("code", F.size("shingles").alias("m"), F.explode("shingles").alias("shingle")).join(held, "shingle")
    ranked = each.groupBy("code", "m").agg(F.array_sort(F.collect_list(F.struct("items", "shingle"))).alias("ranked"))
    spare = F.col("m") - _least("m", similarity)
    seeds = materialize(ranked.select("code", F.explode(F.slice("ranked", F.lit(1), spare + 1)).alias("s")).select("code", F.col("s.shingle").alias("shingle")).distinct(), "seeds")

    # One row for each word of a document, but no copy of its words: they are only read for shingles.
    # Outer, or the list would be made again by a filter on it below; rows without a shingle go by their place.
    words = _texts(docs, text_col).select("k1", "k2", plain_words(F.col("text")).alias("words"))
    rows = words.select("k1", "k2", "words", F.posexplode_outer("words").alias("at", "word")).where(F.col("at") + SHINGLE <= F.size("words"))
    rows = rows.select("k1", "k2", shingle_at(F.col("words"), F.col("at")).alias("shingle"))
    pairs = materialize(rows.join(_sent(seeds), "shingle").select("k1", "k2", "code").distinct(), "pairs")

    # The texts named, each once, and the places in them of all shingles of their items.
    named = _sent(pairs.select("k1", "k2").distinct())
    texts = _texts(docs, text_col).join(named, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = materialize(texts.select("k1", "k2", plain_words(F.col("text")).alias("words")), "texts")
    rows = texts.select("k1", "k2", "words", F.posexplode("words").alias("at", "word")).where(F.col("at") + SHINGLE <= F.size("words"))
    rows = rows.select("k1", "k2", "at", shingle_at(F.col("words"), F.col("at")).alias("shingle"))
    hits = rows.join(_sent(pairs.join(places, "code")), ["k1", "k2", "shingle"])
    hits = hits.groupBy("k1", "k2", "code", "size", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))

    # Starts of windows that hold enough of those places; before 0 where the document's begin cuts them.
    at, least = F.col("at"), _least("m", similarity)
    hits = hits.withColumn("least", least).where(F.size("at") >= F.col("least"))
    last = lambda i: F.get(at, i + F.col("least") - 1)
    full = F.filter(F.sequence(F.lit(0), F.size(at) - F.col("least")), lambda i: last(i) - F.get(at, i) < F.col("m"))
    spans = F.transform(full, lambda i: F.sequence(last(i) - F.col("m") + 1, F.get(at, i)))
    asked = hits.select("k1", "k2", "size", F.explode(F.array_distinct(F.flatten(spans))).alias("start")).groupBy("k1", "k2", "size").agg(F.collect_set("start").alias("starts"))
    begin = lambda s: F.greatest(s, F.lit(0))
    cut = F.transform("starts", lambda s: F.struct(begin(s).alias("start"), F.slice("words", begin(s) + 1, F.least(s + F.col("size"), F.size("words")) - begin(s)).alias("words")))
    windows = asked.join(texts, ["k1", "k2"]).select("k1", "k2", "size", F.explode(cut).alias("c")).select("k1", "k2", "size", F.col("c.start").alias("start"), F.col("c.words").alias("words"))
    windows = windows.select("k1", "k2", "size", "start", simhash(F.col("words")).alias("fp"), numbered(shingles_of(F.col("words"))).alias("bag"))
    windows = materialize(windows, "windows")

    # The index of the items' blocks; an item's shingles follow once a pair is near.
    index = known.select("code", F.col("size").alias("item_size"), F.col("fp").alias("item_fp"), F.explode(near_blocks(F.col("fp"))).alias("b"))
    index = materialize(index.select("code", "item_size", "item_fp", F.col("b.k").alias("item_k"), F.col("b.block").alias("item_block")), "blocks")
    probes = windows.select("*", F.explode(blocks_of(F.col("fp"))).alias("b")).select("k1", "k2", "size", "start", "fp", "bag", F.col("b.k").alias("k"), F.col("b.block").alias("block"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # A pair that is near in several blocks counts at the first of them.
    near = probes.join(_sent(index), (F.col("size") == F.col("item_size")) & (F.col("k") == F.col("item_k")) & (F.col("block") == F.col("item_block")) & (F.bit_count(apart) <= radius) & (F.col("k") == first_near_block(apart)))
    near = near.select("k1", "k2", "start", "bag", "code").join(known.select("code", numbered(F.col("shingles")).alias("item_bag")), "code")
    found = near.select("k1", "k2", "code", "start", bag_similarity(F.col("bag"), F.col("item_bag")).alias("similarity"))
    best = found.groupBy("k1", "k2", "code").agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"))).alias("best")).where(F.col("best.similarity") >= similarity)
    return best.join(items.select(code.alias("code"), "item"), "code").select("k1", "k2", "item", (-F.col("best.neg")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, item, start, similarity): each document and item that a window of it is similar to.

    ``start`` is the first word of the most similar window, counted over words that
    hold more than marks; the earliest of equals. Items of fewer than five words and null or
    empty texts match nothing. Documents that share an id, repeated rows included,
    give one row for each item; so do items that share one. An empty table of either
    kind gives an empty result. Null ids are kept as an id of their own. Of windows
    as similar as ``similarity``, those whose fingerprints differ in more than
    ``radius`` bits are not found.
    """
    leaks = materialize(_leaks(docs, items_of(benchmark, item_col, item_text_col), text_col, similarity, radius), "leaks")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")).join(_sent(leaks), ["k1", "k2"])
    best = rows.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("best.neg")).alias("start"), F.col("best.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    The verdict is the text's: documents with null, empty or short texts stay,
    repeated rows stay or go together, and the id is not looked at. An empty table
    gives an empty result; an empty benchmark leaves all documents.
    """
    text = text_of(text_col)
    bad = _leaks(docs, items_of(benchmark), text_col, similarity, radius).select(F.struct("k1", "k2").alias("key")).distinct()
    return without(docs, F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")), materialize(bad, "leaks"))
