"""Language-model scores of documents, learned from the corpus itself."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, sole_cache, text_of
from palisade.llm.lbl import END, LogBilinear, Vocabulary, laid_out, pieces, tokens_of

#: Frequent words have rows in the model: so many times the root of the training words, and at most so many, as they are broadcast (64 bytes a word at most).
BY_ROOT, FREQUENT, FREQUENT_CHARS = 10, 131_072, 16
#: Bytes of text that are split into words at once.
BYTES_AT_ONCE = 8 << 20
#: Words that are scored, or learned from, at once.
WORDS_AT_ONCE = 65_536
#: Documents are dealt to learners by what they hold, whatever the table's files and partitions: to as many as the root of the training words over this.
SHARD = 400_000
#: Steps of a whole number in which changes are added, so that their order does not matter.
UNITS = 1 << 24
#: Least and most tasks that add up the trained parameters, and rows of a table that stay together; the driver gets one set in all.
ADDERS, BLOCK = (16, 128), 4096

_LOADED: dict = {}


def _once(shared):
    """The vocabulary and model that a broadcast describes, made once in each worker process."""
    key, words, counts, total, types, tables = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        vocabulary = Vocabulary(words, counts, total, types)
        _LOADED[key] = vocabulary, tables
    sole_cache("lm", _LOADED.clear)
    vocabulary, tables = _LOADED[key]
    return vocabulary, LogBilinear(vocabulary.prior, tables)


def _slices(batch):
    """A batch in parts of BYTES_AT_ONCE of text, or of one longer text."""
    import pyarrow.compute as pc

    at, before = 0, np.append(0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64))
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(before, before[at] + BYTES_AT_ONCE, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _count(batches):
    import pyarrow as pa

    texts = 0
    for batch in batches:
        texts += batch.num_rows
        for part in _slices(batch):
            found = tokens_of(part.column("text"))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([texts], pa.int64())], ["word", "n"])


def _learn(shared):
    """Learns from the rows of each shard, which come together and in order, from the same start."""

    def encoded(vocabulary, batch):
        for part in _slices(batch):
            _, ids, stops = vocabulary.encode_all(part.column("text"))
            yield from zip(part.column("shard").to_pylist(), np.split(vocabulary.class_of[ids], stops[:-1]), strict=True)

    def run(batches):
        vocabulary, model = _once(shared)
        now, rng, start, texts, n, learned = None, None, [], [], 0, 0
        end = vocabulary.class_of[vocabulary.end]

        def step():
            for said, real in pieces(texts, end, rng, learned):
                model.learn(said, real, rng)

        def changes():
            step()
            for table, (before, after) in enumerate(zip(start, model.tables, strict=True)):
                met = model.met[table] if model.met else np.zeros(0, np.float32)
                rows = np.flatnonzero(met).astype(np.int32)
                for block in np.split(rows, np.flatnonzero(np.diff(rows // BLOCK)) + 1):
                    if len(block):
                        yield _moves([(table, int(block[0]) // BLOCK, block, met[block], ((after[block] - before[block]) * met[block, None]).astype(np.float32))])

        for batch in batches:
            for shard, said in encoded(vocabulary, batch):
                if shard != now:
                    if now is not None:
                        yield from changes()
                        model = _once(shared)[1]
                    now, rng, texts, n, learned = shard, np.random.default_rng(shard), [], 0, 0
                    start = [t.copy() for t in model.tables]
                texts.append(said)
                n += len(texts[-1])
                if n >= WORDS_AT_ONCE:
                    step()
                    texts, n, learned = [], 0, learned + n
        if now is not None:
            yield from changes()

    return run


MOVES = "t int, block int, rows binary, met binary, moved binary"


def _moves(found):
    import pyarrow as pa

    cols = zip(*[(t, b, rows.tobytes(), met.tobytes(), moved.tobytes()) for t, b, rows, met, moved in found], strict=True)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["t", "block", "rows", "met", "moved"])


def _unpacked(rows: bytes, met: bytes, moved: bytes, kind: type):
    rows = np.frombuffer(rows, np.int32)
    return rows, np.frombuffer(met, np.float32 if kind is np.float32 else np.int64), np.frombuffer(moved, kind).reshape(len(rows), -1)


def _add(batches):
    """Sums of whole numbers, the same in any order."""
    sums: dict = {}
    for batch in batches:
        for t, block, *packed in zip(*[batch.column(c).to_pylist() for c in ("t", "block", "rows", "met", "moved")], strict=True):
            rows, met, moved = _unpacked(*packed, np.float32)
            if (t, block) not in sums:
                sums[t, block] = np.zeros(BLOCK, np.int64), np.zeros((BLOCK, moved.shape[1]), np.int64)
            n, total = sums[t, block]
            n[rows - block * BLOCK] += met.astype(np.int64)
            total[rows - block * BLOCK] += np.rint(moved.astype(np.float64) * UNITS).astype(np.int64)
    for (t, block), (n, total) in sums.items():
        rows = np.flatnonzero(n).astype(np.int32)
        yield _moves([(t, block, rows + np.int32(block * BLOCK), n[rows], total[rows])])


DOC = "held_out boolean, n_tokens long, n_known long, base double, lm double, n_tail long, tails array<struct<word:string,n:int>>"


def _tails(tokens, ids, stops, vocabulary):
    """The words of each text that are not frequent, with how often it holds them."""
    import pyarrow as pa

    rest = np.flatnonzero(ids == vocabulary.tail)
    text = np.searchsorted(stops, rest, "right")
    ends = rest == stops[text] - 1  # the end itself may be rare
    words = pa.concat_arrays([tokens.take(pa.array((rest - text)[~ends])), pa.array([END] * int(ends.sum()), pa.string())])
    found = pa.table({"text": np.concatenate([text[~ends], text[ends]]), "word": words}).group_by(["text", "word"], use_threads=False).aggregate([([], "count_all")])
    found = found.sort_by("text").combine_chunks()
    begins = np.searchsorted(found["text"].to_numpy(), np.arange(len(stops) + 1))
    whole = lambda c, kind: pa.concat_arrays(found[c].cast(kind).chunks) if found.num_rows else pa.array([], kind)
    each = pa.StructArray.from_arrays([whole("word", pa.string()), whole("count_all", pa.int32())], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), each)


def _score(shared):
    def run(batches):
        import pyarrow as pa

        vocabulary, model = _once(shared)
        end = vocabulary.class_of[vocabulary.end]

        def rows(part):
            tokens, ids, stops = vocabulary.encode_all(part.column("text"))
            starts = np.append(0, stops[:-1])
            said, log, at = vocabulary.class_of[ids], np.empty(len(ids)), 0
            while at < len(stops):
                to = min(len(stops), int(np.searchsorted(stops, starts[at] + WORDS_AT_ONCE)) + 1)
                log[starts[at] : stops[to - 1]] = model.log10(*laid_out(np.split(said[starts[at] : stops[to - 1]], starts[at + 1 : to] - starts[at]), end))
                at = to
            log += vocabulary.share[ids]
            sums = lambda x: np.add.reduceat(x, starts)
            numbers = {
                "n_tokens": np.diff(stops, prepend=0),
                "n_known": sums(vocabulary.known[ids].astype(np.int64)),
                "base": sums(vocabulary.base[ids]),
                "lm": sums(log),
                "n_tail": sums((ids == vocabulary.tail).astype(np.int64)),
            }
            arrays = [pa.array(x) for x in numbers.values()]
            return pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *arrays, _tails(tokens, ids, stops, vocabulary)], ["id", "held_out", *numbers, "tails"])

        for batch in batches:
            for part in _slices(batch):
                yield rows(part)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Documents whose crc32 of the id as text leaves the remainder ``fold`` are held
    out; a null id counts as an empty text. All others are counted, whole, and the
    model learns from all of them: documents are dealt to shards by hashes of id and
    text, a number of shards that follows from the words counted; each shard is
    learned in order of those, from the same start, and each row's changes are
    averaged by how often a shard met it. So the scores do not depend on how the table
    is split (but for the last digits of single-precision products). base_score is the
    smoothed unigram's, score the model's; both are log10 of a text's probability.
    Null and empty texts hold the end alone. Repeated rows each count and each give a
    row; equal rows learn in one shard.
    An empty table gives an empty result.

    The frequent words' counts are broadcast (``FREQUENT`` at most; their number grows
    with the root of the training words). Counts of all
    others meet the documents in a join by word, which the frequent never enter.
    """
    import uuid

    spark = docs.sparkSession
    out_of = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold
    take = docs.select(F.col(id_col).alias("id"), out_of.alias("held_out"), text_of(text_col).alias("text"))
    train = take.where(~F.col("held_out")).select("text")
    counts = train.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")

    # The frequent words: counts at or above a bound that the sizes of logarithmic steps give.
    step = F.floor(F.log2("n") * 64)
    long_word = F.octet_length("word") > 4 * FREQUENT_CHARS
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()
    total, types = sum(r.tokens for r in steps), sum(r.types for r in steps)
    room, least = min(FREQUENT, math.ceil(BY_ROOT * total**0.5)), None
    for r in sorted(steps, key=lambda r: -r.step):
        room -= r.types
        if room < 0:
            break
        least = r.step
    is_frequent = (step >= least) & ~long_word if least is not None else F.lit(False)
    frequent = sorted(((r.word, r.n) for r in counts.where(is_frequent).collect()), key=lambda x: (-x[1], x[0]))
    words, numbers = [w for w, _ in frequent], np.array([n for _, n in frequent], np.float64)
    share = lambda tables: spark.sparkContext.broadcast((uuid.uuid4().hex, words, numbers, total, types, tables))

    vocabulary = Vocabulary(words, numbers, total, types)
    model = LogBilinear(vocabulary.prior)
    # Twice as many shards, each twice as large, for four times the words.
    shards = max(1, math.ceil((total / SHARD) ** 0.5))
    keys = [F.xxhash64("id", "text"), F.xxhash64(F.lit(1), "id", "text")]
    dealt = take.where(~F.col("held_out")).select(F.pmod(keys[0], F.lit(shards)).cast("int").alias("shard"), keys[0].alias("k1"), keys[1].alias("k2"), "text")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "k1", "k2").select("shard", "text")
    changes = dealt.mapInArrow(_learn(share(None)), MOVES)
    for r in changes.repartition(min(max(ADDERS[0], shards), ADDERS[1]), "t", "block").mapInArrow(_add, MOVES).toLocalIterator():
        rows, met, moved = _unpacked(r.rows, r.met, r.moved, np.int64)
        model.tables[r.t][rows] += (moved / (UNITS * met[:, None])).astype(np.float32)

    kind = take.schema["id"].dataType.simpleString()
    scored = take.mapInArrow(_score(share(model.tables)), f"id {kind}, {DOC}").withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    each = scored.select("row", F.explode("tails").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
    rare = counts.where(~is_frequent).select(F.col("word").alias("w"), F.col("n").alias("c"))
    each = each.join(rare, F.col("word") == F.col("w"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    mass = F.col("times") * F.log10(F.col("c") + 0.5)
    rest = each.groupBy(F.col("row").alias("r")).agg(F.sum(mass).alias("mass"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    mass, known = F.coalesce("mass", F.lit(0.0)), F.coalesce("known", F.lit(0))
    out = scored.drop("tails").join(rest, F.col("row") == F.col("r"), "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + mass - F.col("n_tail") * float(np.log10(vocabulary.all))).alias("base_score"),
        (F.col("lm") + mass - F.col("n_tail") * float(np.log10(vocabulary.rest))).alias("score"),
    )
