"""Near-duplicate classes: BagMinHash signatures, banding, exact verification.

Texts are compared as bags of five-word shingles; words are lower-cased and lose
marks at their ends. Copies collapse first: one text stands for all documents whose
words are the same. Texts that share a band's key meet in a bucket. No bucket is
expanded into its pairs: each round compares a bucket's members with some of them,
verifies those pairs exactly, and joins what is linked; members that are joined
already need no comparison. Rounds go on until, in each bucket, members that were
not compared with all others belong to one class. So every link between texts that
share a bucket is found or implied, whatever the bucket's size. A bucket of n texts
takes n / PIVOTS rounds at most; texts whose own shingles rule out any partner leave
before its members meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import bagminhash as bag
from palisade.llm.common import fresh, materialize, release, row_key, sole_cache, text_of, without
from palisade.llm.components import components

#: Texts this similar are near duplicates.
SIMILARITY = 0.8
#: Members of a bucket that all others are compared with, in a round after the first (about so many, of larger buckets).
PIVOTS = 1024
#: Up to so many keys of texts are broadcast (16 bytes each); more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Up to so many links (16 bytes each) one task joins to classes; more take distributed rounds.
LINKS_AT_ONCE = 250_000
#: Words that signatures are computed of at once.
WORDS_AT_ONCE = 300_000
#: What tells documents and texts apart: the id, a name of the row, two hashes of the text.
KEYS = ("id", "name", "k1", "k2")


def _sign(banding: tuple[int, int]):
    def run(batches):
        import pyarrow as pa

        def rows(part, bags, digests):
            full = [k for k, b in enumerate(bags) if len(b)]
            bands = nibbles = ()
            if full:
                sig = bag.signatures([bags[k] for k in full])
                bands, nibbles = bag.band_keys(sig, *banding), bag.slot_nibbles(sig)
            place = {k: i for i, k in enumerate(full)}
            lists = lambda x: pa.array([x[place[k]] if k in place else None for k in range(len(bags))], pa.list_(pa.int64()))
            made = {"digest": pa.array(digests, pa.binary()), "bands": lists(bands), "slots": lists(nibbles)}
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in KEYS), *made.values()], [*KEYS, *made])

        sole_cache("words", bag.forget_words)
        for batch in batches:
            at, bags, digests, n = 0, [], [], 0
            for k, text in enumerate(batch.column("text")):
                words = bag.word_hashes(text.as_py())
                digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                bags.append(bag.shingles(words))
                n += len(words)
                if n >= WORDS_AT_ONCE:
                    yield rows(batch.slice(at, k + 1 - at), bags, digests)
                    at, bags, digests, n = k + 1, [], [], 0
            if bags:
                yield rows(batch.slice(at), bags, digests)

    return run


def _bags(batches):
    import pyarrow as pa

    sole_cache("words", bag.forget_words)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            out = [np.sort(bag.shingles(bag.word_hashes(t.as_py()))).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(out, pa.binary())], ["node", "bag"])


def _counted(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            nodes, own, counts = [], [], []
            for node, b in zip(batch.column("node").slice(at, 64).to_pylist(), batch.column("bag").slice(at, 64), strict=True):
                u, c = np.unique(np.frombuffer(b.as_py(), np.int64), return_counts=True)
                nodes.append(np.full(len(u), node))
                own.append(u)
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, own, counts)], ["node", "shingle", "n"])


def _sized(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            bags = [np.frombuffer(b.as_py(), np.uint64) for b in part.column("bag")]
            more = bag.slot_nibbles(bag.signatures(bags, bag.MORE_SLOTS, salt=1))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(map(len, bags), pa.int64()), pa.array(list(more), pa.list_(pa.int64()))], ["rep", "size", "more"])


def _alike(least: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sim = [bag.bag_similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)]
            keep = pa.array([s >= least for s in sim], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def equal_slots(a: Column, b: Column, slots: int = bag.SLOTS) -> Column:
    """Number of equal slots in two lists of packed slots."""
    total = F.lit(slots)
    for k in range((slots + 15) // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


class NearDuplicates:
    """The tables of one run. Distinct texts are known by numbers of their own."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, similarity: float):
        if not 0 < similarity <= 1:
            raise ValueError("similarity in (0, 1]")
        self.similarity, banding = similarity, bag.banding(similarity)
        self.bands = banding[0]
        self.least, self.least_more = bag.least_equal(similarity, bag.SLOTS), bag.least_equal(similarity, bag.MORE_SLOTS)
        text = text_of(text_col)
        self.docs = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("name"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
        kind = self.docs.schema["id"].dataType.simpleString()
        signed = self.docs.mapInArrow(_sign(banding), f"id {kind}, name string, k1 long, k2 long, digest binary, bands array<long>, slots array<long>")
        # Of the rows of a class that with the least id stands for it, rows without an id last; they get a number of their text.
        number = F.xxhash64("k1", "k2").bitwiseOR(F.lit(-(2**63)))
        own = F.coalesce("id", number.cast(kind) if kind in ("bigint", "string") else F.lit(None).cast(kind))
        self.signed = materialize(signed.withColumn("best", F.struct(F.col("id").isNull().alias("none"), own.alias("own"), "name")), "signed")
        with_words = self.signed.where("digest is not null")
        texts = with_words.groupBy("digest").agg(F.min("best").alias("best"), F.min(F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
        self.texts = materialize(texts.withColumn("rep", F.monotonically_increasing_id()), "texts")
        keys = self.texts.select("rep", F.posexplode("bands").alias("band", "key"))
        # The first round's pivot of a bucket; by another order in each, so that a text meets several.
        heads = keys.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
        self.members = materialize(keys.join(heads, "key").select("key", "band", "rep", "pivot").distinct(), "members")
        self.bags = None

    def links(self) -> DataFrame:
        """(a, b): verified links; with what equal texts imply, they give the classes."""
        slots = self.texts.select("rep", "slots")
        first = self.members.where("rep <> pivot").join(slots, "rep").join(slots.select(F.col("rep").alias("pivot"), F.col("slots").alias("slots_b")), "pivot")
        near = first.where(equal_slots(F.col("slots"), F.col("slots_b")) >= self.least).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        tried = materialize(near.distinct(), "tried")
        edges = materialize(self._verified(tried), "links")
        done = materialize(self.members.where("rep = pivot").select("key", "rep"), "done")
        facts, turn = None, 0
        while True:
            labels = materialize(components(edges, one_task=LINKS_AT_ONCE), "labels")
            every = self.members.select("key", "band", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
            every = every.select("key", "band", "rep", F.coalesce("component", "rep").alias("label"))
            waiting = every.join(done, ["key", "rep"], "left_anti")
            sizes = waiting.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
            most = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("top"))
            few = waiting.join(most, "key").where("label <> top").drop("top", "labels")
            # Of a large bucket as many as PIVOTS by a hash, the least one always; counts and minima need no row of a key beside another.
            rest = few.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"))
            drawn = F.pmod(F.xxhash64("key", "rep", F.lit(turn)), F.lit(2**32)) * F.col("n") < F.lit(PIVOTS * 2**32)
            pivots = materialize(few.join(rest, "key").where((F.col("n") <= PIVOTS) | (F.col("rep") == F.col("least")) | drawn).select("key", "band", "rep", "label"), "pivots")
            turn += 1
            if not pivots.take(1):
                return edges
            others = every.join(pivots.select("key").distinct(), "key", "left_semi")
            if facts is None:
                facts = materialize(self._facts(others.select("rep").distinct()), "facts")
            # A text whose own shingles are over a fifth of it is similar to none.
            could = facts.where(F.col("size") - F.col("alone") >= self.similarity * F.col("size"))
            sided = lambda t, x: t.join(could, "rep").select(*[F.col(c).alias(f"{c}_{x}") for c in ("key", "band", "rep", "label", "size", "alone", "slots", "more", "bands")])
            c = F.col
            shared = F.least(c("size_a") - c("alone_a"), c("size_b") - c("alone_b"))
            possible = shared >= self.similarity * (c("size_a") + c("size_b") - shared)
            # A pair that shares several buckets is made in the first of them.
            before = F.exists(F.lit(list(range(self.bands))), lambda j: (j < c("band_a")) & (F.get("bands_a", j) == F.get("bands_b", j)))
            meet = sided(others, "a").join(sided(pivots, "b"), (c("key_a") == c("key_b")) & (c("label_a") != c("label_b")) & possible & (equal_slots(c("slots_a"), c("slots_b")) >= self.least) & (equal_slots(c("more_a"), c("more_b"), bag.MORE_SLOTS) >= self.least_more) & ~before)
            new = meet.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
            new = materialize(new, "tried")
            found = materialize(edges.union(self._verified(new)), "links")
            now = materialize(done.union(pivots.select("key", "rep")), "done")
            all_tried = materialize(tried.union(new), "tried")
            for old in (edges, done, tried, new, pivots):
                release(old)
            edges, done, tried = found, now, all_tried

    def _facts(self, reps: DataFrame) -> DataFrame:
        """(rep, size, alone, slots, more, bands): a text's shingles, and how many of them no other of these texts has.

        No pair can share the latter, which bounds its similarity without looking at
        it. A longer signature tells likely pairs from others more sharply.
        """
        bags = self.bags.where("length(bag) > 0").join(reps.select(F.col("rep").alias("node")), "node")
        each = bags.mapInArrow(_counted, "node long, shingle long, n int")
        own = each.groupBy("shingle").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).where("texts = 1")
        alone = own.groupBy("rep").agg(F.sum("n").alias("alone"))
        sized = bags.mapInArrow(_sized, "rep long, size long, more array<long>")
        return self.texts.select("rep", "slots", "bands").join(sized, "rep").join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        if self.bags is None:
            need = self.texts.join(self.members.select("rep").distinct(), "rep").select("rep", "k.k1", "k.k2")
            need = materialize(need, "need")
            asked = F.broadcast(need) if need.limit(SENT_IDS + 1).count() <= SENT_IDS else need
            texts = self.docs.select("k1", "k2", "text").join(asked, ["k1", "k2"]).groupBy("rep").agg(F.first("text").alias("text"))
            self.bags = materialize(texts.select(F.col("rep").alias("node"), "text").mapInArrow(_bags, "node long, bag binary"), "bags")
        side = lambda x: self.bags.where("length(bag) > 0").select(F.col("node").alias(x), F.col("bag").alias(f"bag_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bag_a", "bag_b")
        return both.mapInArrow(_alike(self.similarity), "a long, b long").distinct()

    def classes(self) -> DataFrame:
        """(id, name, best, class) of each document; class is the best of its class."""
        labels = components(self.links(), one_task=LINKS_AT_ONCE).select(F.col("node").alias("rep"), "component")
        linked = self.texts.select("rep", "best").join(labels, "rep")
        heads = linked.groupBy("component").agg(F.min("best").alias("class"))
        moved = materialize(linked.join(heads, "component").select("rep", "class"), "moved")
        texts = self.texts.select("digest", "rep", "best").join(moved, "rep", "left").select("digest", F.coalesce("class", "best").alias("class"))
        known = self.signed.select("id", "name", "best", "digest").where("digest is not null").join(texts, "digest").select("id", "name", "best", "class")
        return known.union(self.signed.where("digest is null").select("id", "name", "best", F.col("best").alias("class")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: that of the least id.

    Rows without an id come last. Of rows of a class that share the id, the one
    whose key is the least stays; unlike texts that share an id are in different
    classes, so each stays. Of equal rows one stays, those without words (null and
    empty texts) included. An empty table gives an empty result.
    """
    known = materialize(NearDuplicates(docs, id_col, text_col, similarity).classes(), "classes")
    name = row_key(id_col, text_col)
    more = known.where(F.col("name") != F.col("class.name")).select("name")
    kept = without(docs, name, materialize(more, "dropped"))
    twice = materialize(known.where(F.col("name") == F.col("class.name")).groupBy("name").count().where("count > 1").select("name"), "twice")
    if not twice.take(1):
        return kept
    # Equal rows that stay: one of each.
    own = fresh(docs, "name")
    again = kept.withColumn(own, name).join(twice.select(F.col("name").alias(own)), own, "left_semi").dropDuplicates([own]).select(docs.columns)
    return without(kept, name, twice).union(again)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, duplicate) of each document.

    A class is a connected set of texts whose weighted Jaccard similarity is at
    least ``similarity``, down to 0.08; its id is its least document id. Documents
    without words are alone in their class; those of fewer than five words are
    compared as a whole. Ids are of any orderable type. Unlike texts that share an
    id are told apart. A null id never gives the class id, unless no document of
    the class has one: then, for ids that are longs or strings, a negative number
    of the text does, else null. Repeated rows share a class. An empty table gives
    an empty result.
    """
    found = NearDuplicates(docs, id_col, text_col, similarity).classes()
    return found.select(F.col("id").alias(id_col), F.col("class.own").alias("class_id"), (~F.col("best.own").eqNullSafe(F.col("class.own"))).alias("duplicate"))
