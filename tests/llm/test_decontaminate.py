import random
from collections import Counter

from pyspark.sql import functions as F

from palisade.llm.decontaminate import MARKS, RADIUS, bag_similarity, blocks_of, contaminated, first_near_block, keep_clean, near_blocks, numbered, simhash
from tests.llm.helpers import ODD, docs, edited, prose


def plain(text):
    return [w for w in (text or "").translate(str.maketrans("", "", MARKS)).lower().split() if w]


def brute(rows, items, least=0.8):
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    found = {}
    for i, text, *_ in rows:
        w = plain(text)
        for item, it in items:
            v = plain(it)
            if len(v) < 5:
                continue
            b = bag(v)
            for s in range(-len(v), len(w)):
                a = bag(w[max(s, 0) : s + len(v)])
                m = (a & b).total()
                sim = m / max(1, a.total() + b.total() - m)
                if sim >= least and sim > found.get((i, item), 0):
                    found[i, item] = sim
    return found


ITEMS = [(1, prose(11, 30)), (2, prose(12, 50) + "."), (3, "too short item"), (4, None), (5, "Five words are just enough"), (6, ("again and " * 9).strip())]


def rows_with_leaks():
    a, b = ITEMS[0][1], ITEMS[1][1]
    rows = [(100, prose(21, 200) + " " + a + " " + prose(22, 50)), (101, b.upper() + " !!! " + prose(23, 40)), (102, prose(24, 60) + "\n" + edited(b, 5, 1)), (103, edited(b, 6, 4)), (104, a[: len(a) // 2]), (105, "pre five, words; are JUST enough post"), (106, "again and " * 30), (107, a + " | " + a + " " + b)]
    return rows + [(200 + k, prose(k, 70)) for k in range(5)] + ODD


def test_equals_brute_force(spark):
    rows = rows_with_leaks()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs(spark, rows, extra=True), bench).collect()}
    want = brute(rows, ITEMS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = keep_clean(docs(spark, rows), bench)
    assert kept.count() == len(rows) - len({i for i, _ in want})


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contaminated(docs(spark, []), bench).collect() == []
    assert contaminated(docs(spark, ODD), bench.limit(0)).collect() == []


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_any_fingerprints_within_the_radius_are_near_in_a_block(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, RADIUS)):
            b ^= 1 << k
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    first = first_near_block(F.col("a").bitwiseXOR(F.col("b")))
    for r in df.select(blocks_of(F.col("a")).alias("x"), near_blocks(F.col("b")).alias("y"), first.alias("first")).collect():
        stored = {(y.k, y.block) for y in r.y}
        met = [x.k for x in r.x if (x.k, x.block) in stored]
        assert met and r.first == met[0] and len(stored) == len(r.y) == 4 * 378 + 299


def moved(text, rng):
    """The text with its halves swapped, its sentences moved, or words put in, taken out or cut off."""
    w = text.split()
    k = rng.randrange(len(w))
    kind = rng.randrange(6)
    if kind == 0:
        return " ".join(w[len(w) // 2 :] + w[: len(w) // 2])
    if kind == 1:
        return " ".join(w[k:] + w[:k])
    if kind == 2:
        return " ".join([*w[:k], *(f"new{j}" for j in range(rng.randint(1, 4))), *w[k:]])
    if kind == 3:
        return " ".join(w[:k] + w[k + rng.randint(1, 3) :])
    if kind == 4:
        return " ".join(w[rng.randint(0, len(w) // 5) :])
    return " ".join(w[: len(w) - rng.randint(0, len(w) // 5)])


def test_moved_and_split_passages_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(300 + k, rng.randint(12, 90))) for k in range(12)]
    items += [(20, "red green " * 20 + prose(330, 10)), (21, items[0][1] + " " + prose(331, 8)), (22, items[0][1])]
    rows = [(1, moved(prose(400, 60), random.Random(0)))]
    for k in range(240):
        left, right = (prose(500 + 2 * k + j, rng.choice((0, 3, 40))) for j in (0, 1))
        rows.append((10 + k, f"{left} {moved(rng.choice(items)[1], rng)} {right}"))
    bench = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs(spark, rows), bench).collect()}
    want = brute(rows, items)
    assert len(want) > 150 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_swapped_halves_are_found(spark):
    w = [f"word{k}" for k in range(60)]
    item = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    (r,) = contaminated(docs(spark, [(5, " ".join(w[30:] + w[:30])), (6, " ".join(w[::-1]))]), item).collect()
    assert r.doc_id == 5 and abs(r.similarity - 52 / 60) < 1e-9


def test_similarity_of_bags_with_repeats(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(12))], [rng.randrange(6) for _ in range(rng.randrange(12))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for r in df.select("a", "b", bag_similarity(numbered(F.col("a")), numbered(F.col("b"))).alias("s")).collect():
        a, b = Counter(r.a), Counter(r.b)
        assert abs(r.s - (a & b).total() / max(1, (a | b).total())) < 1e-12


def test_ids_of_any_kind_ties_and_a_long_text(spark):
    item = ITEMS[0][1]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([("x", item), ("x", item + " " + item), (None, item), ("y", prose(1, 30000) + " " + item)], "doc_id string, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in contaminated(df, bench).collect()}
    assert got == {("x", 1): (0, 1.0), (None, 1): (0, 1.0), ("y", 1): (30000, 1.0)}


def test_simhash_of_like_windows_is_near(spark):
    w = prose(1, 50)
    df = spark.createDataFrame([(w, edited(w, 2, 1), prose(9, 50))], "a string, b string, c string")
    h = [simhash(F.split(c, " ")) for c in "abc"]
    r = df.select(F.bit_count(h[0].bitwiseXOR(h[1])).alias("near"), F.bit_count(h[0].bitwiseXOR(h[2])).alias("far")).first()
    assert r.near <= RADIUS < r.far
