import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bagminhash as bag
from palisade.llm import neardup
from palisade.llm.components import components
from palisade.llm.neardup import equal_slots, keep_one, near_duplicates
from tests.llm.helpers import ODD, docs, edited, prose


def classes_of(rows, least=0.8):
    """Brute force: all pairs of shingle bags, joined by union-find."""
    bags = {}
    for i, t, *_ in rows:
        w = [x.lower().strip(bag.MARKS) or x.lower() for x in (t or "").encode().decode().split()]
        w = [x for x in w]
        n = min(5, len(w))
        bags[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else Counter()
    top = {i: i for i in bags}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b]:
                shared = (bags[a] & bags[b]).total()
                if shared / (bags[a].total() + bags[b].total() - shared) >= least:
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(first, seed, n, edits, length=120):
    base = prose(seed, length)
    return [(first + k, edited(base, seed * 1000 + k, edits(k)) if k else base) for k in range(n)]


def test_classes_equal_brute_force(spark):
    rows = family(0, 1, 30, lambda k: k % 4) + family(100, 2, 12, lambda k: 2) + [(200 + k, prose(k, 80)) for k in range(20)]
    rows += [(300, "Same words, here now again."), (301, "same Words here now AGAIN"), (302, "a b"), (303, "A, b!"), (304, "a b c"), (305, ""), (306, None)]
    rows += [(400, "x y z " * 60), (401, "x y z " * 62), (402, "x y z " * 120)]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows, extra=True)).collect()}
    assert got == classes_of(rows)


def test_one_large_family_of_edits(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    rows = family(0, 7, 150, lambda k: k % 5)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == classes_of(rows)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    errors = []
    for k in range(60):
        a = [rng.randrange(60) for _ in range(200)]
        b = a[: rng.randrange(60, 200)] + [rng.randrange(60, 120) for _ in range(rng.randrange(1, 80))]
        mix = lambda x: bag.mixed(np.array(x, np.uint64) + np.uint64(1000 * k))  # noqa: B023, E731
        x, y = mix(a), mix(b)
        s = bag.signatures([x, y])
        errors.append((s[0] == s[1]).mean() - bag.bag_similarity(np.sort(x), np.sort(y)))
        ca, cb = Counter(a), Counter(b)
        assert abs(bag.bag_similarity(np.sort(x), np.sort(y)) - (ca & cb).total() / (ca | cb).total()) < 1e-12
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_packed_slots_count_equal_ones(spark):
    sig = bag.signatures([bag.shingles(bag.word_hashes(prose(k, 90))) for k in (1, 1, 2)])
    packed = bag.slot_nibbles(sig)
    df = spark.createDataFrame([([int(x) for x in packed[0]], [int(x) for x in packed[j]]) for j in (1, 2)], "a array<long>, b array<long>")
    same, other = (r[0] for r in df.select(equal_slots(F.col("a"), F.col("b"))).collect())
    assert same == bag.SLOTS and other < 25


def test_odd_rows_and_empty_table(spark):
    got = near_duplicates(docs(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == 1 and by[2] == 2 and by[3] == 3 and by[5] == 4 and by[7] == 7 and by[None] < 0
    assert near_duplicates(docs(spark, [])).collect() == []


def test_keep_one(spark):
    kept = keep_one(docs(spark, ODD, extra=True))
    assert kept.columns == docs(spark, ODD, extra=True).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8", "9"])
    assert keep_one(docs(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(5, 5), (7, None)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(table).collect()}
    assert got == {r.node: r.component for r in components(table, one_task=1000).collect()}
    assert got == {r.node: r.component for r in components(table, one_task=10).collect()}
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in top}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def loose(seed, k, length=90):
    """A text and one that shares ever less of it."""
    base = prose(seed, length, 5000)
    w = base.split()
    return base, " ".join(w[: length - k] + prose(seed + 10**6, k, 5000).split())


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8])
def test_pairs_equal_brute_force_at_other_similarities(spark, similarity):
    rows = []
    for k in range(30):
        a, b = loose(k, 2 + k)
        rows += [(2 * k, a), (2 * k + 1, b)]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows), similarity=similarity).collect()}
    want = classes_of(rows, similarity)
    assert sum(a != b for a, b in want.items()) >= 5 and got == want


def test_similarities_out_of_reach_are_refused(spark):
    for similarity in (0, 0.05, 1.1):
        with pytest.raises(ValueError):
            near_duplicates(docs(spark, ODD), similarity=similarity)


def test_ids_that_are_no_numbers_shared_or_missing(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [("x", a), ("x", b), ("x", b), ("y", a.upper()), (None, b), (None, prose(3, 60)), (None, None), ("z", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.class_id, r.duplicate) for r in got if r.class_id in "xyz") == [("None", "x", True), ("x", "x", False), ("x", "x", False), ("x", "x", False), ("y", "x", True), ("z", "z", False)]
    assert {(r.doc_id, r.text) for r in keep_one(df).collect()} == {("x", a), ("x", b), (None, prose(3, 60)), (None, None), ("z", "")}
    one = near_duplicates(spark.createDataFrame([(None, a), (5, a)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.duplicate) for r in one} == {(None, 5, True), (5, 5, False)}


def test_unlike_texts_that_share_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    # Half of each text is common, so buckets hold many classes.
    common = prose(50, 200, 5000)
    rows = [(k, common + " " + prose(100 + k // 2, 60, 5000) + (" end" if k % 2 else "")) for k in range(60)]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows), similarity=0.9).collect()}
    assert got == classes_of(rows, 0.9)


def test_a_very_long_text(spark):
    long = prose(1, 40000, 9000)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, [(1, long), (2, long + " more"), (3, prose(2, 40000, 9000))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
