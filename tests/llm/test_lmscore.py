import math
import re
import zlib
from collections import Counter

import numpy as np

from palisade.llm import lmscore
from palisade.llm.lbl import CONTEXT, LogBilinear, Vocabulary, laid_out, pieces
from palisade.llm.lmscore import score_documents
from tests.llm.helpers import ODD, docs, prose


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


def out_of(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def corpus():
    """Two languages, told apart by the words before."""
    made = []
    for k in range(160):
        words = prose(k, 120, 60).split()
        made.append((1000 + k, " ".join(("l" if k % 2 else "r") + w for w in words)))
    return made


def test_base_counts_and_scores(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FREQUENT", 60)
    rows = corpus() + ODD
    got = score_documents(docs(spark, rows, extra=True)).collect()
    c = Counter(t for i, x, *_ in rows if not out_of(i) for t in tokens(x))
    n, v = c.total(), len(c)
    want = sorted((str(i), out_of(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n) for i, x, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {i: sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)) for i, x, *_ in rows}
    assert all(abs(r.base_score - base[r.doc_id]) < 1e-8 * abs(base[r.doc_id]) + 1e-9 for r in got)


def test_model_beats_the_base_on_held_out_documents(spark):
    got = score_documents(docs(spark, corpus() * 2)).where("held_out").collect()
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)


def after(model, context, words):
    """log10 of the probability of each word after a context."""
    texts = [np.append(context, k).astype(np.int32) for k in range(words)]
    said = np.concatenate(texts)
    return model.log10(said, np.arange(words) * (CONTEXT + 1))


def test_pieces_hold_each_word_once_with_its_context():
    texts = [np.arange(k * 1000, k * 1000 + n, dtype=np.int32) for k, n in enumerate((1, 63, 64, 65, 500))]
    found = []
    for said, real in pieces(texts, -1, np.random.default_rng(1)):
        for k in real:
            found.append(tuple(said[k : k + CONTEXT + 1]))
    want = [tuple(np.concatenate([np.full(CONTEXT, -1), t])[k : k + CONTEXT + 1]) for t in texts for k in range(len(t))]
    assert sorted(found) == sorted(want)
    said, real = laid_out(texts, -1)
    assert [tuple(said[k : k + CONTEXT + 1]) for k in real] == want


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD", 500)
    monkeypatch.setattr(lmscore, "FREQUENT", 100)
    df = docs(spark, corpus() + ODD)
    first, second = ({(r.doc_id, r.n_tokens): r.score for r in score_documents(d).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert first.keys() == second.keys() and all(abs(first[k] - second[k]) < 1e-6 * abs(first[k]) for k in first)


def test_probabilities_sum_to_one():
    words = [f"w{k}" for k in range(300)] + [" "]
    counts = np.arange(len(words), 0, -1).astype(float)
    vocabulary = Vocabulary(words, counts, int(counts.sum()) + 50, len(words) + 20)
    model = LogBilinear(vocabulary.prior)
    said, real = laid_out([vocabulary.class_of[vocabulary.encode(b"w1 w2 w250 zzz")[1]]], vocabulary.class_of[vocabulary.end])
    classes = len(vocabulary.prior)
    for k in real:
        assert abs((10 ** after(model, said[k : k + CONTEXT], classes)).sum() - 1) < 1e-5
    target = said[CONTEXT:][real]
    shares = np.bincount(vocabulary.class_of[:-1], weights=10 ** vocabulary.share[:-1], minlength=classes)
    used = np.bincount(vocabulary.class_of[:-1], minlength=classes) > 0
    assert np.allclose(shares[used], 1) and target[-1] == vocabulary.class_of[vocabulary.end]


def test_context_tells_every_frequent_word_apart():
    """Words alike in count and shape have rows of their own, however many they are."""
    words = [f"w{k}" for k in range(3000)] + [" "]
    vocabulary = Vocabulary(words, np.full(len(words), 9.0), 9 * len(words), len(words))
    model = LogBilinear(vocabulary.prior)
    rng = np.random.default_rng(1)
    end = vocabulary.class_of[vocabulary.end]
    for _ in range(400):
        pairs = rng.integers(0, 2, 200)
        texts = [vocabulary.class_of[vocabulary.encode(b"w1000 w2000" if p else b"w1001 w2001")[1]] for p in pairs]
        for said, real in pieces(texts, end, rng):
            model.learn(said, real, rng)
    encoded = [vocabulary.class_of[vocabulary.encode(t)[1]] for t in (b"w1000 w2000", b"w1000 w2001")]
    said, real = laid_out(encoded, end)
    seen, unseen = model.log10(said, real).reshape(2, 3)[:, 1]
    assert seen > unseen + 0.2 and seen > -1
    assert len(model.bounds) < len(words) and abs((10 ** after(model, said[1 : 1 + CONTEXT], len(words) + 1)).sum() - 1) < 1e-4


def test_empty_table(spark):
    assert score_documents(docs(spark, [])).collect() == []
    only = score_documents(docs(spark, [(1, "all held out")])).collect()
    assert len(only) == 1 and only[0].n_tokens == 4
