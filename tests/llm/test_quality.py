import re
from collections import defaultdict

from palisade.llm.quality import host_verdicts, judge_quality, keep_good, measures
from tests.llm.helpers import ODD, docs, prose, words


def brute(text):
    t = text or ""
    w = words(t)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    covered = {p for v in places.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def rows():
    a = prose(1, 40)
    made = [a, a + " " + prose(2, 30) + " " + a, "x " * 8, "x " * 9, "x " * 7, a + "\n" + a + "\n \n" + "|b|\n|b|", "#" * 50 + " " + a, "a b c d e f g h a b c d e f g h i", " ".join(f"{k}" for k in range(500)) * 2]
    return [(100 + k, t) for k, t in enumerate(made)] + ODD


def test_counts_equal_brute_force(spark):
    got = judge_quality(docs(spark, rows(), extra=True)).collect()
    mine = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert mine == sorted((str(i), *brute(t)) for i, t, *_ in rows())
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_hosts_that_fail_lose_all_documents(spark):
    good = [(k, prose(k, 50), "en", f"good{k % 3}") for k in range(60)]
    bad = [(100 + k, "junk", "en", "bad") for k in range(40)] + [(200, prose(200, 50), "en", "bad")]
    new = [(300, "junk", "en", "new")]
    by = {r.doc_id: r for r in judge_quality(docs(spark, good + bad + new)).collect()}
    assert all(by[k].kept for k in range(60))
    assert by[200].host_rejected and not by[200].kept and not by[200].base_failed
    m = measures(docs(spark, good + bad + new)).selectExpr("*", "if(n_words < 20, array('short'), array()) as failed")
    v = {r.host: r for r in host_verdicts(m).collect()}
    rates = {h: r.failed / r.docs for h, r in v.items()}
    mu = sum(rates.values()) / len(rates)
    var = sum((x - mu) ** 2 for x in rates.values()) / len(rates)
    weight = mu * (1 - mu) / var - 1 if mu * (1 - mu) > var > 0 else 10
    assert all(abs(r.shrunk - (r.failed + mu * weight) / (r.docs + weight)) < 1e-9 for r in v.values())
    assert v["new"].shrunk < 1
    kept = keep_good(docs(spark, good + bad + new, extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_empty_table(spark):
    assert judge_quality(docs(spark, [])).collect() == []
    assert keep_good(docs(spark, [])).collect() == []
