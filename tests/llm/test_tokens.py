import random

import public_tokenizers
from tokenizers import Tokenizer, models, normalizers

from palisade.llm.bpe import TrieBPE, encode_documents, unpack
from palisade.llm.unigram import UnigramCounter, count_tokens, vocabulary
from tests.llm.helpers import ODD, docs

BPE = public_tokenizers.path("byte_bpe_50k.json")
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab \n    \x1f\x1ethe.!é漢😀'st<|") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    return ["", "<|endoftext|>", "a<|endoftext|>b", "don't I'LL we've", "z" * 3000, "-" * 200 + " " * 57, "\x1c x\x85y　q\r\n\t", *made]


def test_encoding_equals_library_and_round_trips():
    tok, mine = Tokenizer.from_file(BPE), TrieBPE(BPE, public_tokenizers.PATTERN)
    texts = odd_texts()
    for text, packed, ref in zip(texts, mine.encode(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert unpack(packed) == ref.ids
        assert mine.decode(packed) == tok.decode(ref.ids, skip_special_tokens=False) == text


def test_encoding_after_the_cache_starts_over(monkeypatch):
    monkeypatch.setattr("palisade.llm.bpe.KEEP_WORDS", 5)
    mine, tok = TrieBPE(BPE, public_tokenizers.PATTERN), Tokenizer.from_file(BPE)
    for text in odd_texts()[:60]:
        assert unpack(mine.encode([text])[0]) == tok.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    got = encode_documents(docs(spark, ODD, extra=True), BPE, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t, *_ in ODD)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert encode_documents(docs(spark, []), BPE, public_tokenizers.PATTERN, digest=True).collect() == []


def test_counts_equal_library(spark):
    pieces = vocabulary(UNIGRAM)
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    mine = UnigramCounter(pieces)
    for text in odd_texts():
        assert mine.count(text) == size(text)
    got = count_tokens(docs(spark, ODD, extra=True), UNIGRAM).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), size(t or "")) for i, t, *_ in ODD)
    assert count_tokens(docs(spark, []), UNIGRAM).collect() == []


def test_ties_take_the_piece_that_starts_first():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0)]
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    mine = UnigramCounter(pieces)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert mine._viterbi(t) == len(lib.encode(t).ids)
