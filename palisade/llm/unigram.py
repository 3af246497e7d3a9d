"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton yields every vocabulary piece that ends at a place;
dynamic programming carries the best score and its number of pieces, never the
pieces themselves. Ties go as in the tokenizers library's Unigram model: of equal
scores the piece that starts first wins, and a character without a piece of its
own counts as its UTF-8 bytes, at ten below the least score.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import sole_cache, text_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks whose counts a worker keeps; it starts over beyond this.
KEEP_CHUNKS = 1_000_000


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        # No piece runs on from another character into a space, or over a line's end;
        # so the best path passes every such place, and the pieces between them stand alone.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces):
            self.chunks = lambda t: [t] if t else []
        elif any("\n" in p for p, _ in pieces):
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.known: dict[str, int] = {}

    def _viterbi(self, chunk: str) -> int:
        n = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.trie.iter(chunk):
            ends[last + 1].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces = None, 0
            for size, gain in sorted(ends[end], reverse=True):  # the longest starts first
                s = score[end - size] + gain
                if best is None or s > best:
                    best, pieces = s, count[end - size] + 1
            if chunk[end - 1] not in self.single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[end - 1] + len(chunk[end - 1].encode())
            score[end], count[end] = best, pieces
        return count[n]

    def count(self, text: str) -> int:
        """Number of tokens of a text, with a space put before it; none if it is empty."""
        if not text:
            return 0
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > KEEP_CHUNKS:
            known.clear()
            new = chunks
        for c in new:
            if c not in known:
                known[c] = self._viterbi(c)
        return sum([known[c] for c in chunks])


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_LOADED: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of each document.

    Null texts are empty and have no tokens. Repeated rows each give a row; an
    empty table gives an empty result. No shuffle.
    """
    import pyarrow as pa

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = UnigramCounter(vocabulary(path))
        counter = _LOADED[path]
        sole_cache("unigram", counter.known.clear)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

    take = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return take.mapInArrow(run, f"id {take.schema['id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)
