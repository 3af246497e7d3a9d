"""Byte-level BPE encoding and decoding over a trie of distinct words.

A prefix of a word ends, in its own encoding, in one token; that token and the
encoding of what stands before it give the whole. So one token is kept for each
node of a trie of the words, and a node's state follows from its ancestors'. The
words are visited in sorted order, which is the trie's depth-first order: the
states of the prefix that a word shares with the one before are still on the
stack and are not computed again.
"""

from __future__ import annotations

import json
import sys
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import sole_cache, text_of

#: Words whose encodings a worker keeps; it starts over beyond this.
KEEP_WORDS = 1_000_000
#: Pairs of tokens whose border it has looked at.
KEEP_PAIRS = 300_000
#: Documents that are worked on at once.
SLICE = 1024


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in letters.values()]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(packed: bytes) -> list[int]:
    out = array("I")
    out.frombytes(packed)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tolist()


class TrieBPE:
    """Encodes and decodes as the tokenizer file at ``path`` says."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[int, int] = {}  # of the merge that makes a token; none for single bytes
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            pair, made = (self.ids[raw[a]], self.ids[raw[b]]), self.ids[raw[a] + raw[b]]
            self.merges[pair] = r
            if made not in self.rank:
                self.rank[made], self.parts[made] = r, pair
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.meets: dict[tuple[int, int], bool] = {}

    def _apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        Their own merges are taken back, the latest first; in between, no merge may
        join the tokens that meet at the border before the merge just taken back.
        """
        before = len(self.merges)
        while True:
            if self.merges.get((left, right), before) < before:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges the left one is made first
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]

    def learn(self, words: list[str]) -> None:
        """Put the encodings of words, as little-endian 32-bit ids, among the known ones."""
        ids, longest, meets = self.ids, self.longest, self.meets
        last: list[int] = [-1]  # by depth
        size: list[int] = [0]
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for depth in range(shared + 1, len(raw) + 1):
                for start in range(max(0, depth - longest), depth):
                    token = ids.get(raw[start:depth])
                    if token is None:
                        continue
                    if start:
                        pair = (last[start], token)
                        fine = meets.get(pair)
                        if fine is None:
                            fine = meets[pair] = self._apart(*pair)
                        if not fine:
                            continue
                    last.append(token)
                    size.append(depth - start)
                    break
            at, out = len(raw), []
            while at:
                out.append(last[at])
                at -= size[at]
            self.known[word] = pack(out[::-1])
            before = raw
        if len(meets) > KEEP_PAIRS:
            meets.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.specials.split(t) if self.specials and any(s in t for s in self.special) else [t] for t in texts]
        split = [[p if k % 2 else self.words(p) for k, p in enumerate(c)] for c in cut]
        new = {w for s in split for words in s[::2] for w in words} - self.known.keys()
        if len(self.known) + len(new) > KEEP_WORDS:
            self.known.clear()
            new = {w for s in split for words in s[::2] for w in words}
        self.learn(list(new))
        known = self.known
        return [b"".join(pack([self.special[p]]) if k % 2 else b"".join([known[w] for w in p]) for k, p in enumerate(s)) for s in split]

    def decode(self, packed: bytes) -> str:
        return b"".join([self.bytes_of[i] for i in unpack(packed)]).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], TrieBPE] = {}


def loaded(path: str, pattern: str) -> TrieBPE:
    """One coder for each vocabulary and worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TrieBPE(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each document, or digests of the last two.

    Null texts are empty; an empty text has no tokens. Control tokens' own strings
    in a text become those tokens. Repeated rows each give a row; an empty table
    gives an empty result. No shuffle: texts are coded where they are read.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        coder = loaded(path, pattern)
        sole_cache("bpe", lambda: (coder.known.clear(), coder.meets.clear()))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                packed = coder.encode(part.column("text").to_pylist())
                decoded = [coder.decode(p) for p in packed]
                n = pa.array([len(p) // 4 for p in packed], pa.int64())
                if digest:
                    cols = [pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
                else:
                    cols = [pa.array([unpack(p) for p in packed], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("id"), n, *cols], ["id", "n_tokens", *names])

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    take = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return take.mapInArrow(run, f"id {take.schema['id'].dataType.simpleString()}, n_tokens long, {kinds}").withColumnRenamed("id", id_col)
