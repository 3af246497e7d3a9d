"""Weighted MinHash signatures of word-shingle bags by hierarchical Poisson processes.

The count of a shingle is its weight, discretised in units. The units are grouped
dyadically: 1, 2, 3-4, 5-8, ... A shingle owns, for each group that its weight
reaches, a Poisson process whose rate is the group's width; every point of it falls
on a random slot of the signature and on a random unit of the group, and counts if
that unit is within the weight. A slot keeps its earliest point. Two bags agree in
a slot with the probability sum(min) / sum(max) of their counts. Points come in
rising order, so a process ends once its next point is later than all slots.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
SLOTS = 120
#: Chance, at most, that a pair of just the similarity asked for shares no band.
MISS = 1e-4
#: Slots of a longer signature, of texts whose buckets hold several classes.
MORE_SLOTS = 480
#: Characters that edits add to and take from words without making other words.
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "…“”„‘’«»¡¿–—"
#: Word hashes that a worker keeps.
KEEP_WORDS = 500_000

_U = np.uint64
_MIX1, _MIX2, _STEP, _POLY = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15), _U(0x5851F42D4C957F2D)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, raw: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        word = raw.decode("utf-8", "replace").lower()
        word = word.strip(MARKS) or word
        h = self[raw] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") >> 1
        return h


_HASHES = _WordHashes()
forget_words = _HASHES.clear


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, lower-cased and without marks at its ends."""
    words = text.encode("utf-8", "replace").split()  # at the six ASCII blanks
    return np.fromiter(map(_HASHES.__getitem__, words), np.int64, len(words)).view(np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of all words together if they are fewer."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mixed(h * _POLY + words[k : n - width + 1 + k])
    return h


def signatures(bags: list[np.ndarray], slots: int = SLOTS, salt: int = 0) -> np.ndarray:
    """The signature of each bag (not empty) of shingle hashes, a row each. Another salt gives an independent one."""
    doc, seed, weight = [], [], []
    for k, bag in enumerate(bags):
        own, counts = np.unique(bag, return_counts=True)
        doc.append(np.full(len(own), k, np.int64))
        seed.append(own ^ _U(salt))
        weight.append(counts)
    doc, seed, weight = np.concatenate(doc), np.concatenate(seed), np.concatenate(weight)
    # Processes: group 0 is the unit 1; group g > 0 the units 2^(g-1)+1 to 2^g.
    parts = [(doc, seed, np.zeros(len(doc), np.int64), weight)]
    g = 1
    while (more := weight > 1 << (g - 1)).any():
        parts.append((doc[more], mixed(seed[more] ^ mixed(np.full(1, g, np.uint64))), np.full(int(more.sum()), g, np.int64), weight[more]))
        g += 1
    doc, state, group, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    width = np.where(group > 0, 1 << np.maximum(group - 1, 0), 1)
    lower = np.where(group > 0, width, 0)
    time = np.zeros(len(doc))
    sig = np.full(len(bags) * slots, np.inf)
    while len(doc):
        state = state + _STEP
        r = mixed(state)
        time = time - np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0**-53) / width
        r = mixed(r + _STEP)
        slot = (r & _U(0xFFFFFFFF)) * _U(slots) >> _U(32)
        unit = lower + 1 + ((r >> _U(32)).astype(np.int64) & (width - 1))
        hit = unit <= weight
        np.minimum.at(sig, doc[hit] * slots + slot[hit].astype(np.int64), time[hit])
        on = time < sig.reshape(-1, slots).max(1)[doc]
        doc, state, time, width, lower, weight = doc[on], state[on], time[on], width[on], lower[on], weight[on]
    return sig.reshape(-1, slots)


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair of this similarity with a chance of MISS at most."""
    for rows in range(SLOTS, 0, -1):
        bands = SLOTS // rows
        if (1 - similarity**rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"signatures of {SLOTS} slots can't find pairs of similarity {similarity}")


def least_equal(similarity: float, slots: int) -> int:
    """Equal slots that pairs of this similarity have at least, but for chances beyond four standard deviations.

    Of slots that differ, one in 16 looks equal, as four bits of each are compared.
    """
    p = similarity + (1 - similarity) / 16
    return max(0, int(slots * p - 4 * (slots * p * (1 - p)) ** 0.5))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of a signature."""
    bits = np.ascontiguousarray(sig[:, : bands * rows]).view(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _U(1), bits.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * _POLY + bits[:, :, r])
    return key.view(np.int64)


def slot_nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots to a number, zeros after the last: for estimates."""
    bits = mixed(np.ascontiguousarray(sig).view(np.uint64)) >> _U(60)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16))).reshape(len(sig), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * _U(4))).sum(2, dtype=np.uint64).view(np.int64)


def bag_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """sum(min) / sum(max) of the counts in two sorted bags, each of them not empty."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = int(np.minimum(ca[ia], cb[ib]).sum())
    return shared / (len(a) + len(b) - shared)
