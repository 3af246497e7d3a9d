"""A log-bilinear language model of words, trained with noise contrast in numpy.

Every frequent word has a context vector, a vector and a bias of its own; all words
beyond the frequent ones share one row, the tail. The context's vector is the sum of
its words' vectors and their classes', weighed by place and dimension. The
probability of a word is that of its class after the context, times that of the word
among its class's words after the same context; both are normalised exactly. A class
is one of the most frequent words, or words of like shape and frequency; the number
of classes grows with the square root of the words'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CONTEXT, DIMENSIONS, NOISE, BATCH, RATE = 4, 12, 32, 4096, 0.35
#: Groups of words by shape, the most frequent words included; so many times the root of the words is how many pieces they fall into beside.
GROUPS, BY_ROOT = 160, 0.6
#: Most frequent words that are always classes of their own.
SINGLES = 72
#: Other words of the class that a target is told apart from in a step.
RIVALS = 2
#: Where the sums of squared gradients begin: of classes and places, and of words, which a step meets seldom.
SQUARES, WORD_SQUARES = 1e-3, 1e-5
#: Tokens that are scored at once.
AT_ONCE = 2048
#: Words of a text that are learned from together; a batch holds such pieces of many texts.
PIECE = 64
#: Stands for the end of a text; no word holds a blank.
END = " "


def shape_of(word: str) -> str:
    """What words must share to be grouped: the marks they end with and their first letters."""
    core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return core[:2] + "\t" + word[len(core) :][:2]


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one row, A-Z lower-cased, and how many each has."""
    each = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = each.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    ends = np.cumsum(pc.list_value_length(each).to_numpy())
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return words.filter(full), np.diff(before[np.append(0, ends)])


class Rows:
    """The words' rows, those of a class together: the prior of each, and where each class begins, with their number at the end."""

    def __init__(self, prior: np.ndarray, bounds: np.ndarray):
        self.prior, self.bounds = prior, bounds

    def __len__(self) -> int:
        return len(self.prior)


class Vocabulary:
    """Frequent words with their counts, and what is known of the others together.

    words and counts: of the frequent, most frequent first. total: tokens counted.
    types: distinct tokens counted. A token that was never counted weighs a half.
    """

    def __init__(self, words: list[str], counts: np.ndarray, total: int, types: int):
        self.words = pa.array(words, pa.string())
        self.all = total + 0.5 * (types + 1)
        mass = counts + 0.5
        self.rest = self.all - mass.sum() if len(words) else self.all  # the half of the unknown included
        self.tail = len(words)
        each = np.maximum(np.append(mass, self.rest), 1e-3)
        each /= each.sum()
        of = _classes(words, each)
        order = np.argsort(of, kind="stable")
        self.class_of = np.empty(len(of), np.int32)
        self.class_of[order] = np.arange(len(of))
        self.prior = Rows(each[order], np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of)))
        self.base = np.append(np.log10(mass / self.all), 0.0)
        self.share = np.zeros(self.tail + 1)
        self.known = np.append(counts > 0, False)
        self.end = words.index(END) if END in words else len(words)

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Tokens of all texts without the ends, the numbers of all with them, and where each text's numbers stop.

        Words that aren't frequent share the last number.
        """
        tokens, lengths = tokens_of(texts)
        stops = np.cumsum(lengths + 1)
        ids = np.full(len(tokens) + len(lengths), self.end, np.int32)
        inside = np.ones(len(ids), bool)
        inside[stops - 1] = False
        ids[inside] = pc.fill_null(pc.index_in(tokens, value_set=self.words), self.tail).to_numpy()
        return tokens, ids, stops

    def encode(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """Tokens without the end, and the numbers of all."""
        tokens, ids, _ = self.encode_all(pa.array([text.decode()]))
        return tokens.cast(pa.binary()).to_pylist(), ids


def _classes(words: list[str], prior: np.ndarray) -> np.ndarray:
    """The class of each word, most frequent words first, and of the tail, which is a class."""
    singles = min(SINGLES, len(words))
    shapes: dict[str, float] = {}
    named = [shape_of(w) for w in words[singles:]]
    for s, m in zip(named, prior[singles:-1], strict=True):
        shapes[s] = shapes.get(s, 0.0) + m
    ranked = sorted(shapes, key=lambda s: (-shapes[s], s))[: GROUPS - singles - 2]
    place = {s: singles + i for i, s in enumerate(ranked)}
    other = singles + len(ranked)
    group = np.array([*range(singles), *(place.get(s, other) for s in named), other + 1])
    # Groups fall into pieces of like sums of roots, which keep both the pieces of frequent words and the number of pieces small.
    root = np.sqrt(prior)
    root[:singles] = root[-1] = 0
    piece = max(root.sum(), 1e-30) / max(1, BY_ROOT * len(prior) ** 0.5 - GROUPS / 4)
    order = np.argsort(group, kind="stable")
    before = np.cumsum(root[order]) - root[order]
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    within = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
    new = np.flatnonzero((np.diff(group[order], prepend=-1) != 0) | (np.diff((within / piece).astype(int), prepend=0) != 0))
    of = np.empty(len(order), int)
    of[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    return of


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2**31 in order, and their places; equal ones in the order they stand in."""
    keys = np.sort(rows.astype(np.int64) << 32 | np.arange(len(rows)))
    return keys >> 32, keys & 0xFFFFFFFF


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each occurs, and what _sums needs: an order that brings equal rows together, and where each begins."""
    ranked, order = _ordered(rows)
    begins = np.flatnonzero(np.diff(ranked, prepend=-1))
    return ranked[begins], np.diff(np.append(begins, len(rows))), order, begins


def _sums(values: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], begins, axis=0)


class LogBilinear:
    """Parameters: context vectors R and vectors W of words, S and P of classes, place weights C; W and P end with the bias."""

    def __init__(self, rows: Rows, tables: list[np.ndarray] | None = None):
        prior, self.bounds = rows.prior, rows.bounds
        n, k = len(prior), len(self.bounds) - 1
        sizes = np.diff(self.bounds)
        self.of = np.repeat(np.arange(k, dtype=np.int32), sizes)
        by_class = np.add.reduceat(prior, self.bounds[:-1])
        self.by_class, self.log_class = np.cumsum(by_class), np.log(by_class).astype(np.float32)
        self.alone = (sizes == 1)[self.of]
        log_share = np.log(prior / by_class[self.of]).astype(np.float32)
        # Rivals are drawn from a list in which a class's words stand about as often as their shares say, at least once.
        places = np.maximum(1, np.rint(prior / by_class[self.of] * (4 * sizes[self.of]))).astype(np.int64)
        self.drawn_from = np.repeat(np.arange(n, dtype=np.int32), places)
        ends = np.add.reduceat(places, self.bounds[:-1])
        self.list_at, self.list_size = (np.cumsum(ends) - ends).astype(np.int64), ends
        self.log_drawn = np.log(places / ends[self.of]).astype(np.float32)
        if tables is None:
            rng = np.random.default_rng(7)
            S = rng.normal(0, 0.3, (k, DIMENSIONS))
            W = np.column_stack([np.zeros((n, DIMENSIONS)), log_share])
            P = np.column_stack([rng.normal(0, 0.3, (k, DIMENSIONS)), self.log_class])
            tables = [rng.normal(0, 0.1, (n, DIMENSIONS)), W, P, np.ones((CONTEXT, DIMENSIONS)) / np.arange(1, CONTEXT + 1)[:, None], S]
        self.tables = [t.astype(np.float32) for t in tables]
        self.R, self.W, self.P, self.C, self.S = self.tables
        self.squares: list[np.ndarray] | None = None
        self.met: list[np.ndarray] | None = None

    def _context(self, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' vectors, and those of the contexts of all but the first CONTEXT, with a one at the end, which meets the bias."""
        v = self.R[said]
        v += self.S[self.of[said]]
        n = len(said) - CONTEXT
        r = np.ones((n, DIMENSIONS + 1), np.float32)
        np.multiply(self.C[0], v[CONTEXT - 1 : CONTEXT - 1 + n], out=r[:, :-1])
        for j in range(1, CONTEXT):
            r[:, :-1] += self.C[j] * v[CONTEXT - 1 - j : CONTEXT - 1 - j + n]
        return v, r

    def _move(self, table: int, rows: np.ndarray, n: np.ndarray, grad: np.ndarray) -> None:
        squares = self.squares[table]
        at = squares[rows]
        at += grad * grad
        squares[rows] = at
        np.sqrt(at, out=at)
        np.divide(grad, at, out=at)
        at *= RATE
        self.tables[table][rows] += at
        self.met[table][rows] += n

    def learn(self, said: np.ndarray, real: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation of classes, and of words among their class's.

        said: words in the order of the texts, the first CONTEXT of them only as
        context. real: places, counted after those, of words that are learned; the
        others pad the begins of texts. Noise classes are drawn from all and shared by
        the batch; a word's rivals are drawn from its class.
        """
        if self.squares is None:
            self.squares = [np.full_like(t, s) for t, s in zip(self.tables, (WORD_SQUARES, WORD_SQUARES, SQUARES, SQUARES, SQUARES), strict=True)]
            self.met = [np.zeros(len(t), np.float32) for t in self.tables]
        target = said[CONTEXT:][real]
        n, c = len(target), self.of[target]
        noise = np.searchsorted(self.by_class, rng.random(NOISE) * (1 - 1e-9))
        v, r = self._context(said)
        r = r[real]
        pt, pn = self.P[c], self.P[noise]
        log_k = np.float32(np.log(NOISE))
        st = np.einsum("nd,nd->n", r, pt)
        st -= log_k + self.log_class[c]
        sn = r @ pn.T
        sn -= log_k + self.log_class[noise]
        gt = 1 / (1 + np.exp(np.clip(st, -30, 30)))
        gn = -1 / (1 + np.exp(np.clip(-sn, -30, 30)))
        dr = gn @ pn
        dr += gt[:, None] * pt
        rows, times, order, begins = _grouped(np.concatenate([c, noise]))
        self._move(2, rows, times, _sums(np.concatenate([gt[:, None] * r, gn.T @ r]), order, begins) / n)

        among = np.flatnonzero(~self.alone[target])
        if len(among):
            w, ra, ca = target[among], r[among], c[among]
            drawn = (rng.random((RIVALS, len(w)), dtype=np.float32) * self.list_size[ca]).astype(np.int64)
            every = np.concatenate([w, *self.drawn_from[self.list_at[ca] + np.minimum(drawn, self.list_size[ca] - 1)]])
            W = self.W[every].reshape(RIVALS + 1, len(w), -1)
            s = np.einsum("nd,knd->kn", ra, W)
            s -= self.log_drawn[every].reshape(s.shape) + np.float32(np.log(RIVALS))
            g = -1 / (1 + np.exp(np.clip(-s, -30, 30)))
            g[0] += 1
            dr[among] += np.einsum("kn,knd->nd", g, W)
            rows, times, order, begins = _grouped(every)
            self._move(1, rows, times, _sums((g[:, :, None] * ra).reshape(-1, DIMENSIONS + 1), order, begins) / n)
        full = np.zeros((len(said) - CONTEXT, DIMENSIONS), np.float32)
        full[real] = dr[:, :-1]
        m, dv, moved = len(full), np.zeros_like(v), np.empty_like(self.C)
        for j in range(CONTEXT):
            part = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + m)
            moved[j] = np.einsum("nd,nd->d", full, v[part])
            dv[part] += self.C[j] * full
        rows, times, order, begins = _grouped(said)
        sums = _sums(dv, order, begins) / n
        classes, _, by, starts = _grouped(self.of[rows])
        self._move(4, classes, np.add.reduceat(times[by], starts), _sums(sums, by, starts))
        several = ~self.alone[rows]
        self._move(0, rows[several], times[several], sums[several])
        self._move(3, np.arange(CONTEXT), np.float32(n), moved / n)

    def log10(self, said: np.ndarray, real: np.ndarray) -> np.ndarray:
        """log10 of the normalised probabilities of the words at the real places."""
        target = said[CONTEXT:][real]
        out = np.zeros(len(target))
        contexts = np.empty((len(target), DIMENSIONS + 1), np.float32)
        c = self.of[target]

        def logs(r, vectors, chosen):
            s = r @ vectors.T
            # Exponentials of products that cannot be large need no shift.
            if np.einsum("nd,nd->n", r, r).max() * np.einsum("nd,nd->n", vectors, vectors).max() > 3600:
                s -= s.max(1, keepdims=True)
            own = s[np.arange(len(s)), chosen].astype(np.float64)
            np.exp(s, out=s)
            return (own - np.log(s.sum(1))) / np.log(10)

        at = 0
        for begin in range(0, len(said) - CONTEXT, AT_ONCE):
            stop = min(begin + AT_ONCE, len(said) - CONTEXT)
            some = real[np.searchsorted(real, begin) : np.searchsorted(real, stop)]
            part = slice(at, at + len(some))
            contexts[part] = self._context(said[begin : stop + CONTEXT])[1][some - begin]
            if len(some):
                out[part] = logs(contexts[part], self.P, c[part])
            at += len(some)
        among = np.flatnonzero(~self.alone[target])
        among = among[_ordered(c[among])[1]]
        for run in np.split(among, np.flatnonzero(np.diff(c[among])) + 1):
            for at in range(0, len(run), AT_ONCE):
                some = run[at : at + AT_ONCE]
                low, high = self.bounds[c[some[0]]], self.bounds[c[some[0]] + 1]
                out[some] += logs(contexts[some], self.W[low:high], target[some] - low)
        return out


def laid_out(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Several texts' words in one row, ends before each, and the places of the words, counted after the first CONTEXT."""
    pad = np.full(CONTEXT, end, np.int32)
    said = np.concatenate([x for t in texts for x in (pad, t)])
    begins = np.cumsum([0, *(len(t) + CONTEXT for t in texts[:-1])])
    lengths = np.array([len(t) for t in texts])
    return said, np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def pieces(texts: list[np.ndarray], end: int, rng: np.random.Generator, learned: int = 0):
    """Batches of the texts' words for learning, as laid_out gives them: pieces of PIECE words with what stands before them, shuffled.

    Batches grow to BATCH words with the number of those already learned from: small
    ones get off the start in few words, large ones cost less.
    """
    pad = np.full(CONTEXT, end, np.int32)
    cut = []
    for t in texts:
        t = np.concatenate([pad, t])
        cut += [t[k : k + PIECE + CONTEXT] for k in range(0, len(t) - CONTEXT, PIECE)]
    order, at = rng.permutation(len(cut)), 0
    while at < len(order):
        size = min(max(learned // 8, BATCH // 16), BATCH)
        some = [cut[k] for k in order[at : at + size // PIECE]]
        lengths = np.array([len(x) for x in some])
        place = np.ones(lengths.sum(), bool)
        begins = np.cumsum(lengths) - lengths
        place[(begins[:, None] + np.arange(CONTEXT)).ravel()] = False
        yield np.concatenate(some), np.flatnonzero(place) - CONTEXT
        at += len(some)
        learned += int(place.sum())
