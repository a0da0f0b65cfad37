"""Unigram piece lattices over a trie of distinct words, level by level in NumPy.

Words are sorted, so words that share a prefix stand together and a trie node is the first word of its run. For each
depth, the scores of all nodes are computed at once from the scores of their ancestors and the pieces that end
there: once per shared prefix, however many words have it. A word's result is read at its terminal node. All scores are
logs, so neither long words nor rare pieces underflow, and only the last levels that a piece can span are held. Words
share a trie with words of similar length, so that one long word does not widen the table of many short ones.

The pieces at all places of a table are found together, by following the vocabulary's prefixes byte by byte: 64-bit
polynomial hashes in an open-addressed table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()  # stands for the white space before a word
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
#: Words that share a trie at most, and cells (words times depths) that are looked up at a time.
_SLICE, _CELLS = 1 << 14, 1 << 18
#: Words up to so many bytes share tries whatever their lengths; longer ones with those of the same power of two.
_SHORT = 63


class U64Map:
    """Unique uint64 keys to their places; lookups of whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, math.ceil(math.log2(3 * len(keys) + 2)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            s = slot[todo]
            free = self.place[s] < 0
            self.place[s[free]] = todo[free]
            todo = todo[self.place[s] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        # an empty slot holds a key that belongs elsewhere or nowhere: its place is -1 all the same
        self.table = np.zeros(1 << bits, np.uint64)
        full = self.place >= 0
        self.table[full] = keys[self.place[full]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _M) >> self.shift).view(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slot(q)
        key = self.table[slot]
        out = self.place[slot]
        todo = np.flatnonzero((key != q) & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            s = slot[todo]
            out[todo] = self.place[s]
            todo = todo[(self.table[s] != q[todo]) & (out[todo] >= 0)]
        return out


@lru_cache(2)
def pieces(path: str = VOCABULARY) -> tuple[bytes, ...]:
    """The vocabulary's pieces by rank, the 256 single bytes after them; its size bounds what is broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = dict.fromkeys(sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    ranked = sorted(known, key=lambda p: -sp.get_score(sp.piece_to_id(p.decode())))
    return tuple(dict.fromkeys([*ranked, *(bytes([b]) for b in range(256))]))


def zipf(n: int) -> np.ndarray:
    """Log probabilities of n ranked pieces where no counts are at hand: p falls as 1 / (rank + 2.7)."""
    w = 1.0 / (np.arange(n) + 2.7)
    return np.log(w / w.sum())


def _hash(b: bytes) -> int:
    h = 0
    for c in b:
        h = (h * int(_P) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Lattice:
    """Pieces with log probabilities, one column per model. Every single byte is a piece, so every word has a segmentation."""

    def __init__(self, vocab: tuple[bytes, ...], logp: np.ndarray) -> None:
        self.vocab = vocab
        self.logp = np.ascontiguousarray(logp.reshape(len(vocab), -1), np.float64)
        self.columns = np.ascontiguousarray(self.logp.T)
        self.longest = max(map(len, vocab))
        self.sizes = np.fromiter(map(len, vocab), np.int64, len(vocab))
        self.ids = {p: i for i, p in enumerate(vocab)}
        prefixes = list({p[:k] for p in vocab for k in range(1, len(p) + 1)})
        self.map = U64Map(np.array([_hash(p) for p in prefixes], np.uint64))
        self.piece = np.array([self.ids.get(p, -1) for p in prefixes], np.int32)

    def __getstate__(self) -> tuple:
        return self.vocab, self.logp

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _sliced(self, words: list[bytes]):
        """Sorted places of words that share a trie."""
        group = lambda w: 0 if len(w) <= _SHORT else len(w).bit_length()
        order = sorted(range(len(words)), key=lambda i: (group(words[i]), words[i]))
        part, kind = [], None
        for i in order:
            g = group(words[i])
            if part and (g != kind or len(part) == _SLICE or g and len(part) << g > 4 * _CELLS):
                yield part
                part = []
            part.append(i)
            kind = g
        if part:
            yield part

    def _walk(self, t: np.ndarray, size: np.ndarray, lcp: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Pieces that end at nodes of the depths over lo up to hi: (depth, word, length, piece) by depth and word."""
        n = t.shape[1]
        first = max(0, lo - self.longest + 1)
        s = np.repeat(np.arange(first, hi, dtype=np.int32), n)
        w = np.tile(np.arange(n, dtype=np.int32), hi - first)
        end = np.minimum(size, hi).astype(np.int32)
        floor = np.maximum(lcp, lo).astype(np.int32)
        ok = s < end[w]
        s, w = s[ok], w[ok]
        h, found = np.zeros(len(s), np.uint64), []
        for k in range(1, self.longest + 1):
            ok = s + k <= end[w]
            if not ok.all():
                s, w, h = s[ok], w[ok], h[ok]
            if not len(s):
                break
            h = h * _P + t[s + (k - 1), w] + np.uint64(1)
            place = self.map.find(h)
            ok = place >= 0
            s, w, h = s[ok], w[ok], h[ok]
            piece = self.piece[place[ok]]
            out = np.flatnonzero((piece >= 0) & (s + k > floor[w]))
            found.append((s[out] + k, w[out], np.full(len(out), k, np.int32), piece[out]))
        d, w, k, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(d.astype(np.int64) * n + w, kind="stable")
        return d[order], w[order], k[order], piece[order]

    def _levels(self, ws: list[bytes]):
        """For each depth: the pieces that end there (word, length, piece), where those of a node begin, the words that reach it and
        their nodes; None instead of the last two for a lone word."""
        n, size = len(ws), np.fromiter(map(len, ws), np.int64, len(ws))
        width = int(size.max())
        m = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in ws), np.uint8).reshape(n, width)
        lcp = np.zeros(n, np.int64)
        if n > 1:
            diff = m[1:] != m[:-1]
            lcp[1:] = np.minimum(np.where(diff.any(axis=1), diff.argmax(axis=1), width), np.minimum(size[1:], size[:-1]))
        t = np.ascontiguousarray(m.T)
        step = max(1, _CELLS // n)
        for lo in range(0, width, step):
            hi = min(width, lo + step)
            depth, w, k, piece = self._walk(t, size, lcp, lo, hi)
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (depth[1:] != depth[:-1])]))
            bounds = np.searchsorted(depth, np.arange(lo + 1, hi + 2)).tolist()
            starts = np.searchsorted(new, bounds).tolist()
            for j, d in enumerate(range(lo + 1, hi + 1)):
                a, b = bounds[j], bounds[j + 1]
                if n == 1:
                    yield d, w[a:b], k[a:b], piece[a:b], None, None, None
                    continue
                active = np.flatnonzero(size >= d)
                yield d, w[a:b], k[a:b], piece[a:b], new[starts[j] : starts[j + 1]] - a, active, np.cumsum(lcp[active] < d) - 1

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Per word and model: log of the sum over all segmentations. Words are distinct."""
        models, span = self.columns.shape[0], self.longest + 1
        out = np.zeros((len(words), models))
        for part in self._sliced(words):
            ws = [words[i] for i in part]
            n, size, at = len(ws), np.fromiter(map(len, ws), np.int64, len(ws)), np.array(part)
            f = np.zeros((models, span * n))
            for d, w, k, piece, begin, active, node_of in self._levels(ws) if size.max() else ():
                v = f.take((d - k) % span * n + w, axis=1) + self.columns.take(piece, axis=1)
                row = d % span * n
                if begin is None:
                    top = v.max(axis=1)
                    f[:, row] = top + np.log(np.exp(v - top[:, None]).sum(axis=1))
                    if d == size[0]:
                        out[at] = f[:, row]
                    continue
                each = np.diff(begin, append=len(w))
                top = np.maximum.reduceat(v, begin, axis=1)
                score = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, each, axis=1)), begin, axis=1))
                f[:, row + active] = score[:, node_of]
                done = active[size[active] == d]
                out[at[done]] = f[:, row + done].T
        return out

    def best(self, words: list[bytes], total: bool = False, weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Per word, by the first model: the best segmentation's log probability and its number of pieces (ties take
        fewer). With total also the log of the sum over all segmentations; with weights (a row per word) instead of
        that the weighted counts of the pieces in the best segmentations."""
        score, count, sums = np.zeros(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words))
        used = None if weights is None else np.zeros((len(self.vocab), weights.shape[1]))
        lp, span = self.columns[0], self.longest + 1
        for part in self._sliced(words):
            ws = [words[i] for i in part]
            n, size, at = len(ws), np.fromiter(map(len, ws), np.int64, len(ws)), np.array(part)
            last = np.zeros((int(size.max()) + 1, n), np.int32) if used is not None else None
            if n == 1:
                score[at], count[at], sums[at] = self._best_alone(ws[0], total, last)
                levels = ()
            else:
                levels = self._levels(ws) if size.max() else ()
            f, c, g = np.zeros(span * n), np.zeros(span * n, np.int64), np.zeros(span * n)
            for d, w, k, piece, begin, active, node_of in levels:
                from_, row = (d - k) % span * n + w, d % span * n
                v, m, each = f[from_] + lp[piece], c[from_] + 1, np.diff(begin, append=len(w))
                top = np.maximum.reduceat(v, begin)
                rank = np.where(v == np.repeat(top, each), m * len(w) + np.arange(len(w)), np.iinfo(np.int64).max)
                pick = np.minimum.reduceat(rank, begin) % len(w)
                f[row + active], c[row + active] = top[node_of], m[pick][node_of]
                done = active[size[active] == d]
                score[at[done]], count[at[done]] = f[row + done], c[row + done]
                if total:
                    v = g[from_] + lp[piece]
                    most = np.maximum.reduceat(v, begin)
                    g[row + active] = (most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, each)), begin)))[node_of]
                    sums[at[done]] = g[row + done]
                if last is not None:
                    last[d, active] = piece[pick][node_of]
            if used is not None:
                depth, each, mine = size.copy(), np.arange(n), weights[at]
                while len(each := each[depth[each] > 0]):
                    piece = last[depth[each], each]
                    np.add.at(used, piece, mine[each])
                    depth[each] -= self.sizes[piece]
        return (score, count, *((sums,) if total else ()), *(() if used is None else (used,)))

    def _best_alone(self, word: bytes, total: bool, last: np.ndarray | None) -> tuple[float, int, float]:
        """A word that shares its trie with no other: plain numbers, which beat arrays of a few elements."""
        span, lp = self.longest + 1, self.columns[0].tolist()
        f, c, g = [0.0] * span, [0] * span, [0.0] * span
        for d, _, k, piece, *_ in self._levels([word]) if word else ():
            cut = [((d - x) % span, lp[p], p) for x, p in zip(k.tolist(), piece.tolist(), strict=True)]
            row = d % span
            top, fewest, end = max((f[x] + y, -c[x], p) for x, y, p in cut)
            if total:
                v = [g[x] + y for x, y, _ in cut]
                most = max(v)
                g[row] = most + math.log(sum(math.exp(x - most) for x in v))
            f[row], c[row] = top, 1 - fewest
            if last is not None:
                last[d] = end
        return f[len(word) % span], c[len(word) % span], g[len(word) % span]

    def pieces_of(self, w: bytes) -> list[int]:
        """The best segmentation of one word."""
        f: list[tuple[float, int, int, int]] = [(0.0, 0, 0, -1)]
        lp = self.logp[:, 0]
        for d in range(1, len(w) + 1):
            cut = ((f[d - k][0] + lp[p], -f[d - k][1] - 1, k, p) for k in range(1, min(d, self.longest) + 1) if (p := self.ids.get(w[d - k : d])) is not None)
            v, c, k, p = max(cut)
            f.append((v, -c, k, p))
        out, d = [], len(w)
        while d:
            out.append(f[d][3])
            d -= f[d][2]
        return out[::-1]
