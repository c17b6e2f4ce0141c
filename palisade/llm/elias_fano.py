"""Elias-Fano coded monotone sequences, and a trie of n-grams made of them.

A sequence of n values below u keeps the low bits of each value in a packed
array and the high bits in unary, about 2 + log2(u / n) bits a value.  The trie
stores, for every context word, the words that follow it, and for every
preceding word of the context the positions of its followers among these:
positions are relative to the shorter context's followers, hence small.
Within a level, ranges are laid end to end (each value offset by what all
ranges before it take), so that a level is one monotone sequence and a lookup
in a range is one successor search.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

#: Steps of the quantised numbers: probabilities from 2^-24 up, on a logarithmic scale of 8 bits.
_STEPS = 255
_SPAN = 24.0


def quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes of numbers from 0 to 1; code 0 is 0."""
    with np.errstate(divide="ignore"):
        code = np.rint((np.log2(p) + _SPAN) / _SPAN * (_STEPS - 1)) + 1
    return np.where(p > 0, np.clip(code, 1, _STEPS), 0).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    table = np.exp2((np.arange(256) - 1.0) / (_STEPS - 1) * _SPAN - _SPAN)
    table[0] = 0
    return table[code]


_ONE = np.uint64(1)
_L8, _H8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_M5, _M3, _M0 = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
#: Place of the r-th one of a byte, by byte and r.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _places = [i for i in range(8) if _byte >> i & 1]
    _IN_BYTE[_byte, : len(_places)] = _places


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from each position on; the array ends with a word of padding."""
    word, off = at >> 6, (at & 63).astype(np.uint64)
    high = words[word + 1] << (np.uint64(63) - off) << _ONE
    return words[word] >> off | high


def _in_word(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) of each word: its byte by the bytes' running counts, then a table."""
    s = v - (v >> _ONE & _M5)
    s = (s & _M3) + (s >> np.uint64(2) & _M3)
    s = (s + (s >> np.uint64(4)) & _M0) * _L8
    r = r.astype(np.uint64)
    byte = np.bitwise_count((r * _L8 | _H8) - s & _H8).astype(np.uint64) << np.uint64(3)
    r -= s << np.uint64(8) >> byte & np.uint64(255)
    return byte.astype(np.int64) + _IN_BYTE[(v >> byte & np.uint64(255)).astype(np.int64), r.astype(np.int64)]


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bits of the values end to end in 64-bit words, and two words of padding."""
    out, bits = [], np.arange(width, dtype=np.uint64)
    for a in range(0, len(values) if width else 0, 1 << 15):
        part = values[a : a + (1 << 15)]
        part = np.concatenate([part, np.zeros(-len(part) % 64, np.uint64)])  # 64 values fill whole words
        out.append(np.packbits((part[:, None] >> bits & _ONE).astype(np.uint8), bitorder="little").view(np.uint64))
    return np.concatenate([*out, np.zeros(2, np.uint64)])


class EliasFano:
    """Monotone non-decreasing unsigned integers: packed low bits, and high parts in unary as packed bits, with the number of ones before each word.

    The unary code begins with a zero: zero t stands before the values whose
    high part is t, one i is value i.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray, tops: int):
        self.n, self.width, self.low, self.high, self.rank, self.tops = n, width, low, high, rank, tops
        ones = rank.astype(np.int64)
        self.before = ones, 64 * np.arange(len(rank)) - ones  # of ones, of zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        u = int(values[-1]) + 1 if n else 1
        width = max(0, (u // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64)
        tops = int(top[-1] if n else 0) + 2  # high parts with a zero before and a zero behind
        bits = np.zeros(n + tops + 1 + 63 & ~63, np.uint8)
        bits[top + np.arange(n) + 1] = 1
        high = np.concatenate([np.packbits(bits, bitorder="little").view(np.uint64), np.zeros(2, np.uint64)])
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        rank = np.concatenate([[0], ones[:-1]]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(n, width, _packed(values, width), high, rank, tops)

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th one (flip: zero) of the unary code."""
        before = self.before[flip]
        word = np.searchsorted(before, k, side="right") - 1
        v = self.high[word]
        return 64 * word + _in_word(~v if flip else v, k - before[word])

    def _range(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with each high part begin and end."""
        zero = self._select(top, True)
        v = ~_window(self.high, zero + 1)
        end = zero + 1 + np.bitwise_count((v & (~v + _ONE)) - _ONE)  # the next zero
        far = np.flatnonzero(v == 0)
        if len(far):
            end[far] = self._select(top[far] + 1, True)
        return zero - top, end - top - 1

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        return _window(self.low, at * self.width) & np.uint64((1 << self.width) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        top = self._select(at.astype(np.int64), False) - at - 1
        return (top.astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first stored value that is not below each of the values; n if there is none."""
        return self._search(values)[0]

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor of each value, and whether it is the value itself."""
        values = values.astype(np.uint64)
        top = (values >> np.uint64(self.width)).astype(np.int64)
        beyond = top >= self.tops
        top[beyond] = 0
        low, end = self._range(top)
        high, last = end.copy(), end
        want = values & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):  # binary search among values with the same high part
            middle = (low[open_] + high[open_]) >> 1
            below = self._low(middle) < want[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        same = (low < last) & ~beyond
        same[same] = self._low(low[same]) == want[same]
        low[beyond] = self.n
        return low, same

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 if it is not stored."""
        at, same = self._search(values)
        return np.where(same, at, -1)


class Trie:
    """Levels in one file: head words; followers of a word; words before a word; followers of a pair."""

    LEVELS = ("words", "follow_end", "follow", "before_end", "before", "pair_end", "pair")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        for name in self.LEVELS:
            n, width, tops = (int(x) for x in parts[name + ".head"])
            setattr(self, name, EliasFano(n, width, *(parts[f"{name}.{x}"] for x in ("low", "high", "rank")), tops))
        self.vocabulary, self.universe = parts["vocabulary"], np.uint64(max(1, len(parts["vocabulary"])))
        for name in ("follow_p", "word_rest", "pair_p", "pair_rest"):
            setattr(self, name, parts[name])

    @classmethod
    def build(cls, vocabulary: np.ndarray, b: np.ndarray, w: np.ndarray, a: np.ndarray, count: np.ndarray, discount: float) -> "Trie":
        """From distinct trigrams (word before, word, word after; places in the sorted vocabulary) and their counts, sorted by (w, b, a).

        An n-gram keeps max(count - discount, 0) / total of its context; a
        context keeps discount * distinct followers / total for the order
        below.  Counts of the lower order are numbers of distinct words before.
        """
        u, d = np.int64(max(1, len(vocabulary))), discount
        # followers of a word; `of` is the follower that each trigram ends with
        key = w.astype(np.int64) * u + a
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        first = np.diff(key, prepend=-1) != 0
        follow = key[first]
        of = np.empty(len(order), np.int32)
        of[order] = np.cumsum(first, dtype=np.int32) - 1
        del key, order, first
        kinds = np.bincount(of, minlength=len(follow))
        words, head = np.unique(follow // u, return_inverse=True)
        total, distinct = np.bincount(head, kinds, len(words)), np.bincount(head, minlength=len(words))
        follow_p = np.maximum(kinds - d, 0) / np.maximum(total, 1)[head]
        word_rest = np.bincount(head, np.minimum(kinds, d), len(words)) / np.maximum(total, 1)
        follow_end = np.cumsum(distinct)
        # words before a word, and the pair's followers by their place in the word's range
        key = w.astype(np.int64) * u + b
        first = np.diff(key, prepend=-1) != 0
        pairs, pair_of = key[first], np.cumsum(first, dtype=np.int32) - 1
        del key, first
        owner = np.searchsorted(words, pairs // u)
        place_of = of - (follow_end - distinct)[head[of]]
        pair_total, pair_kinds = np.bincount(pair_of, count, len(pairs)), np.bincount(pair_of, minlength=len(pairs))
        pair_p = np.maximum(count - d, 0) / np.maximum(pair_total, 1)[pair_of]
        pair_rest = np.bincount(pair_of, np.minimum(count, d), len(pairs)) / np.maximum(pair_total, 1)
        del of
        widest = np.int64(distinct.max() if len(distinct) else 1)
        levels = {
            "words": words,
            "follow_end": follow_end,
            "follow": head * u + follow % u,
            "before_end": np.cumsum(np.bincount(owner, minlength=len(words))),
            "before": owner * u + pairs % u,
            "pair_end": np.cumsum(pair_kinds),
            "pair": pair_of.astype(np.int64) * widest + place_of,
        }
        parts = {"vocabulary": vocabulary, "widest": np.array([widest]), "follow_p": quantise(follow_p), "word_rest": quantise(word_rest), "pair_p": quantise(pair_p), "pair_rest": quantise(pair_rest)}
        for name, values in levels.items():
            coded = EliasFano.encode(values)
            parts |= {name + ".head": np.array([coded.n, coded.width, coded.tops])} | {f"{name}.{x}": getattr(coded, x) for x in ("low", "high", "rank")}
        return cls(parts)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 if it is unknown."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def lookup(self, b: np.ndarray, w: np.ndarray, a: np.ndarray, pairs_only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(A, B): P(a | b w) = A + B * P(a), for words by their number; where pairs_only, P(a | b w) = A + B * P(a | w).

        What follows the same word, or the same pair, is looked up once for
        each run of it.
        """
        given, rest = np.zeros(len(w)), np.ones(len(w))
        if not len(w):
            return given, rest
        w, b, a = (x.astype(np.int64) for x in (w, b, a))
        new = np.append(True, w[1:] != w[:-1])
        run = np.cumsum(new) - 1
        heads = self.words.find(np.maximum(w[new], 0).astype(np.uint64))
        heads[w[new] < 0] = -1
        begins = np.zeros(len(heads), np.int64)
        later = heads > 0
        begins[later] = self.follow_end.access(heads[later] - 1).astype(np.int64)
        head = heads[run]
        seen = np.flatnonzero(head >= 0)
        h, after, before = head[seen], a[seen], b[seen]
        follow = self.follow.find(h.astype(np.uint64) * self.universe + np.maximum(after, 0).astype(np.uint64))
        follow[after < 0] = -1
        rest[seen] = restore(self.word_rest[h])
        hit = follow >= 0
        given[seen[hit]] = restore(self.follow_p[follow[hit]])
        if pairs_only is not None:
            given[pairs_only], rest[pairs_only] = 0.0, 1.0
        if not len(seen):
            return given, rest
        key = h.astype(np.uint64) * self.universe + np.maximum(before, 0).astype(np.uint64)
        new = np.append(True, (key[1:] != key[:-1]) | (before[1:] != before[:-1]))
        pair = self.before.find(key[new])
        pair[before[new] < 0] = -1
        pair = pair[np.cumsum(new) - 1]
        in_pair = np.flatnonzero(pair >= 0)
        at, k = seen[in_pair], pair[in_pair]
        share = restore(self.pair_rest[k])
        given[at] *= share
        rest[at] *= share
        both = np.flatnonzero(follow[in_pair] >= 0)
        place = follow[in_pair[both]] - begins[run[at[both]]]
        third = self.pair.find(k[both].astype(np.uint64) * np.uint64(int(self.parts["widest"][0])) + place.astype(np.uint64))
        good = third >= 0
        given[at[both[good]]] += restore(self.pair_p[third[good]])
        return given, rest

    def mapped(self) -> "Trie":
        """The same trie over a memory-mapped file, which has no name any more and goes with the process."""
        sizes = {k: v.nbytes for k, v in self.parts.items()}
        fd, path = tempfile.mkstemp(prefix="palisade-trie-")
        try:
            with os.fdopen(fd, "w+b") as f:
                for v in self.parts.values():
                    f.write(np.ascontiguousarray(v).tobytes() + b"\0" * (-v.nbytes % 8))
                f.flush()
                whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)
        parts, at = {}, 0
        for k, v in self.parts.items():
            parts[k] = np.frombuffer(whole, v.dtype, len(v), at) if len(v) else v
            at += sizes[k] + (-sizes[k] % 8)
        return Trie(parts)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.parts.values())
