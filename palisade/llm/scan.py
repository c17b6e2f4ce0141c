"""Boundaries of byte-level BPE pre-tokens, found without a regular expression.

The public split pattern is a finite automaton once every character knows its
class and, for apostrophes and white space, what follows.  A character is then
a function from states to states.  These functions form a small finite monoid,
so that composing two of them is one table lookup; composition is associative,
hence the states before all characters come from a blocked prefix scan.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, INNER, SPACE, WHITE, BREAK = range(9)
START, IN_L, IN_N, IN_O, IN_W, PREFIX, ONE_MORE, TWO_MORE = range(8)
_RAW_QUOTE, _RAW_SPACE, _RAW_WHITE = 3, 6, 7
SEPARATOR = 0x110000

_WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of every code point, and of SEPARATOR."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out = np.append(out, np.uint8(BREAK))
    out[_WHITE_SPACE] = _RAW_WHITE
    out[0x20] = _RAW_SPACE
    out[0x27] = _RAW_QUOTE
    return out


def _step(state: int, cls: int) -> tuple[int, int]:
    """(next state, 1 if a pre-token starts at this character)."""
    if cls == BREAK:
        return START, 1
    if state == ONE_MORE:
        return START, 0
    if state == TWO_MORE:
        return ONE_MORE, 0
    if state == PREFIX:
        return {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE1: IN_O, QUOTE2: IN_O}.get(cls, START), 0
    if (state, cls) in {(IN_L, LETTER), (IN_N, NUMBER), (IN_W, INNER)} or state == IN_O and cls in (OTHER, QUOTE1, QUOTE2):
        return state, 0
    return [IN_L, IN_N, IN_O, ONE_MORE, TWO_MORE, IN_W, PREFIX, START][cls], 1


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, start flag) by state and class; the monoid: product table, and state from START by element."""
    step = np.array([[_step(s, c) for c in range(9)] for s in range(8)], np.uint8)
    nxt, flag = np.ascontiguousarray(step[..., 0]), np.ascontiguousarray(step[..., 1])
    elements = list(dict.fromkeys([tuple(nxt[:, c]) for c in range(9)]))
    index = {f: i for i, f in enumerate(elements)}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for c in range(9):
            g = tuple(nxt[list(f), c])
            if g not in index:
                index[g] = len(elements)
                elements.append(g)
                todo.append(g)
    n = len(elements)
    product = np.zeros((n, n), np.uint16)
    arrays = np.array(elements)
    for i in range(n):
        composed = arrays[:, arrays[i]]  # element j after element i
        product[i] = [index[tuple(f)] for f in composed]
    of_class = np.array([index[tuple(nxt[:, c])] for c in range(9)], np.uint16)
    return nxt, flag, product, np.append(of_class, arrays[:, START].astype(np.uint16))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Lookups by 9 * element + class and by 9 * state + class; values are premultiplied by 9."""
    nxt, flag, product, packed = automaton()
    of_class, from_start = packed[:9], packed[9:]
    return (9 * of_class).astype(np.uint16), (9 * product[:, of_class]).astype(np.uint16).ravel(), (9 * from_start).astype(np.uint8), (9 * nxt).astype(np.uint8).ravel(), flag.ravel()


def start_flags(cls: np.ndarray, width: int = 64) -> np.ndarray:
    """1 where a pre-token starts, from the classes: a prefix scan over blocks of width characters."""
    of_class, act, from_start, move, flag = _tables()
    product = automaton()[2]
    n = len(cls)
    rows = max(1, -(-n // width))
    padded = np.full(rows * width, BREAK, np.uint8)
    padded[:n] = cls
    steps = np.ascontiguousarray(padded.reshape(rows, width).T)
    whole = of_class[steps[0]]
    for j in range(1, width):
        whole = act.take(whole + steps[j])
    whole //= 9
    shift = 1  # inclusive doubling scan: what each block and all before it do together
    while shift < rows:
        whole[shift:] = product[whole[:-shift], whole[shift:]]
        shift *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = from_start[whole[:-1]]
    out = np.empty((width, rows), np.uint8)
    for j in range(width):
        at = state + steps[j]
        out[j] = flag.take(at)
        state = move.take(at)
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def starts(points: np.ndarray) -> np.ndarray:
    """Start flags of pre-tokens among code points; every SEPARATOR ends a text."""
    n = len(points)
    cls = code_point_classes()[points]
    after = np.full(n + 2, SEPARATOR, np.uint32)
    after[:n] = points
    quote = np.flatnonzero(cls == _RAW_QUOTE)
    if len(quote):
        a, b = after[quote + 1], after[quote + 2]
        kind = np.full(len(quote), OTHER, np.uint8)
        kind[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)] = QUOTE2
        kind[(a == 115) | (a == 116) | (a == 109) | (a == 100)] = QUOTE1
        cls[quote] = kind
    white = np.flatnonzero(cls >= _RAW_SPACE)
    white = white[cls[white] != BREAK]
    follows = np.append(cls, np.uint8(BREAK))[white + 1]
    # what follows may itself have been white space; quotes have been classed already
    cls[white[follows >= _RAW_SPACE]] = INNER
    return start_flags(cls)


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of the texts in order, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    points[ends] = SEPARATOR
    flag = starts(points)
    at = np.flatnonzero(flag)
    is_end = np.zeros(len(points), bool)
    is_end[ends] = True
    stops = np.append(at[1:], len(points))
    keep = ~is_end[at]
    counts = np.add.reduceat(keep, np.concatenate([[0], np.searchsorted(at, ends[:-1]) + 1])) if len(texts) else np.zeros(0, np.int64)
    a, b = at[keep].tolist(), stops[keep].tolist()
    return [joined[i:j] for i, j in zip(a, b)], counts.astype(np.int64)


def groups(sizes, limit: int = 1 << 20):
    """Index ranges whose sizes add up to about limit; a larger item stands alone."""
    begin, total = 0, 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > limit:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield begin, len(sizes)
