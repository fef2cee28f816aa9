"""Where a text falls into pre-tokens, found by an automaton over arrays of code point classes.

The boundaries are those of public_tokenizers.PATTERN:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

No regular expression runs. Every class is a function from state to state.
The functions that arise by composing them are few, so each gets a number and
composition is a table; the states of a whole array are then a scan over
numbers, done in columns of many blocks at once, as composition is associative.
A boundary depends on the states before and after a character and on the next.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

#: Classes of code points. Letters that may end a contraction stand alone; END stands between texts.
SPACE, BLANK, QUOTE, ONE, R_V, EL, EE, LETTER, NUMBER, OTHER, END = range(11)
#: States: what the last character was part of. NEW: nothing yet; TICK: a quote that starts a token; SHUT: a whole contraction.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, TICK, TICK_RV, TICK_L, SHUT = range(10)
#: Characters of Unicode's White_Space (fixed values).
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added, for an older table in Python (fixed values).
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Columns of a block in the scan.
WIDTH = 64


def step(state: int, kind: int) -> int:
    """The automaton's next state."""
    if kind in (SPACE, BLANK, NUMBER, OTHER, END):
        return {SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, END: NEW}[kind]
    if kind == QUOTE:
        return IN_OTHER if state in (IN_OTHER, AFTER_SPACE, TICK) else TICK
    if (state, kind) in ((TICK, ONE), (TICK_RV, EE), (TICK_L, EL)):
        return SHUT
    return {(TICK, R_V): TICK_RV, (TICK, EL): TICK_L}.get((state, kind), IN_LETTERS)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, and of 0x110000, which stands for the end of a text."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    out = np.append(out, np.uint8(END))
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[list(WHITE)] = BLANK
    for text, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("rv", R_V), ("l", EL), ("e", EE)):
        out[[ord(c) for c in text]] = kind
    return out


@lru_cache(1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, composition table [first, then], values [number, state])."""
    gens = [tuple(step(s, k) for s in range(10)) for k in range(11)]
    known: dict[tuple[int, ...], int] = {}
    todo = [*gens]
    while todo:
        f = todo.pop()
        if f not in known:
            known[f] = len(known)
            todo += [tuple(g[s] for s in f) for g in gens]
    values = np.array(list(known), dtype=np.uint8)
    table = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)
    return np.array([known[g] for g in gens], dtype=np.uint8), table, values


def scan(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Composition of x[0..i] for every i: prefixes within blocks, then a scan over the blocks' totals, then both together."""
    if len(x) <= WIDTH:
        out = x.copy()
        for i in range(1, len(x)):
            out[i] = table[out[i - 1], x[i]]
        return out
    blocks = np.ascontiguousarray(np.pad(x, (0, -len(x) % WIDTH), mode="edge").reshape(-1, WIDTH).T)
    for i in range(1, WIDTH):
        blocks[i] = table[blocks[i - 1], blocks[i]]
    before = scan(blocks[-1], table)[:-1]
    blocks[:, 1:] = table[before[None, :], blocks[:, 1:]]
    return blocks.T.reshape(-1)[: len(x)]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point. points: uint32, texts separated by 0x110000, which start tokens as well."""
    if not len(points):
        return np.zeros(0, dtype=bool)
    number, table, values = functions()
    kind = classes()[points]
    state = values[scan(number[kind], table), NEW]
    before = np.append(np.uint8(NEW), state[:-1])
    after_kind, after_state = np.append(kind[1:], np.uint8(END)), np.append(state[1:], np.uint8(NEW))
    letter = (kind >= ONE) & (kind <= LETTER)
    white = kind <= BLANK
    joins = _JOINS[before, kind]
    # A quote and the letters after it are one token only if they make a contraction.
    joins[letter & (before == TICK)] = False
    joins |= letter & (before == TICK) & ((state == SHUT) | (((state == TICK_RV) | (state == TICK_L)) & (after_state == SHUT)))
    # The last of several blanks leaves its run if something follows.
    joins &= ~(white & (after_kind > BLANK) & (after_kind != END))
    return ~joins


def _joined() -> np.ndarray:
    """Whether a character of that class goes on with the token that the state before is in."""
    out = np.zeros((10, 11), dtype=bool)
    for kinds, states in (((SPACE, BLANK), (AFTER_SPACE, AFTER_BLANK)), ((ONE, R_V, EL, EE, LETTER), (IN_LETTERS, AFTER_SPACE, TICK_RV, TICK_L)), ((NUMBER,), (IN_NUMBERS, AFTER_SPACE)), ((QUOTE, OTHER), (IN_OTHER, AFTER_SPACE, TICK))):
        out[np.ix_(states, kinds)] = True
    return out


_JOINS = _joined()
