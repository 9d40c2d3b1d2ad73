"""Whole-batch text primitives on byte buffers: word bounds, pre-token bounds
and substring hashes, without a Python loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import codes_of

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def substring_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every data[start:end], equal for equal bytes."""
    size = 1 << max(20, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=prefix[1:])
        return (prefix[end] - prefix[start]) * down[start]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes that aren't ASCII white space."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    on = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, on[:-1]
    start = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, on[1:]
    end = np.flatnonzero(on & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    cls = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        cls[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c in "\t\n\v\f\r " else OTHER
    cls[0x80:] = LETTER
    return cls


#: Continuation bytes after 0xC2 (U+0080 to U+00BF) that are letters, and
#: those that need the library: other white space and other digits.
_C2_LETTERS = (0xAA, 0xB5, 0xBA)
_C2_HARD = (0x85, 0xA0, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)


def hard_documents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold what the byte classes can't judge: characters
    beyond U+024F, odd spaces and digits, contractions, special-token marks."""
    following = np.empty_like(data)
    if len(data):
        following[-1], following[:-1] = 0, data[1:]
    bad = (data >= 0xCA) | ((data >= 0x1C) & (data <= 0x1F))
    rare = np.flatnonzero((data == 0xC2) | (data == 0xC4) | (data == 0xC9) | (data == 0x27) | (data == 0x3C))
    kind, nxt = data[rare], following[rare]
    bad[rare] |= (
        ((kind == 0xC2) & np.isin(nxt, _C2_HARD))
        | ((kind == 0xC4) & (nxt == 0xB0))
        | ((kind == 0xC9) & (nxt > 0x8F))
        | ((kind == 0x27) & np.isin(nxt | 0x20, np.frombuffer(b"strvmld", np.uint8)))
        | ((kind == 0x3C) & (nxt == 0x7C))
    )
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    cls = _classes()[data]
    at = np.flatnonzero(data == 0xC2)
    if len(at):
        cls[at] = cls[at + 1] = np.where(np.isin(data[at + 1], _C2_LETTERS), LETTER, OTHER)
    at = np.flatnonzero(data == 0xC3)
    at = at[np.isin(data[at + 1], (0x97, 0xB7))]
    cls[at] = cls[at + 1] = OTHER
    return cls


def byte_level_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the byte-level pattern: runs of one class, a blank going
    to the run after it; white space gives up its last character to what follows."""
    cls = byte_classes(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
    start[last] = True
    start[last[data[last] == 0x20] + 1] = False
    begin = np.flatnonzero(start)
    return begin, np.append(begin[1:], len(data))


def word_level_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the word pattern: runs of letters or of other characters,
    single digits; white space falls away."""
    cls = byte_classes(data)
    start = np.zeros(len(data) + 1, bool)
    start[offsets] = True
    start = start[:-1]
    start[1:] |= cls[1:] != cls[:-1]
    start |= cls == DIGIT
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(data))
    on = cls[begin] != SPACE
    return begin[on], end[on]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every substring, index of the first of each code).  Bytes are
    compared, so a hash collision can't merge different substrings."""
    hashes = substring_hashes(data, start, end)
    codes, uniques = codes_of(hashes)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    length = end - start
    same = length == length[first[codes]]
    ends = np.cumsum(length)
    if same.all() and len(ends):
        shift = np.repeat(start[first[codes]] - (ends - length), length) + np.arange(ends[-1])
        own = np.repeat(start - (ends - length), length) + np.arange(ends[-1])
        same_bytes = data[shift] == data[own]
        if same_bytes.all():
            return codes, first
    seen: dict[bytes, int] = {}
    raw, where = data.tobytes(), []
    codes = np.empty(len(start), np.int64)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        codes[i] = k = seen.setdefault(raw[a:b], len(seen))
        if k == len(where):
            where.append(i)
    return codes, np.asarray(where, np.int64)


def join_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one after another."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1])
