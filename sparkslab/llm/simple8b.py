"""Simple-8b word-aligned integer coding, vectorised over fixed-size blocks.

A 64-bit word holds a 4-bit selector (top bits) and up to 60 payload bits, the
first value in the lowest bits.  The stream is cut into blocks of ``BLOCK``
values; each block starts on a new word and its first word's index is kept, so
all blocks are packed and unpacked side by side.  A value of more than 60 bits
is escaped: selector 0, then the raw value in the next word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
#: Selector -> (values in a word, bits of each).  Selector 0 is the escape.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([n for n, _ in SELECTORS], dtype=np.int64)
_ESCAPE = 0
_BITS16 = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
_FILL = 1 << 7  # zeros to the right of a block, so that windows can run over its end


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits each unsigned value needs (0 for 0)."""
    if values.size and values.max() < 1 << 16:
        return _BITS16[values]
    v = values.astype(np.uint64)
    bits = np.zeros(v.shape, dtype=np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = (v >> np.uint64(shift)) != 0
        bits[high] += shift
        v = np.where(high, v >> np.uint64(shift), v)
    return bits + (v != 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, offsets int64): block b's words are words[offsets[b]:offsets[b + 1]]."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    grid = np.zeros((blocks, BLOCK + _FILL), dtype=np.uint64)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = bit_lengths(grid)
    # widest[p][i]: the widest of the p values from i on, for powers of two
    widest = {1: bits}
    p = 1
    while p * 2 <= 120:
        last = widest[p]
        w = last.copy()
        w[:, :-p] = np.maximum(last[:, :-p], last[:, p:])
        p *= 2
        widest[p] = w
    choice = np.full((blocks, BLOCK), _ESCAPE, dtype=np.uint8)
    open_ = np.ones((blocks, BLOCK), dtype=bool)
    for sel in range(1, 16):
        count, width = SELECTORS[sel]
        p = 1 << (count.bit_length() - 1)
        w = widest[p]
        top = np.maximum(w[:, :BLOCK], w[:, count - p : count - p + BLOCK])
        fits = open_ & (top <= width)
        choice[fits] = sel
        open_ &= ~fits
    # walk all blocks side by side
    pos = np.zeros(blocks, dtype=np.int64)
    used = np.zeros(blocks, dtype=np.int64)
    live = np.arange(blocks)
    at_block, at_pos, at_word, at_sel = [], [], [], []
    while len(live):
        here = pos[live]
        sel = choice[live, here]
        at_block.append(live)
        at_pos.append(here)
        at_word.append(used[live])
        at_sel.append(sel)
        used[live] += 1 + (sel == _ESCAPE)
        pos[live] = here + _COUNT[sel]
        live = live[pos[live] < BLOCK]
    block, pos, word, sel = (np.concatenate(x) for x in (at_block, at_pos, at_word, at_sel))
    # a partial last block ends with its last value
    keep = block * BLOCK + pos < n
    if not keep.all():
        used = np.zeros(blocks, dtype=np.int64)
        np.maximum.at(used, block[keep], word[keep] + 1 + (sel[keep] == _ESCAPE))
        block, pos, word, sel = block[keep], pos[keep], word[keep], sel[keep]
    offsets = np.concatenate([[0], np.cumsum(used)])
    words = np.zeros(offsets[-1], dtype=np.uint64)
    index = offsets[block] + word
    source = grid.ravel()
    start = block * (BLOCK + _FILL) + pos
    for s in np.unique(sel):
        mine = sel == s
        count, width = SELECTORS[s]
        if s == _ESCAPE:
            words[index[mine] + 1] = source[start[mine]]
            continue
        packed = np.full(int(mine.sum()), np.uint64(int(s) << 60))
        if width:
            first = start[mine]
            inside = np.minimum(BLOCK - pos[mine], count)
            for k in range(count):
                value = source[first + k] if count < 2 else np.where(k < inside, source[first + k], np.uint64(0))
                packed |= value << np.uint64(k * width)
        words[index[mine]] = packed
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values as uint64."""
    words = words.astype(np.uint64, copy=False)
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    blocks = len(offsets) - 1
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (sel == _ESCAPE).any():  # a raw word can look like anything: walk those blocks
        for b in np.unique(block[sel == _ESCAPE]):
            i = offsets[b]
            while i < offsets[b + 1]:
                if sel[i] == _ESCAPE:
                    raw[i + 1] = True
                    i += 1
                i += 1
    count = np.where(raw, 0, _COUNT[sel])
    before = np.cumsum(count) - count
    start = before - before[offsets[block]] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(sel[~raw]):
        mine = np.flatnonzero((sel == s) & ~raw)
        many, width = SELECTORS[s]
        if s == _ESCAPE:
            out[start[mine]] = words[mine + 1]
        elif width:
            mask = np.uint64((1 << width) - 1)
            for k in range(many):
                at = start[mine] + k
                ok = at < end[mine]
                out[at[ok]] = (words[mine[ok]] >> np.uint64(k * width)) & mask
    return out
