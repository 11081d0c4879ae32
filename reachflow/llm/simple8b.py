"""Simple-8b word-aligned integer coding, vectorised over blocks.

A 64-bit word holds a 4-bit selector in its low bits and, above, as many values of equal width as the selector says.
Selector 0 is the escape: the next word is one raw 64-bit value. Values come in blocks of BLOCK; every block begins a
new word and the index of its first word is kept, so that blocks decode independently. The last word of a block may
have room left; its unused fields are zero.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the coding: values in a word and bits of each, by selector (0: escape).
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
SLACK = 128
U = np.uint64


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value: the exponents of its halves, which floats hold exactly."""
    high = np.frexp((values >> U(32)).astype(np.float64))[1]
    low = np.frexp((values & U(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (uint64) of the values and the index of each block's first word (with the end)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, U), np.zeros(1, np.int64)
    grid = np.zeros((blocks, BLOCK + SLACK), U)  # rows end in zeros, so that words may run past a block's end
    flat = np.zeros(blocks * BLOCK, U)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    bits = bit_lengths(grid)
    # The greatest width in the next 2**k values, then in the next `count`, picks the densest selector at each place.
    longest, spans = [bits], [1]
    while spans[-1] < 64:
        last, span = longest[-1], spans[-1]
        longest.append(np.maximum(last, np.concatenate((last[:, span:], np.zeros((blocks, span), np.uint8)), axis=1)))
        spans.append(2 * span)
    best = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(15, 0, -1):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        k = max(i for i, s in enumerate(spans) if s <= count)
        reach = np.maximum(longest[k][:, :BLOCK], longest[k][:, count - spans[k] : count - spans[k] + BLOCK])
        best[reach <= width] = selector
    steps, at = [], np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    while len(live):
        selector = best[live, at[live]]
        steps.append((live, at[live].copy(), selector))
        at[live] += np.maximum(COUNTS[selector], 1)
        live = live[at[live] < size[live]]
    block = np.concatenate([s[0] for s in steps])
    place = np.concatenate([s[1] for s in steps])
    chosen = np.concatenate([s[2] for s in steps])
    order = np.lexsort((place, block))
    block, place, chosen = block[order], place[order], chosen[order]
    takes = 1 + (chosen == 0)
    target = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), U)
    for selector in range(16):
        own = np.flatnonzero(chosen == selector)
        if not len(own):
            continue
        if selector == 0:
            words[target[own] + 1] = grid[block[own], place[own]]
            continue
        word = np.full(len(own), selector, U)
        for j in range(int(COUNTS[selector])):
            if WIDTHS[selector]:
                word |= grid[block[own], place[own] + j] << U(4 + j * int(WIDTHS[selector]))
        words[target[own]] = word
    index = np.concatenate((target[np.searchsorted(block, np.arange(blocks))], [len(words)]))
    return words, index


def decode(words: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """The n values of the words; index: as encode() gives it."""
    blocks = len(index) - 1
    if not blocks:
        return np.zeros(0, U)
    selector = (words & U(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    previous = -2
    for i in np.flatnonzero(selector == 0).tolist():  # a raw word after an escape may look like an escape
        if i != previous + 1:
            raw[i + 1] = True
            previous = i
    counts = np.where(raw, 1, COUNTS[selector])
    ends = np.cumsum(counts)
    block = np.repeat(np.arange(blocks), np.diff(index))
    base = np.concatenate(([0], ends))[index[:-1]]
    place = ends - counts - base[block]
    grid = np.zeros((blocks, BLOCK + SLACK), U)
    for s in range(1, 16):
        own = np.flatnonzero((selector == s) & ~raw)
        width = int(WIDTHS[s])
        if len(own) and width:
            mask = U((1 << width) - 1)
            for j in range(int(COUNTS[s])):
                grid[block[own], place[own] + j] = (words[own] >> U(4 + j * width)) & mask
    own = np.flatnonzero(raw)
    grid[block[own], place[own]] = words[own]
    return grid[:, :BLOCK].reshape(-1)[:n]
