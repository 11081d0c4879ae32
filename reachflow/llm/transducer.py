"""Byte-pair encoding of words by a lazily determinised transducer, many words in lockstep.

The encoding of a prefix is unique, and a token sequence is an encoding exactly when every two neighbours are the
encoding of their own concatenation. The nondeterministic transducer guesses where tokens begin; all its live guesses
after some symbols are suffixes of one another, so that the longest suffix that begins a token is the deterministic
state, and the tokens that end there are its outputs. Of these the one that fits the token before it is the last token
of the prefix. Tokens leave once all live places have them behind, a bounded lookahead. States, arcs and the table of
fitting neighbours are made when a text first needs them.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np

#: Arcs and pairs are kept in tables of at most this many slots; at half of that, a table is emptied and made anew.
SLOTS, LEAST_SLOTS = 1 << 20, 1 << 15
#: Longer words are encoded one at a time, with settled tokens sent out on the way.
LOCKSTEP = 64
NEVER = 1 << 60
_TIMES, _FREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


class Table:
    """An open-addressing map from 64-bit keys to integers, read by whole arrays; it doubles when half full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.used = np.full(LEAST_SLOTS, _FREE), np.zeros(LEAST_SLOTS, np.int32), 0

    def slots_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _TIMES) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        slot, last = self.slots_of(keys), len(self.keys) - 1
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != _FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & last
            at, key = self.keys[slot[open_]], keys[open_]
            out[open_] = np.where(at == key, self.values[slot[open_]], np.int32(-1))
            open_ = open_[(at != key) & (at != _FREE)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        size = len(self.keys)
        while 2 * (self.used + len(keys)) > size:
            size *= 2
        if size > len(self.keys):
            full = np.flatnonzero(self.keys != _FREE)
            old = self.keys[full], self.values[full]
            self.keys, self.values, self.used = np.full(size, _FREE), np.zeros(size, np.int32), 0
            self.put(*old)
        slot, last = self.slots_of(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) & last
        self.used += len(keys)


class Merges:
    """The rank and the id of each pair of ids that merge, and the pair of each id, in arrays: some 20 bytes a merge."""

    def __init__(self, pairs: list[tuple[int, int]], ids: list[int]):
        """The pairs in the order of their ranks, and the ids that they give."""
        keys = np.array(pairs, np.int64).reshape(-1, 2)
        whole = keys[:, 0] << 32 | keys[:, 1]
        order = np.argsort(whole, kind="stable")
        self.keys, self.ranks = array("q", whole[order].tobytes()), array("i", order.astype(np.int32).tobytes())
        self.ids = array("i", np.array(ids, np.int32)[order].tobytes())
        made = np.full((max(ids, default=-1) + 1, 2), -1, np.int32)
        made[ids] = keys
        self.made = made

    def get(self, a: int, b: int) -> tuple[int, int] | None:
        key = a << 32 | b
        i = bisect_left(self.keys, key)
        return (self.ranks[i], self.ids[i]) if i < len(self.keys) and self.keys[i] == key else None

    def parts(self, token: int) -> tuple[int, int] | None:
        if token >= len(self.made) or self.made[token, 0] < 0:
            return None
        return int(self.made[token, 0]), int(self.made[token, 1])


class Transducer:
    """Maps words, as strings of symbols, to token ids.

    tokens: the symbols of each id. merges: the rank of each pair of ids that merge, and the id that they give, as
    (rank, id) or None: a function of two ids. parts: the two ids of which a token is merged, or None for a symbol.
    """

    def __init__(self, tokens: dict[str, int], merges, parts):
        self.tokens, self.merges, self.parts = tokens, merges, parts
        self.begins = {token[:n] for token in tokens for n in range(1, len(token) + 1)}
        self.longest = max(map(len, tokens))
        self.spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.arcs, self.pairs = Table(), Table()
        self.number: dict[str, int] = {"": 0}
        self.names: list[str] = [""]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.flat: tuple[np.ndarray, ...] | None = None

    def spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The parts of a token at its right (or left) edge, from the symbol on, each with the rank that makes it."""
        key = (token, right)
        if key not in self.spines:
            pair = self.parts(token)
            if pair is None:
                self.spines[key] = [(token, -1)]
            else:
                self.spines[key] = [*self.spine(pair[right], right), (token, self.merges(*pair)[0])]
        return self.spines[key]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens may follow each other: at no time do the parts at their border merge first.

        Of equal ranks the leftmost merges first, so that a merge within the left token goes before one across the
        border, and that before one within the right token.
        """
        a, b, i, j = self.spine(left, True), self.spine(right, False), 0, 0
        while True:
            ra = a[i + 1][1] if i + 1 < len(a) else NEVER
            rb = b[j + 1][1] if j + 1 < len(b) else NEVER
            across = self.merges(a[i][0], b[j][0])
            if across is not None and across[0] < ra and across[0] <= rb:
                return False
            if ra == rb == NEVER:
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1

    def state(self, name: str) -> int:
        """The number of the state of the longest suffix of name that begins a token."""
        while name and name not in self.begins:
            name = name[1:]
        if name not in self.number:
            self.number[name] = len(self.names)
            self.names.append(name)
            self.ends.append([(t, len(name) - i) for i in range(len(name)) if (t := self.tokens.get(name[i:])) is not None])
            self.flat = None
        return self.number[name]

    def outputs(self) -> tuple[np.ndarray, ...]:
        """For all states: where their outputs begin, how many they are; tokens and lengths of all outputs."""
        if self.flat is None:
            counts = np.array([len(e) for e in self.ends])
            pairs = np.array([p for e in self.ends for p in e] or [(0, 0)], np.int64)
            self.flat = (np.cumsum(counts) - counts, counts, pairs[:, 0].astype(np.int32), pairs[:, 1])
        return self.flat

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        keys = state.astype(np.uint64) << np.uint64(32) | symbol
        following = self.arcs.get(keys)
        lack = np.flatnonzero(following < 0)
        if len(lack):
            new, inverse = np.unique(keys[lack], return_inverse=True)
            if self.arcs.used + len(new) > SLOTS // 2:
                self.arcs.clear()
            made = np.array([self.state(self.names[k >> 32] + chr(k & 0xFFFFFFFF)) for k in new.tolist()], np.int32)
            self.arcs.put(new, made)
            following[lack] = made[inverse]
        return following

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        known = self.pairs.get(keys)
        lack = np.flatnonzero(known < 0)
        if len(lack):
            new, inverse = np.unique(keys[lack], return_inverse=True)
            if self.pairs.used + len(new) > SLOTS // 2:
                self.pairs.clear()
            made = np.array([self.fit(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int32)
            self.pairs.put(new, made)
            known[lack] = made[inverse]
        return known > 0

    def encode_many(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        symbols = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        ids, counts = self.encode_runs(symbols, np.array([len(w) for w in words], np.int64))
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [data[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]

    def encode_runs(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that follow each other in symbols, and how many each word has."""
        begin = np.cumsum(sizes) - sizes
        rows, places, ids = [], [], []
        for i in np.flatnonzero(sizes > LOCKSTEP).tolist():
            one = self.encode("".join(map(chr, symbols[begin[i] : begin[i] + sizes[i]].tolist())))
            rows.append(np.full(len(one), i)), places.append(np.arange(len(one))), ids.append(np.array(one, np.int32))
        order = np.argsort(-sizes, kind="stable")
        order = order[np.searchsorted(-sizes[order], -LOCKSTEP) :]
        for i in range(0, len(order), 20_000):
            row, place, found = self._lockstep(symbols, begin, sizes, order[i : i + 20_000])
            rows.append(row), places.append(place), ids.append(found)
        row, place, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places, ids))
        return found[np.lexsort((place, row))], np.bincount(row, minlength=len(sizes))

    def _lockstep(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the words of order, which descend in size: word, place and id of each token."""
        size, begin = sizes[order], starts[order]
        longest = int(size[0]) if len(size) else 0
        tokens = np.full((len(order), longest + 1), -2, np.int32)
        tokens[:, 0] = -1
        back = np.zeros((len(order), longest + 1), np.int16)
        state = np.zeros(len(order), np.int32)
        for n in range(1, longest + 1):
            open_ = int(np.searchsorted(-size, -n, side="right"))
            state = self.move(state[:open_], symbols[begin[:open_] + n - 1].astype(np.uint64))
            first, many, token, length = self.outputs()
            left, k = np.flatnonzero(many[state] > 0), 0
            while len(left):
                at = first[state[left]] + k
                new, place = token[at], n - length[at]
                last = tokens[left, place]
                good = last != -2
                ask = np.flatnonzero(last >= 0)
                good[ask] = self.fits(last[ask], new[ask])
                done = left[good]
                tokens[done, n], back[done, n] = new[good], place[good]
                k += 1
                left = left[~good]
                left = left[many[state[left]] > k]
        # From the end of each word back to its begin, all words at once.
        rows, at, found = np.arange(len(order)), size.copy(), []
        rows, at = rows[at > 0], at[at > 0]
        while len(rows):
            found.append((order[rows], at, tokens[rows, at]))
            at = back[rows, at].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def encode(self, word: str) -> list[int]:
        """The ids of one word; they leave in order as soon as every live place agrees on them."""
        out: list[int] = []
        tokens: list[int | None] = [-1]  # the last token before each place, and where it begins
        back, state, known, moves = [0], 0, {}, {}
        for symbol in word:
            key = (state, symbol)
            if key not in moves:
                moves[key] = self.state(self.names[state] + symbol)
            state = moves[key]
            for token, length in self.ends[state]:
                at = len(tokens) - length
                last = tokens[at] if at >= 0 else None
                if last is None:
                    continue
                pair = (last, token)
                if pair not in known:
                    known[pair] = last < 0 or self.fit(last, token)
                if known[pair]:
                    tokens.append(token)
                    back.append(at)
                    break
            else:
                tokens.append(None)
                back.append(0)
            if len(tokens) > 4 * self.longest:
                self._settle(tokens, back, len(self.names[state]), out)
        rest, i = [], len(tokens) - 1
        while i:
            rest.append(tokens[i])
            i = back[i]
        return out + rest[::-1]

    def _settle(self, tokens: list, back: list[int], depth: int, out: list[int]) -> None:
        """Sends out the tokens that every place of the last `depth` symbols has behind it."""
        chains = []
        for i in range(max(0, len(tokens) - 1 - depth), len(tokens)):
            if tokens[i] is not None:
                chain = [i]
                while chain[-1]:
                    chain.append(back[chain[-1]])
                chains.append(chain[::-1])
        settled = sent = 0
        for k, places in enumerate(zip(*chains, strict=False)):
            if len(set(places)) > 1:
                break
            settled, sent = places[0], k
        out.extend(tokens[i] for i in chains[0][1 : sent + 1])
        for i in range(settled + 1, len(tokens)):
            if back[i] < settled:
                tokens[i] = None  # no live place leads back to it
            back[i] = max(0, back[i] - settled)
        del tokens[:settled], back[:settled]
