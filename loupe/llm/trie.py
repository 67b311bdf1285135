"""Double-array tries over phrases of 64-bit word keys, advanced for all positions of a text at once.

A word of the trie has a code, 1 and up in the order of the keys; 0 stands for every other
word and for the end of a piece. A code is read as two symbols, so that no node has more
children than the square root of the number of words. The node of a one-word prefix is its code; the
child of node ``s`` by symbol ``c`` is slot ``base[s] + c`` if that slot's ``check`` is ``s``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from loupe.llm.textops import U64

#: Children from which a node is placed by itself into a dense region; fewer are placed at random, many nodes at a time.
MANY = 8


@dataclass
class Trie:
    """``row`` gives the number of the phrase that ends at a node (-1: none); ``whole``: the words are all that matter to any trie of the level."""
    words: np.ndarray
    radix: int
    base: np.ndarray
    check: np.ndarray
    row: np.ndarray
    whole: bool
    starts: np.ndarray
    shift: int

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, looked up in buckets of its leading bits."""
        out = np.zeros(len(keys), np.int32)
        bucket = (keys >> U64(self.shift)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            i = at[todo]
            hit = self.words[i] == keys[todo]
            out[todo[hit]] = i[hit] + 1
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node reached from each live node by one word (0: none)."""
        mid = self.base[state] + code // self.radix
        mid = np.where(self.check[mid] == state, mid, 0)
        end = self.base[mid] + code % self.radix
        return np.where((self.check[end] == mid) & (mid > 0) & (code > 0), end, 0).astype(np.int64)


def build(words: np.ndarray, phrases: list[tuple[np.ndarray, np.ndarray]], whole: bool) -> Trie:
    """A trie of ``phrases``: for each length the keys (one row a phrase) and the phrases' numbers; ``words``: sorted keys of their words."""
    v = len(words)
    radix = max(2, int(np.ceil(np.sqrt(v + 1))))
    bits = max(1, v.bit_length())
    counts = np.bincount((words >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    nodes = _Slots(v + 1)
    coded = [(np.searchsorted(words, keys) + 1, numbers) for keys, numbers in phrases]
    reached = [c[:, 0].astype(np.int64) for c, _ in coded]
    depth = max((c.shape[1] for c, _ in coded), default=0)
    ends = [(c[:, 0], numbers) for c, numbers in coded if c.shape[1] == 1]
    for k in range(1, depth):
        for symbol in (lambda c: c // radix, lambda c: c % radix):
            longer = [i for i, (c, _) in enumerate(coded) if c.shape[1] > k]
            parents = np.concatenate([reached[i] for i in longer])
            child = nodes.add(parents, np.concatenate([symbol(coded[i][0][:, k]) for i in longer]), radix)
            for i, part in zip(longer, np.split(child, np.cumsum([len(reached[i]) for i in longer])[:-1])):
                reached[i] = part
        ends += [(reached[i], coded[i][1]) for i in longer if coded[i][0].shape[1] == k + 1]
    size = len(nodes.base) + radix + 1
    base, check, row = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[:len(nodes.base)], check[:len(nodes.check)] = nodes.base, nodes.check
    for nodes_at, numbers in ends:
        row[nodes_at] = numbers
    return Trie(words, radix, base, check, row, whole, np.r_[0, np.cumsum(counts)], 64 - bits)


class _Slots:
    """The double array while it is filled; slots up to ``taken`` are one-word nodes."""

    def __init__(self, taken: int):
        self.base = np.zeros(taken, np.int32)
        self.check = np.full(taken, -1, np.int32)
        self.random = np.random.default_rng(11)

    def add(self, parents: np.ndarray, symbols: np.ndarray, radix: int) -> np.ndarray:
        """Children of nodes without children so far; returns the slot of each given (parent, symbol)."""
        edges, inverse = np.unique(parents * radix + symbols, return_inverse=True)
        up, c = edges // radix, edges % radix
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]]) if len(up) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(up)])
        base = np.zeros(len(first), np.int64)
        begin = len(self.base)
        many = np.flatnonzero(size > MANY)
        dense = self._dense([c[first[g]:first[g] + size[g]] for g in many], radix)
        base[many] = dense[0] + begin
        few = np.flatnonzero(size <= MANY)
        width = int(4 * size[few].sum()) + 2 * radix
        begin += dense[1]
        base[few] = self._scattered(first[few], size[few], c, width, radix) + begin
        total = begin + width + radix
        slot = np.repeat(base, size) + c
        self.base = np.concatenate([self.base, np.zeros(total - len(self.base), np.int32)])
        self.check = np.concatenate([self.check, np.full(total - len(self.check), -1, np.int32)])
        self.base[up[first]] = base
        self.check[slot] = up
        return slot[inverse]

    @staticmethod
    def _dense(groups: list[np.ndarray], radix: int, window: int = 64) -> tuple[np.ndarray, int]:
        """First fit of symbol sets, largest first, close to the end of the region; bases and the region's width."""
        base, used, end = np.zeros(len(groups), np.int64), np.zeros(max(1, len(groups)) * radix + radix + window, bool), 0
        for g in sorted(range(len(groups)), key=lambda g: -len(groups[g])):
            c = groups[g]
            tries = max(0, end - radix) + np.arange(window) * max(1, radix // window)
            free = ~used[tries[:, None] + c].any(1)
            at = int(tries[free.argmax()]) if free.any() else end
            base[g] = at
            used[at + c] = True
            end = max(end, at + int(c[-1]) + 1)
        return base, end + radix

    def _scattered(self, first: np.ndarray, size: np.ndarray, c: np.ndarray, width: int, radix: int) -> np.ndarray:
        """Bases at which the small symbol sets meet free slots only, tried at random for all sets at once."""
        base = np.zeros(len(first), np.int64)
        used = np.zeros(width + radix, bool)
        claim = np.zeros(width + radix, np.int64)
        todo = np.argsort(-size, kind="stable")
        while len(todo):
            n = size[todo]
            cut = np.r_[0, np.cumsum(n)[:-1]]
            edge = np.repeat(first[todo] - cut, n) + np.arange(n.sum())
            tried = self.random.integers(0, width, len(todo))
            slot, owner = np.repeat(tried, n) + c[edge], np.repeat(np.arange(len(todo)), n)
            claim[slot] = owner
            ok = np.logical_and.reduceat(~used[slot] & (claim[slot] == owner), cut)
            used[slot[np.repeat(ok, n)]] = True
            base[todo[ok]] = tried[ok]
            todo = todo[~ok]
        return base
