"""Byte-pair merging with a segment tree over symbol positions, for one word or many at once.

A leaf holds ``rank * capacity + position`` of the pair that starts at its position, so the root
is the leftmost pair of least rank. A merge writes three leaves (the pair itself, its consumed
right half and its live left neighbour) and climbs from each: a logarithmic number of updates.
Words are run in lock step, one merge each per round, in arrays of equal capacity.
"""

from __future__ import annotations

import base64

import numpy as np

NONE = np.int64(1) << np.int64(60)
#: Words of more symbols are merged one by one, in plain Python lists.
WIDE = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """(left, right) -> rank of the merge, and rank -> merged symbol; open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int], merged: np.ndarray):
        self.merged = merged
        self.bits = max(4, int(len(pairs) * 2.5).bit_length())
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.uint64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.ranks_of = dict(zip(keys.tolist(), ranks.tolist(), strict=True))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(size, NONE, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slots, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[slots], self.ranks[slots] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out


def merge_one(symbols: list[int], pairs: Pairs) -> list[int]:
    """The symbols of one word after all merges."""
    n = len(symbols)
    cap = 1 << max(1, (n - 1).bit_length())
    none, ranks_of, merged = int(NONE), pairs.ranks_of, pairs.merged
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * cap)

    def key(i: int, j: int) -> int:
        r = ranks_of.get((sym[i] << 32) | sym[j])
        return none if r is None else r * cap + i

    for i in range(n - 1):
        tree[cap + i] = key(i, i + 1)
    for i in range(cap - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += cap
        tree[i] = value
        i >>= 1
        while i:
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    while tree[1] < none:
        rank, i = divmod(tree[1], cap)
        j = nxt[i]
        k = nxt[j]
        sym[i], sym[j], nxt[i] = int(merged[rank]), -1, k
        put(j, none)
        if k < n:
            prv[k] = i
        put(i, key(i, k) if k < n else none)
        if (h := prv[i]) >= 0:
            put(h, key(h, i))
    return [s for s in sym if s >= 0]


def _merge_block(sym: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> None:
    """Merge in place; sym is rows x capacity, -1 where a row has no symbol (any more)."""
    n, cap = sym.shape
    place = np.arange(cap)
    nxt = np.where(place + 1 < lengths[:, None], place + 1, cap)
    prv = np.broadcast_to(place - 1, (n, cap)).copy()
    tree = np.full((n, 2 * cap), NONE, np.int64)
    r, p = np.nonzero(place + 1 < lengths[:, None])
    rank = pairs.rank(sym[r, p], sym[r, p + 1])
    tree[r, cap + p] = np.where(rank < NONE, rank * cap + p, NONE)
    level = cap
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    t, s, nx, pv = tree.reshape(-1), sym.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = t[rows * (2 * cap) + 1]
        i = top & (cap - 1)
        new = pairs.merged[top // cap]
        leaf, cell = rows * (2 * cap) + cap, rows * cap
        j = nx[cell + i]
        k = nx[cell + j]
        s[cell + i] = new
        s[cell + j] = -1
        nx[cell + i] = k
        t[leaf + j] = NONE
        on = k < cap
        right = np.full(len(rows), NONE, np.int64)
        if on.any():
            ck = (cell + k)[on]
            pv[ck] = i[on]
            rank = pairs.rank(new[on], s[ck])
            right[on] = np.where(rank < NONE, rank * cap + i[on], NONE)
        t[leaf + i] = right
        h = pv[cell + i]
        on = h >= 0
        if on.any():
            rank = pairs.rank(s[(cell + h)[on]], new[on])
            t[(leaf + h)[on]] = np.where(rank < NONE, rank * cap + h[on], NONE)
        base = rows * (2 * cap)
        a, b, c = (cap + i) >> 1, (cap + j) >> 1, (cap + np.where(on, h, i)) >> 1
        step = cap >> 1
        while step:
            for node in (a, b, c):
                two = base + 2 * node
                t[base + node] = np.minimum(t[two], t[two + 1])
            a, b, c = a >> 1, b >> 1, c >> 1
            step >>= 1
        rows = rows[t[base + 1] < NONE]


def merge_many(words: list[np.ndarray], pairs: Pairs) -> list[np.ndarray]:
    """The symbols of every word after all merges."""
    out: list[np.ndarray | None] = [None] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    done = lengths < 2
    for w in np.flatnonzero(done):
        out[w] = words[w]
    for w in np.flatnonzero(lengths > WIDE):
        out[w] = np.array(merge_one(words[w].tolist(), pairs), np.int64)
        done[w] = True
    cap = 2
    while not done.all():
        group = np.flatnonzero(~done & (lengths <= cap))
        done[group] = True
        rows = max(1, (1 << 19) // cap)
        for at in range(0, len(group), rows):
            part = group[at : at + rows]
            size = lengths[part]
            sym = np.full((len(part), cap), -1, np.int64)
            sym[np.arange(cap) < size[:, None]] = np.concatenate([words[w] for w in part])
            _merge_block(sym, size, pairs)
            live = sym >= 0
            ends = np.cumsum(live.sum(1))
            flat = sym[live]
            for w, a, b in zip(part, np.concatenate(([0], ends[:-1])), ends, strict=True):
                out[w] = flat[a:b]
        cap *= 2
    return out  # type: ignore[return-value]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_pairs(ranks: dict[bytes, int]) -> Pairs:
    """Any two tokens whose bytes together are a token merge, at that token's rank."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a = ranks.get(token[:cut])
            if a is not None and (b := ranks.get(token[cut:])) is not None:
                pairs[a, b] = rank
    merged = np.arange(max(ranks.values()) + 1, dtype=np.int64)
    return Pairs(pairs, merged)
