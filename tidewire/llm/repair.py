"""Re-Pair grammar compression of one shard of 16-bit ids.

Frequent pairs of neighbouring symbols are replaced by a new symbol, again and again, until no pair is left that repeats `least` times
or all 16-bit symbols are in use. The places of each frequent pair are found by one sort; after that only the neighbours of replaced
places are looked at again, so the work follows the replacements and not the rounds. A round takes all pairs that are found
often enough for a threshold that falls from round to round; where two chosen pairs overlap, the more frequent one is replaced. With
the length that each nonterminal expands to, the place of any id in the compressed sequence is a sum of lengths, so a slice is
decoded without the rest.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 1 << 16
_PLACE, _LEFT = np.uint64(31), np.uint64(47)


class _Pairs:
    """Pairs that were found `least` times or more: codes, counts (never too low), nonterminals (-1: none yet) and places."""

    def __init__(self, n: int):
        self.code = self.count = self.symbol = self.first = self.size = np.zeros(0, np.int64)
        self.pool, self.used = np.empty(3 * n, np.int32), 0  # each replaced place brings two at most

    def add(self, seq: np.ndarray, nxt: np.ndarray, at: np.ndarray, least: int) -> None:
        key = (seq[at].astype(np.uint64) << _LEFT) | (seq[nxt[at]].astype(np.uint64) << _PLACE) | at.astype(np.uint64)
        key.sort()
        code = (key >> _PLACE).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(code)))
        often = n >= least
        if not often.any():
            return
        places = (key & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int32)[np.repeat(often, n)]
        n = n[often]
        first = self.used + np.cumsum(n) - n
        self.pool[self.used : self.used + len(places)] = places
        self.used += len(places)
        live = self.count >= least
        for name, new in (("first", first), ("code", code[head[often]]), ("count", n), ("symbol", np.full(len(n), -1)), ("size", n)):
            setattr(self, name, np.concatenate([getattr(self, name)[live], new]))

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of some pairs, and which of the pairs each is of."""
        n = self.size[rows]
        which = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        return self.pool[np.arange(len(which)) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)], which


def _chosen(at: np.ndarray, which: np.ndarray, count: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which places (in order) are replaced: of a run of one pair with itself every other one, of two pairs the more frequent, else the first."""
    i = np.arange(len(at))
    same = np.zeros(len(at), bool)
    same[1:] = (nxt[at[:-1]] == at[1:]) & (which[1:] == which[:-1])
    rows = np.flatnonzero((i - np.maximum.accumulate(np.where(same, 0, i))) & 1 == 0)
    c, near = count[which[rows]], nxt[at[rows[:-1]]] == at[rows[1:]]
    keep = np.ones(len(rows), bool)
    keep[1:] &= ~near | (c[1:] > c[:-1])
    keep[:-1] &= ~near | (c[:-1] >= c[1:])
    return rows[keep]


def compress(ids: np.ndarray, vocabulary: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): 16-bit symbols, and for each nonterminal from `vocabulary` on its two symbols."""
    n = len(ids)
    seq = np.append(ids.astype(np.int32), np.int32(-2))  # the end; -1 is a place that became part of the symbol before it
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    pairs, rules, used = _Pairs(n), [], vocabulary
    near = np.zeros(n + 2, bool)
    pairs.add(seq, nxt, np.arange(max(0, n - 1)), least)
    bar = int(pairs.count.max(initial=0))
    while bar >= least:
        rows = np.flatnonzero(pairs.count >= bar)
        if not len(rows):
            bar = max(least, min(bar // 2, int(pairs.count.max(initial=0)))) if bar > least else 0
            continue
        at, which = pairs.places(rows)
        code = pairs.code[rows]
        left, right = (x.astype(np.int32) for x in (code >> 16, code & 0xFFFF))
        ok = (seq[at] == left[which]) & (seq[nxt[at]] == right[which])
        at, which = at[ok], which[ok]
        count = pairs.count[rows] = np.bincount(which, minlength=len(rows))
        good = count >= bar
        new = np.flatnonzero(good & (pairs.symbol[rows] < 0))
        if len(new) > SYMBOLS - used:  # the most frequent ones get the last symbols
            good[new[np.argsort(-count[new], kind="stable")[SYMBOLS - used :]]] = False
            pairs.count[rows[~good]] = 0
        order = np.argsort(at)
        at, which = at[order], which[order]
        while True:
            stay = good[which]
            at, which = at[stay], which[stay]
            hit = _chosen(at, which, count, nxt)
            kept = np.bincount(which[hit], minlength=len(rows))
            short = good & (kept < np.where(pairs.symbol[rows] < 0, least, 1))
            if not short.any():
                break
            good &= ~short
            pairs.count[rows[short]] = np.minimum(count[short], bar - 1)  # once more under a lower bar
        fresh = np.flatnonzero(good & (pairs.symbol[rows] < 0))
        pairs.symbol[rows[fresh]] = used + np.arange(len(fresh))
        rules.append(np.stack([left[fresh], right[fresh]], axis=1))
        used += len(fresh)
        pairs.count[rows[good]] -= kept[good]
        p = at[hit]
        q = nxt[p]
        r = nxt[q]
        seq[p], seq[q], nxt[p], prv[r] = pairs.symbol[rows[which[hit]]], -1, r, p
        near[p] = True
        before = prv[p]
        around = np.concatenate([before[(before >= 0) & ~near[before]], p])
        near[p] = False
        pairs.add(seq, nxt, around[nxt[around] < n], least)
        bar = max(least, bar // 2)
    return seq[seq >= 0].astype(np.uint16), np.concatenate(rules).astype(np.uint16) if rules else np.zeros((0, 2), np.uint16)


def lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    n: list[int] = []
    for a, b in rules.tolist():
        n.append((n[a - vocabulary] if a >= vocabulary else 1) + (n[b - vocabulary] if b >= vocabulary else 1))
    return np.array(n, np.uint32)


def _expansions(rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat expansions of all symbols, each symbol's first place there and its length."""
    parts: list[list[int]] = []
    for a, b in rules.tolist():
        parts.append((parts[a - vocabulary] if a >= vocabulary else [a]) + (parts[b - vocabulary] if b >= vocabulary else [b]))
    n = np.concatenate([np.ones(vocabulary, np.int64), np.array([len(p) for p in parts], np.int64)])
    flat = np.concatenate([np.arange(vocabulary), np.array([x for p in parts for x in p], np.int64)]).astype(np.uint16)
    return flat, np.cumsum(n) - n, n


def expand(seq: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    flat, first, n = _expansions(rules, vocabulary)
    m = n[seq]
    return flat[np.repeat(first[seq] - (np.cumsum(m) - m), m) + np.arange(m.sum())]


def expand_slice(seq: np.ndarray, rules: np.ndarray, sizes: np.ndarray, vocabulary: int, start: int, count: int) -> np.ndarray:
    """`count` ids from `start` on; only the symbols that cover them are expanded."""
    m = np.ones(len(seq), np.int64)
    m[seq >= vocabulary] = sizes[seq[seq >= vocabulary] - vocabulary]
    ends = np.cumsum(m)
    i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left") + 1
    skip = start - (ends[i - 1] if i else 0)
    stack, out = seq[i:j][::-1].tolist(), []
    while stack and len(out) < skip + count:
        x = stack.pop()
        if x >= vocabulary:
            stack.extend(rules[x - vocabulary][::-1].tolist())
        else:
            out.append(x)
    return np.array(out[skip : skip + count], np.uint16)
