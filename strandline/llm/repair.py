"""Re-Pair grammars of many short sequences at once, on arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOW = np.int64(2**32 - 1)


@dataclass
class Grammars:
    """Symbols below `terminals` stand for themselves; rule i makes symbol terminals + i of two earlier ones.

    group: of each symbol, the sequence it belongs to; word: of each terminal, what it was in its sequence; left: the
    symbols that remain, of all sequences; levels: where the rules of each round begin.
    """

    group: np.ndarray
    word: np.ndarray
    terminals: int
    pairs: np.ndarray
    left: np.ndarray
    levels: list[int]

    def upwards(self, values: np.ndarray, join) -> np.ndarray:
        """Values of all symbols, from those of the terminals: a rule has join(its first, its second)."""
        out = np.concatenate([values, np.zeros(len(self.pairs), values.dtype)])
        for a, b in zip(self.levels, [*self.levels[1:], len(self.pairs)]):
            p = self.pairs[a:b]
            out[self.terminals + a : self.terminals + b] = join(out[p[:, 0]], out[p[:, 1]])
        return out

    def uses(self) -> np.ndarray:
        """How often each symbol occurs in its sequence, within rules too."""
        out = np.bincount(self.left, minlength=len(self.group)).astype(np.int64)
        for a, b in reversed(list(zip(self.levels, [*self.levels[1:], len(self.pairs)]))):
            p, n = self.pairs[a:b], out[self.terminals + a : self.terminals + b]
            np.add.at(out, p[:, 0], n)
            np.add.at(out, p[:, 1], n)
        return out

    def sizes(self, groups: int) -> np.ndarray:
        """Of each sequence, the symbols that its grammar is written with: what is left and two a rule."""
        return np.bincount(self.group[self.left], minlength=groups) + 2 * np.bincount(self.group[self.terminals :], minlength=groups)


def re_pair(words: np.ndarray, group: np.ndarray, least: int = 2) -> Grammars:
    """Grammars of the sequences that `group` (not decreasing) marks in words, with rules used at least `least` times.

    A round replaces, in every sequence, all pairs of neighbours that are the most frequent pair of both their symbols
    (ties by the lower symbols), until none is frequent enough. The most frequent pair of a sequence always is one of them.
    """
    names, s = np.unique((group.astype(np.int64) << 32) | words.astype(np.int64), return_inverse=True)
    s, g, top, word = s.astype(np.int64), group.astype(np.int64), len(names), names & _LOW
    of, best = np.zeros(top + len(s), np.int64), np.zeros(top + len(s), np.int64)
    of[:top] = names >> 32
    pairs, levels, finished = [np.zeros((0, 2), np.int64)], [], []
    made = 0
    while len(s) > 1:
        key = (s[:-1] << 32) | s[1:]
        fits = g[:-1] == g[1:]
        twin = fits & (s[:-1] == s[1:])
        if twin.any():  # of a run of one symbol, every second place
            at = np.flatnonzero(twin)
            first = np.append(True, np.diff(at) > 1)
            start = np.maximum.accumulate(np.where(first, at, 0))
            fits[at[(at - start) % 2 == 1]] = False
        found, n = np.unique(key[fits], return_counts=True)
        found, n = found[n >= least], n[n >= least]
        if not len(found):
            break
        a, b = found >> 32, found & _LOW
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((-np.arange(len(found)), n))] = np.arange(1, len(found) + 1)
        np.maximum.at(best, a, rank)
        np.maximum.at(best, b, rank)
        kept = (best[a] == rank) & (best[b] == rank)
        best[a] = best[b] = 0
        chosen, a, b = found[kept], a[kept], b[kept]
        place = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        hit = np.flatnonzero(fits & (chosen[place] == key))
        levels.append(made)
        pairs.append(np.stack([a, b], 1))
        of[top : top + len(a)] = of[a]
        s[hit] = top + place[hit]
        made, top = made + len(chosen), top + len(chosen)
        stays = np.ones(len(s), bool)
        stays[hit + 1] = False
        active = np.zeros(int(g[-1]) + 1, bool)
        active[g[hit]] = True
        going = active[g]
        finished.append(s[stays & ~going])
        s, g = s[stays & going], g[stays & going]
    finished.append(s)
    return Grammars(of[:top], word, len(names), np.concatenate(pairs), np.concatenate(finished), levels)
