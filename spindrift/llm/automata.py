"""Weighted acyclic automata over sequences of words: counts of n-grams, in order, with shared endings.

A state's arcs lead by word to states; each state knows how many sequences end below it, so that a path also tells a sequence's
place among all, and its count stands at that place. States with the same arcs are one (they are registered when the sorted input
has passed them), so endings that many sequences share are held once.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa

Path = tuple[str, ...]


class Counts:
    """An immutable automaton. State 0 has no arcs; the root is the last state."""

    def __init__(self, words: list[str], arcs_at: np.ndarray, labels: np.ndarray, targets: np.ndarray, before: np.ndarray, final: np.ndarray, counts: np.ndarray):
        self.words, self.arcs_at, self.labels, self.targets, self.before, self.final, self.counts = words, arcs_at, labels, targets, before, final, counts
        self._lists: tuple | None = None

    @staticmethod
    def build(rows: Iterable[tuple[Path, int]]) -> Counts:
        """From paths in increasing order, each once. What the next path doesn't share is registered at once."""
        number: dict[str, int] = {}
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        final: list[bool] = []
        size: list[int] = []
        counts: list[int] = []
        last: Path = ()
        # The states along the last path: [ends here, arcs to registered states].
        open_: list[list] = [[False, []]]

        def registered(state: list) -> int:
            key = (state[0], tuple(state[1]))
            if (at := register.get(key)) is None:
                at = register[key] = len(arcs)
                arcs.append(key[1])
                final.append(key[0])
                size.append(key[0] + sum(size[t] for _, t in key[1]))
            return at

        registered([True, []])
        for path, n in rows:
            shared, least = 0, min(len(path), len(last))
            while shared < least and path[shared] == last[shared]:
                shared += 1
            for depth in range(len(last), shared, -1):
                done = registered(open_.pop())
                open_[-1][1].append((number[last[depth - 1]], done))
            for word in path[shared:]:
                number.setdefault(word, len(number))
                open_.append([False, []])
            open_[-1][0] = True
            counts.append(n)
            last = path
        for depth in range(len(last), 0, -1):
            done = registered(open_.pop())
            open_[-1][1].append((number[last[depth - 1]], done))
        arcs.append(tuple(open_[0][1]))
        final.append(open_[0][0])
        arcs_at = np.cumsum([0, *map(len, arcs)])
        flat = [x for own in arcs for x in own]
        labels, targets = (np.array([x[k] for x in flat], dtype=np.int32) for k in (0, 1))
        before = np.array([b for own, end in zip(arcs, final, strict=True) for b in _before(own, end, size)], dtype=np.int64)
        return Counts(list(number), arcs_at.astype(np.int64), labels, targets, before, np.array(final, dtype=bool), np.array(counts, dtype=np.int64))

    def __len__(self) -> int:
        return len(self.counts)

    def _open(self) -> tuple:
        if self._lists is None:
            self._lists = self.arcs_at.tolist(), [self.words[k] for k in self.labels.tolist()], self.targets.tolist(), self.before.tolist(), self.final.tolist(), self.counts.tolist()
        return self._lists

    def items(self) -> Iterator[tuple[Path, tuple[int, ...]]]:
        """Paths in order, each with the counts of all its beginnings and its own (0 where a beginning isn't a path)."""
        at, words, targets, before, final, counts = self._open()

        def below(state: int, path: Path, told: tuple[int, ...], place: int) -> Iterator[tuple[Path, tuple[int, ...]]]:
            for k in range(at[state], at[state + 1]):
                to, here = targets[k], place + before[k]
                longer, known = (*path, words[k]), (*told, counts[here] if final[to] else 0)
                if final[to]:
                    yield longer, known
                if at[to] < at[to + 1]:
                    yield from below(to, longer, known, here)

        return below(len(at) - 2, (), (), 0)

    def get(self, path: Path) -> int:
        """The path's count, or 0."""
        at, words, targets, before, final, counts = self._open()
        state, place = len(at) - 2, 0
        for word in path:
            # Arcs stand in the order of their words.
            low, high = at[state], at[state + 1]
            while low < high:
                middle = (low + high) // 2
                if words[middle] < word:
                    low = middle + 1
                else:
                    high = middle
            if low == at[state + 1] or words[low] != word:
                return 0
            place += before[low]
            state = targets[low]
        return counts[place] if final[state] else 0

    def dumps(self) -> bytes:
        raw = pickle.dumps((self.words, self.arcs_at, self.labels, self.targets, self.before, self.final, self.counts), protocol=5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def loads(raw: bytes) -> Counts:
        return Counts(*pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)))


def _before(arcs: tuple[tuple[int, int], ...], ends: bool, size: list[int]) -> Iterator[int]:
    """For each arc of a state, how many of its sequences come before those of the arc."""
    n = int(ends)
    for _, to in arcs:
        yield n
        n += size[to]


def union(parts: list[Counts], least: int = 0) -> Counts:
    """All paths with the sums of their counts, without those below `least`."""
    merged = heapq.merge(*(((path, told[-1]) for path, told in x.items()) for x in parts), key=itemgetter(0))
    sums = ((path, sum(n for _, n in own)) for path, own in groupby(merged, key=itemgetter(0)))
    return Counts.build(x for x in sums if x[1] >= least)
