"""Greedy packing into token budgets.

Each greedy depends on every earlier choice, so it is serial within its group;
groups (a batch run, a language) are packed in parallel by ``applyInPandas``,
over ids and sizes alone, never texts.  A group is one run's prompts, whose
number the run's budget bounds.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


class FirstFree:
    """Finds the first bin with room, by a tree of the most room left."""

    def __init__(self):
        self.size, self.tree, self.count = 1, [-1, -1], 0

    def place(self, need: int, most: int) -> int:
        """The first bin with ``need`` room, or a new one; an item above ``most`` gets its own."""
        node = 1
        if self.tree[1] >= need:
            while node < self.size:
                node = 2 * node if self.tree[2 * node] >= need else 2 * node + 1
            return self._set(node - self.size, self.tree[node] - need)
        if self.count == self.size:
            leaves = self.tree[self.size :] + [-1] * self.size
            self.size *= 2
            self.tree = [-1] * self.size + leaves
            for k in range(self.size - 1, 0, -1):
                self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])
        self.count += 1
        return self._set(self.count - 1, most - need)

    def _set(self, at: int, room: int) -> int:
        node = at + self.size
        self.tree[node] = room
        while node > 1:
            node //= 2
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])
        return at


def first_fit_decreasing(sizes: list[int], most: int) -> list[int]:
    """Bin of each item; sizes come largest first."""
    free = FirstFree()
    return [free.place(s, most) for s in sizes]


def next_fit(sizes: list[int], most: int, base: int = 0) -> list[int]:
    """Bins are filled in order; each costs ``base`` before its first item."""
    out, now, used, filled = [], 0, base, False
    for s in sizes:
        if filled and used + s > most:
            now, used = now + 1, base
        out.append(now)
        used, filled = used + s, True
    return out


def least_loaded(sizes: list[int], bins: int) -> list[int]:
    """Each item goes to the least loaded of ``bins``, the first on a tie."""
    heap = [(0, k) for k in range(bins)]
    out = []
    for s in sizes:
        load, k = heap[0]
        heapq.heapreplace(heap, (load + s, k))
        out.append(k)
    return out


def pack(df: DataFrame, group: str, ident: str, size: str, how: str, budget: int, base: int = 0) -> DataFrame:
    """(group, ident, size, bin) by ``ffd``, ``next_fit`` or ``lpt`` (``budget``: tokens, or bins).

    ``next_fit`` takes items by ident, the others by size, largest first, then ident.
    """
    small = df.select(group, ident, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ident] if how == "next_fit" else [size, ident], ascending=[True] if how == "next_fit" else [False, True])
        sizes = pdf[size].tolist()
        found = first_fit_decreasing(sizes, budget) if how == "ffd" else next_fit(sizes, budget, base) if how == "next_fit" else least_loaded(sizes, budget)
        return pdf.assign(bin=found)

    kinds = dict(small.dtypes)
    return small.groupBy(group).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in small.columns) + ", bin long")
