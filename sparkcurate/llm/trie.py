"""Double-array tries whose edges many states follow at once."""

from __future__ import annotations

import numpy as np

#: Nodes with more children than this are placed one by one, the others many at a time.
_LARGE = 16
_TRIES = 40


#: Labels beyond this are read in two digits, the lower one of so many bits.
_WIDE, _BITS = 1 << 15, 9


class DoubleArray:
    """Edges (node, label) of a trie; edge number ``i`` leads to whatever the caller numbers ``i``.

    Labels of a wide range are two steps of one digit each: nodes with thousands of widely spread children
    would not fit between each other, but those of a digit have few hundred at most. Nodes and labels are
    small whole numbers.
    """

    def __init__(self, nodes: np.ndarray, labels: np.ndarray):
        nodes, labels = np.asarray(nodes, np.int64), np.asarray(labels, np.int64)
        self.high: _Table | None = None
        if labels.max(initial=0) >= _WIDE:
            upper, nodes = np.unique(nodes << 32 | labels >> _BITS, return_inverse=True)
            self.high, labels = _Table(upper >> 32, upper & 0xFFFFFFFF), labels & ((1 << _BITS) - 1)
        self.low = _Table(nodes, labels)

    def step(self, nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The edge of every (node, label); -1 where there is none. Unknown nodes and labels have none."""
        if self.high is None:
            return self.low.step(nodes, labels)
        found = np.full(len(nodes), -1, np.int64)
        middle = self.high.step(nodes, labels >> _BITS)
        on = np.flatnonzero(middle >= 0)
        found[on] = self.low.step(middle[on], labels[on] & ((1 << _BITS) - 1))
        return found


class _Table:
    """The edges of a node lie at ``base[node] + label``, and ``owner`` tells whose a place is, so a step is
    an addition and a comparison. Bases are drawn, large nodes first, and nodes whose places are taken
    draw again; the table grows when that happens too often.
    """

    def __init__(self, nodes: np.ndarray, labels: np.ndarray):
        order = np.argsort(nodes, kind="stable")
        self._nodes, self._labels, self._order = nodes[order], labels[order], order
        parents, self._first, self._size = np.unique(self._nodes, return_index=True, return_counts=True)
        self._parents, self._rng = parents, np.random.default_rng(0)
        reach = int(labels.max(initial=0)) + 1
        self.base = np.full(int(nodes.max(initial=0)) + 1, -1, np.int32)
        self.owner = np.full(2 * len(nodes) + 16 + reach, -1, np.int32)
        self.edge = np.zeros(len(self.owner), np.int32)
        self._room, self._reach = len(self.owner) - reach, reach
        by_size = np.argsort(-self._size, kind="stable")
        large = by_size[self._size[by_size] > _LARGE]
        for k in large:
            self._place(np.array([k]))
        rest = by_size[len(large) :]
        while len(rest):
            # Nodes of like size together.
            like = int((self._size[rest] > self._size[rest[0]] // 2).sum())
            self._place(rest[:like])
            rest = rest[like:]
        del self._nodes, self._labels, self._order, self._parents, self._first, self._size, self._rng

    def _place(self, waiting: np.ndarray) -> None:
        tries = 0
        while len(waiting):
            if tries == _TRIES:
                self._grow(int(self._size[waiting].sum()))
                tries = 0
            tries += 1
            base, size = self._rng.integers(0, self._room, len(waiting)), self._size[waiting]
            which = np.repeat(np.arange(len(waiting)), size)
            ends = np.cumsum(size)
            edges = np.arange(len(which)) + np.repeat(self._first[waiting] - ends + size, size)
            at, node = base[which] + self._labels[edges], self._nodes[edges].astype(np.int32)
            free = self.owner[at] < 0
            self.owner[at[free]] = node[free]  # of several claims to a place the last one holds
            lost = np.bincount(which, (self.owner[at] != node) | ~free, len(waiting)) > 0
            mine, gone = ~lost[which], lost[which] & free & (self.owner[at] == node)
            self.owner[at[gone]] = -1
            self.edge[at[mine]] = self._order[edges[mine]]
            self.base[self._parents[waiting[~lost]]] = base[~lost]
            waiting = waiting[lost]

    def _grow(self, needed: int) -> None:
        more = max(len(self.owner) // 2, 4 * needed)
        self.owner = np.concatenate([self.owner, np.full(more, -1, np.int32)])
        self.edge = np.concatenate([self.edge, np.zeros(more, np.int32)])
        self._room += more

    def step(self, nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        inside = (nodes >= 0) & (nodes < len(self.base)) & (labels >= 0) & (labels < self._reach)
        base = self.base[np.where(inside, nodes, 0)]
        at = np.where(inside & (base >= 0), base + labels, 0)
        found = self.edge[at]
        return np.where(inside & (base >= 0) & (self.owner[at] == nodes), found, -1)
