"""A prefix tree over ordered sets, and the components of the similarity graph of one block."""

from __future__ import annotations

import numpy as np

class SetTrie:
    """Sets of items as a radix tree, traversed level by level for one probe set at a time.

    Items are in the global order, by falling frequency, ties by value, so that similar
    sets share long paths; the overlap of a path with the probe is computed once for
    all sets below it.  ``n`` has the sets' full sizes: items that no other set has are not
    stored.  A subtree is left as soon as its sets are too short, too long, or can't
    reach the needed overlap with the items that remain.
    """

    def __init__(self, items: np.ndarray, times: np.ndarray, offs: np.ndarray, n: np.ndarray):
        values, at, code = np.unique(items, return_index=True, return_inverse=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -times[at].astype(np.int64)))] = np.arange(len(values))
        ranks = rank[code]
        paths = [np.sort(ranks[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        self.size = len(values)
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.stored = np.array([len(p) for p in self.paths])
        self.length = n[self.order]
        self._build()

    def _build(self) -> None:
        """Nodes in depth-first order from the common prefixes of neighbours in the sorted list."""
        nodes: list[list[int]] = [[-1, 0, 0, 0, 0, 0]]  # parent, from depth, to depth, set that spells it, first set, level
        stack = [0]
        self.leaf = np.zeros(len(self.paths), np.int64)
        for i, path in enumerate(self.paths):
            common = 0
            if i:
                other = self.paths[i - 1]
                m = min(len(path), len(other))
                differ = np.flatnonzero(path[:m] != other[:m])
                common = int(differ[0]) if len(differ) else m
                last = -1
                while nodes[stack[-1]][2] > common:
                    last = stack.pop()
                if nodes[stack[-1]][2] < common:  # split the edge that was left
                    upper = nodes[last]
                    nodes.append([upper[0], upper[1], common, upper[3], upper[4], 0])
                    upper[0], upper[1] = len(nodes) - 1, common
                    stack.append(len(nodes) - 1)
            if len(path) > common:
                nodes.append([stack[-1], common, len(path), i, i, 0])
                stack.append(len(nodes) - 1)
            self.leaf[i] = stack[-1]
        n = len(nodes)
        parent = np.array([x[0] for x in nodes])
        level = np.zeros(n, np.int64)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            children[parent[k]].append(k)
        self.levels: list[np.ndarray] = []
        now = [0]
        while now:
            self.levels.append(np.array(now))
            level[now] = len(self.levels) - 1
            now = [c for k in now for c in children[k]]
        self.parent, self.depth = parent, np.array([x[2] for x in nodes])
        self.low = np.full(n, len(self.paths))
        self.high = np.zeros(n, np.int64)
        self.shortest = np.full(n, np.iinfo(np.int64).max)
        self.longest = np.zeros(n, np.int64)
        self.deepest = np.zeros(n, np.int64)
        at = np.arange(len(self.paths))
        np.minimum.at(self.low, self.leaf, at)
        np.maximum.at(self.high, self.leaf, at + 1)
        np.minimum.at(self.shortest, self.leaf, self.length)
        np.maximum.at(self.longest, self.leaf, self.length)
        np.maximum.at(self.deepest, self.leaf, self.stored)
        for ks in reversed(self.levels[1:]):
            p = parent[ks]
            np.minimum.at(self.low, p, self.low[ks])
            np.maximum.at(self.high, p, self.high[ks])
            np.minimum.at(self.shortest, p, self.shortest[ks])
            np.maximum.at(self.longest, p, self.longest[ks])
            np.maximum.at(self.deepest, p, self.deepest[ks])
        edges = [self.paths[x[3]][x[1] : x[2]] for x in nodes]
        self.edge_len = np.array([len(x) for x in edges])
        self.edge_at = np.cumsum(self.edge_len) - self.edge_len
        self.edge_items = np.concatenate(edges)

    def linked(self, probe: int, alive: np.ndarray, num: int, den: int) -> np.ndarray:
        """The live sets whose intersection with set ``probe`` is at least num / den of the union."""
        mark = np.zeros(self.size, np.int64)
        mark[self.paths[probe]] = 1
        size, shared = int(self.length[probe]), int(self.stored[probe])
        waiting = np.append(0, np.cumsum(alive))
        overlap = np.zeros(len(self.parent), np.int64)
        active = np.zeros(len(self.parent), bool)
        active[0] = True
        for ks in self.levels[1:]:
            ks = ks[active[self.parent[ks]]]
            ks = ks[(waiting[self.high[ks]] > waiting[self.low[ks]]) & (self.longest[ks] * den >= num * size) & (self.shortest[ks] * num <= size * den)]
            if not len(ks):
                break
            n = self.edge_len[ks]
            begin = np.cumsum(n) - n
            hits = mark[self.edge_items[np.repeat(self.edge_at[ks] - begin, n) + np.arange(n.sum())]]
            overlap[ks] = overlap[self.parent[ks]] + np.add.reduceat(hits, begin)
            left = np.minimum(self.deepest[ks] - self.depth[ks], shared - overlap[ks])
            reach = overlap[ks] + left
            active[ks[reach * (num + den) >= num * (size + self.shortest[ks])]] = True
        sets = np.flatnonzero(alive & active[self.leaf])
        both = overlap[self.leaf[sets]]
        return sets[both * den >= num * (size + self.length[sets] - both)]


def block_components(items: np.ndarray, times: np.ndarray, offs: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set of a block the index of its component's representative; ``n``: the sets' full sizes."""
    count = len(offs) - 1
    root = np.arange(count)
    if count < 2:
        return root
    trie = SetTrie(items, times, offs, n)
    alive = np.ones(count, bool)
    for first in range(count):
        if not alive[first]:
            continue
        alive[first] = False
        queue = [first]
        while queue and alive.any():
            found = trie.linked(queue.pop(), alive, num, den)
            alive[found] = False
            root[[trie.order[k] for k in found]] = trie.order[first]
            queue.extend(found.tolist())
    return root
