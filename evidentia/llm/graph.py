"""A flat proximity graph with robust pruning: built by insertion, searched greedily from medoids, expanded within a range."""

from __future__ import annotations

import numpy as np

#: Neighbours a node, length of a search's list, nodes inserted or searched at a time, entry points.
DEGREE, BEAM, TOGETHER, MEDOIDS = 16, 32, 128, 16
#: Nodes in range whose neighbours are looked at at a time.
STEP = 1 << 13
#: A candidate is dropped if it is nearer, by this factor, to a neighbour that was chosen than to the node: in the two passes of a build.
ALPHAS = (1.0, 1.2)


def medoids(x: np.ndarray, k: int = MEDOIDS, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """The members nearest to the centres of k clusters."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-6, total / np.maximum(size, 1e-6), c)
    return np.unique((x @ c.T).argmax(0))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Each row's numbers once; -1 in place of repetitions."""
    order = np.argsort(rows, axis=1, kind="stable")
    s = np.take_along_axis(rows, order, 1)
    again = np.zeros(rows.shape, bool)
    np.put_along_axis(again, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
    return np.where(again, -1, rows)


class FlatGraph:
    """Unit vectors x and for each of them up to DEGREE neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM):
        self.x, self.degree, self.beam = x.astype(np.float32), degree, beam
        self.near = np.full((len(x), degree), -1, np.int32)
        self.entries = medoids(self.x)

    def build(self, seed: int = 3) -> FlatGraph:
        order = np.random.default_rng(seed).permutation(len(self.x))
        order = np.concatenate((self.entries, order[~np.isin(order, self.entries)]))
        first = min(len(order), TOGETHER)
        self._choose(order[:first], np.broadcast_to(order[:first], (first, first)), ALPHAS[0])
        for alpha in ALPHAS:
            a = first if alpha == ALPHAS[0] else 0
            while a < len(order):
                e = min(len(order), a + TOGETHER)
                found, _ = self.walk(self.x[order[a:e]])
                self._choose(order[a:e], np.concatenate((found, self.near[order[a:e]]), axis=1), alpha)
                a = e
        return self

    def walk(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy search from the medoids: nodes and similarities of each query's list, best first."""
        n = len(q)
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries.astype(np.int32), (n, len(self.entries)))
        sims = q @ self.x[self.entries].T
        width = max(self.beam, ids.shape[1])
        ids = np.concatenate((ids, np.full((n, width - ids.shape[1]), -1, np.int32)), axis=1)
        sims = np.concatenate((sims, np.full((n, width - sims.shape[1]), -9, np.float32)), axis=1)
        done = ids < 0
        go = np.arange(n)
        while len(go):
            at = np.where(done[go], -9, sims[go]).argmax(1)
            go = go[~done[go, at]] if (skip := done[go, at]).any() else go
            at = at[~skip]
            if not len(go):
                break
            done[go, at] = True
            new = self.near[ids[go, at]]
            fresh = (new >= 0) & ~seen[go[:, None], new]
            seen[np.repeat(go, fresh.sum(1)), new[fresh]] = True
            s = np.einsum("ard,ad->ar", self.x[new], q[go])
            s[~fresh] = -9
            every = np.concatenate((sims[go], s), axis=1)
            best = np.argsort(-every, axis=1)[:, :width]
            sims[go] = np.take_along_axis(every, best, 1)
            ids[go] = np.take_along_axis(np.concatenate((ids[go], np.where(fresh, new, -1)), axis=1), best, 1)
            done[go] = np.take_along_axis(np.concatenate((done[go], ~fresh), axis=1), best, 1)
        return ids, sims

    def within(self, nodes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(node, other) of others found at a similarity of at least that: the search's list, then the neighbours of all that is in range, until none is new.

        Neighbours count both ways here: in a group of copies the lists of all point to the few in its middle, and from those lead back.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.x)
        a, k = np.nonzero(self.near >= 0)
        b = self.near[a, k].astype(np.int64)
        key = np.unique(np.concatenate((a * n + b, b * n + a)))
        to, begin = (key % n).astype(np.int32), np.searchsorted(key, np.arange(n + 1) * n)
        for a in range(0, len(nodes), TOGETHER):
            own = nodes[a : a + TOGETHER]
            q = self.x[own]
            ids, sims = self.walk(q)
            i, k = np.nonzero((sims >= least) & (ids >= 0))
            j = ids[i, k]
            # A node is in its own range, so its own neighbours are looked at, whether or not the walk came to it.
            i, j = np.concatenate((np.arange(len(own)), i[j != own[i]])), np.concatenate((own, j[j != own[i]]))
            seen = np.zeros((len(own), n), bool)
            seen[i, j] = True
            while len(i):
                out.append((own[i], j))
                fresh = []
                for part in range(0, len(i), STEP):
                    at, many = begin[j[part : part + STEP]], np.diff(begin)[j[part : part + STEP]]
                    x = np.repeat(i[part : part + STEP], many)
                    y = to[np.arange(many.sum()) + np.repeat(at - np.cumsum(many) + many, many)]
                    ok = ~seen[x, y]
                    fresh.append(np.unique(x[ok].astype(np.int64) * n + y[ok]))
                    seen[x, y] = True
                key = np.concatenate(fresh)
                i, j = key // n, (key % n).astype(np.int32)
                close = np.concatenate([(q[i[b : b + 65536]] * self.x[j[b : b + 65536]]).sum(1) for b in range(0, len(i), 65536)] or [np.zeros(0)]) >= least
                i, j = i[close], j[close]
        x, y = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return x[x != y], y[x != y]

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> None:
        """Sets the nodes' neighbours and adds each node to its neighbours', pruned where those are too many."""
        self.near[nodes] = self._pruned(nodes, candidates, alpha)
        u, k = np.nonzero(self.near[nodes] >= 0)
        v, u = self.near[nodes][u, k], nodes[u]
        known = (self.near[v] == u[:, None]).any(1)
        u, v = u[~known], v[~known]
        order = np.argsort(v, kind="stable")
        to, begin, many = np.unique(v[order], return_index=True, return_counts=True)
        for a in range(0, len(to), TOGETHER * 2):
            part, most = slice(a, a + TOGETHER * 2), many[a : a + TOGETHER * 2].max()
            place = begin[part, None] + np.arange(most)
            more = np.where(np.arange(most) < many[part, None], u[order][np.minimum(place, len(u) - 1)], -1)
            self.near[to[part]] = self._pruned(to[part], np.concatenate((self.near[to[part]], more), axis=1), alpha)

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning: the nearest candidate first, without those that are nearer to it, by alpha, than to the node."""
        c = _distinct(np.where(candidates == nodes[:, None], -1, candidates))
        sims = np.where(c >= 0, np.einsum("bkd,bd->bk", self.x[c], self.x[nodes]), -9)
        keep = np.argsort(-sims, axis=1)[:, : self.beam + self.degree]
        c, sims = np.take_along_axis(c, keep, 1), np.take_along_axis(sims, keep, 1)
        out = np.full((len(nodes), self.degree), -1, np.int32)
        v = self.x[c]
        between = 2 - 2 * (v @ v.transpose(0, 2, 1))
        far = np.maximum(0, 2 - 2 * sims)
        alive, row = c >= 0, np.arange(len(nodes))
        for k in range(self.degree):
            at = np.where(alive, sims, -99).argmax(1)
            some = alive[row, at]
            if not some.any():
                break
            out[some, k] = c[row, at][some]
            alive[row, at] = False
            alive &= ~(some[:, None] & (alpha * alpha * np.maximum(0, between[row, at]) < far))
        return out
