"""A robust-pruned directed graph over unit vectors, for one shard, in NumPy (problem 3).

Points enter in random batches. A greedy beam search over the graph so far proposes each point's
neighbours; relaxed distance pruning keeps a proposal only if no kept one is nearer to it than the
point by the factor ``alpha``, so edges point in diverse directions; kept edges are also entered
backwards, and full lists pruned by the same rule. A second round searches again for all points over
the whole graph and prunes with the found and the present neighbours, and with the nearest of the points around.

All queries of a batch walk at once: each step expands one node of every beam with array operations.
A beam entry is one integer (similarity, node, expanded bit), so keeping the best is a partition.
"""

from __future__ import annotations

import numpy as np

_SCALE = 1 << 29
_NODE = (1 << 31) - 1
#: Entry points at which a search starts.
STARTS = 3
#: Points that are compared with each other, and how many of them each proposes.
WINDOW, BESIDE = 512, 4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length, float32."""
    v = vectors.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _keys(similarity: np.ndarray, node: np.ndarray, expanded: int = 0) -> np.ndarray:
    quantised = np.clip((similarity + 1.0) * _SCALE, 0, 3 * _SCALE).astype(np.int64)
    return quantised << 32 | node.astype(np.int64) << 1 | expanded


class Graph:
    """``neighbours[i]``: up to ``degree`` nodes, -1 where there are fewer."""

    def __init__(self, points: np.ndarray, degree: int = 12, beam: int = 12, alpha: float = 1.2, rounds: int = 2, seed: int = 7):
        n = len(points)
        self.points, self.degree, self.beam, self.alpha2 = np.ascontiguousarray(points, np.float32), degree, beam, alpha * alpha
        self.neighbours = np.full((n, degree), -1, np.int32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        # Searches start at the best of some random points, as directions fall into groups with no way between.
        self.entries = order[: max(4 * degree, int(2 * np.sqrt(n)))]
        done = first = min(n, 4 * degree)
        if first:
            head = order[:first]
            self._link(head, np.broadcast_to(head, (first, first)).copy())
        while done < n:
            batch = order[done : done + max(first, done // 2)]
            self._link(batch, self._walk(self.points[batch], beam, entries=self.entries[:done])[0])
            done += len(batch)
        beside = self._beside() if n > 1 else None
        for _ in range(rounds - 1 if n > 1 else 0):
            for at in range(0, n, 4096):
                batch = np.arange(at, min(n, at + 4096))
                found = self._walk(self.points[batch], beam, batch)[0]
                self._link(batch, np.concatenate([found, self.neighbours[batch], beside[batch]], axis=1))

    def _beside(self) -> np.ndarray:
        """The nearest few of each point among those that have its nearest entry or stand close in that order.

        Points that are near each other and far from all others may have no edge that leads to them, so no search finds them.
        """
        n = len(self.points)
        own = np.concatenate([(self.points[a : a + 4096] @ self.points[self.entries].T).argmax(1) for a in range(0, n, 4096)])
        order = np.argsort(own, kind="stable")
        out = np.full((n, BESIDE), -1, np.int64)
        for a in range(0, n, WINDOW):
            # The last window reaches back, so that it is a whole one.
            here = order[max(0, min(a, n - WINDOW)) : a + WINDOW]
            close = self.points[here] @ self.points[here].T
            np.fill_diagonal(close, -9)
            few = min(BESIDE, len(here) - 1)
            out[here, :few] = here[np.argpartition(-close, few - 1, axis=1)[:, :few]]
        return out

    # -- search

    def _walk(self, queries: np.ndarray, beam: int, starts: np.ndarray | None = None, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of each query's beam, best first; -1 where it isn't full."""
        many, points, neighbours = len(queries), self.points, self.neighbours
        keys = np.full((many, beam), -1, np.int64)
        if starts is None:
            entries = self.entries if entries is None else entries
            close = _keys(queries @ points[entries].T, entries[None, :])
            few = min(STARTS, beam, len(entries))
            keys[:, :few] = np.partition(close, len(entries) - few, axis=1)[:, len(entries) - few :]
        else:
            keys[:, 0] = _keys(np.einsum("bd,bd->b", points[starts], queries), starts)
        out = np.empty((many, beam), np.int64)
        rows = np.arange(many)
        while len(rows):
            open_keys = np.where(keys & 1, -1, keys)
            place = open_keys.argmax(1)
            at = np.arange(len(rows))
            best = open_keys[at, place]
            alive = best >= 0
            if not alive.all():
                out[rows[~alive]] = keys[~alive]
                rows, keys, place, best, queries = rows[alive], keys[alive], place[alive], best[alive], queries[alive]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            keys[at, place] |= 1
            near = neighbours[(best >> 1) & _NODE]
            similarity = np.matmul(points[near], queries[:, :, None])[:, :, 0]
            fresh = _keys(similarity, near)
            held = ((keys >> 1) & _NODE).astype(np.int32)
            held[keys < 0] = -2
            stale = (near[:, :, None] == held[:, None, :]).any(2) | (near < 0)
            fresh[stale] = -1
            keys = np.partition(np.concatenate([keys, fresh], axis=1), self.degree, axis=1)[:, self.degree :]
        out = -np.sort(-out, axis=1)
        node = np.where(out < 0, -1, (out >> 1) & _NODE)
        return node, np.where(out < 0, -2.0, (out >> 32) / _SCALE - 1.0)

    def search(self, queries: np.ndarray, k: int, beam: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nodes most similar to each query that a beam search finds, with their similarities."""
        width = max(beam, k)
        parts = [self._walk(queries[a : a + 4096], width, None if starts is None else starts[a : a + 4096]) for a in range(0, len(queries), 4096)]
        if not parts or not len(self.points):
            return np.full((len(queries), k), -1), np.full((len(queries), k), -2.0)
        return np.concatenate([p[0][:, :k] for p in parts]), np.concatenate([p[1][:, :k] for p in parts])

    # -- construction

    def _prune(self, nodes: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """At most ``degree`` diverse neighbours of each node out of those proposed (-1: none)."""
        proposed = np.sort(proposed, axis=1)
        bad = (proposed < 0) | (proposed == nodes[:, None])
        bad[:, 1:] |= proposed[:, 1:] == proposed[:, :-1]
        vectors = self.points[proposed]
        similarity = np.matmul(vectors, self.points[nodes][:, :, None])[:, :, 0]
        similarity[bad] = -3
        order = np.argsort(-similarity, axis=1)
        similarity = np.take_along_axis(similarity, order, 1)
        proposed = np.take_along_axis(proposed, order, 1)
        between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        away = 2 - 2 * similarity
        alive = similarity > -3
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        at = np.arange(len(nodes))
        for r in range(self.degree):
            pick = alive.argmax(1)
            some = alive[at, pick]
            if not some.any():
                break
            kept[:, r] = np.where(some, proposed[at, pick], -1)
            from_pick = np.take_along_axis(between[at, order[at, pick]], order, 1)
            alive &= self.alpha2 * from_pick > away
            alive[at, pick] = False
        return kept

    def _link(self, nodes: np.ndarray, proposed: np.ndarray) -> None:
        kept = self._prune(nodes, proposed)
        self.neighbours[nodes] = kept
        source, target = np.repeat(nodes, self.degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        # Edges back, grouped by their target; the nearest come first where a target gets very many.
        near = np.einsum("bd,bd->b", self.points[source], self.points[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        targets, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        wide = min(int(count.max(initial=0)), 2 * self.degree)
        use = rank < wide
        back = np.full((len(targets), wide), -1, np.int64)
        back[np.repeat(np.arange(len(targets)), count)[use], rank[use]] = source[use]
        present = self.neighbours[targets]
        known = (back[:, :, None] == present[:, None, :]).any(2)
        back[known] = -1
        free = (present < 0).sum(1)
        new = (back >= 0).sum(1)
        fits = new <= free
        if fits.any():
            joined = np.concatenate([present[fits], back[fits]], axis=1)
            joined = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), 1)
            self.neighbours[targets[fits]] = joined[:, : self.degree]
        full = np.flatnonzero(~fits)
        for a in range(0, len(full), 4096):
            part = full[a : a + 4096]
            self.neighbours[targets[part]] = self._prune(targets[part], np.concatenate([present[part], back[part]], axis=1))
