"""A hierarchical navigable small-world graph in numpy, kept as flat neighbour arrays.

Layer 0 holds up to 2M neighbours of every vector in one (n, 2M) array, each higher layer up to M of the vectors it has.
Nearness is the inner product. Vectors get one more coordinate, sqrt(R^2 - |x|^2) with R the largest norm, under which
order by inner product with a query is order by distance, so that links can be chosen by the usual diversity rule.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Links of a vector and layer (twice as many on layer 0), and candidates kept while building and while searching.
M, BUILD, SEARCH = 16, 80, 192


class Graph:
    def __init__(self, vectors: np.ndarray, m: int = M):
        self.vectors, self.m = vectors, m
        self.entry, self.layers = 0, []  # of each layer: row of each vector (or -1), and links by row (-1: none)

    # -- searching

    def _step(self, q: np.ndarray, at: int, layer: int) -> int:
        """The vector at which a greedy walk on a layer ends."""
        row, links = self.layers[layer]
        best = float(self.vectors[at] @ q)
        while True:
            near = links[row[at]]
            near = near[near >= 0]
            if not len(near):
                return at
            s = self.vectors[near] @ q
            k = int(s.argmax())
            if s[k] <= best:
                return at
            at, best = int(near[k]), float(s[k])

    def _beam(self, q: np.ndarray, at: int, layer: int, width: int, seen: np.ndarray, stamp: int) -> list[tuple[float, int]]:
        """Up to `width` near vectors of a layer as (score, vector), in no order."""
        row, links = self.layers[layer]
        s = float(self.vectors[at] @ q)
        seen[at] = stamp
        todo, kept = [(-s, at)], [(s, at)]
        while todo:
            s, v = heapq.heappop(todo)
            if len(kept) >= width and -s < kept[0][0]:
                break
            near = links[row[v]]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            score = self.vectors[near] @ q
            if len(kept) >= width:
                ok = score > kept[0][0]
                near, score = near[ok], score[ok]
            for x, w in zip(score.tolist(), near.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (x, w))
                elif x > kept[0][0]:
                    heapq.heapreplace(kept, (x, w))
                else:
                    continue
                heapq.heappush(todo, (-x, w))
        return kept

    def search(self, q: np.ndarray, width: int, seen: np.ndarray, stamp: int) -> np.ndarray:
        """About the `width` vectors of largest inner product with `q`, in no order."""
        at = self.entry
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._step(q, at, layer)
        return np.array([v for _, v in self._beam(q, at, 0, width, seen, stamp)])

    # -- building

    def _choose(self, candidates: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Candidates, nearest first, that are nearer to the vector than to any chosen before them; then the nearest others."""
        order = np.argsort(-score, kind="stable")
        candidates, score = candidates[order], score[order]
        if len(candidates) <= most:
            return candidates
        x = self.vectors[candidates]
        between = x @ x.T
        chosen: list[int] = []
        rest: list[int] = []
        closest = np.full(len(candidates), -np.inf)
        for i in range(len(candidates)):
            if closest[i] < score[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(closest, between[i], out=closest)
            else:
                rest.append(i)
        return candidates[np.array((chosen + rest)[:most])]

    def _link(self, layer: int, v: int, near: np.ndarray) -> None:
        row, links = self.layers[layer]
        most = links.shape[1]
        links[row[v], : len(near)] = near
        for w in near.tolist():
            own = links[row[w]]
            free = int((own >= 0).sum())
            if free < most:
                own[free] = v
            else:
                x = np.append(own, v)
                kept = self._choose(x, self.vectors[x] @ self.vectors[w], most)
                own[:] = -1
                own[: len(kept)] = kept

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = M, width: int = BUILD, seed: int = 5) -> Graph:
        """Insert all vectors one after another; levels are drawn with a fixed seed."""
        n = len(vectors)
        norm = (vectors.astype(np.float64) ** 2).sum(axis=1)
        own = np.concatenate([vectors, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None].astype(vectors.dtype)], axis=1)
        # nearness between vectors of the lifted space is minus half the squared distance; all have norm R there
        g = cls(own, m)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 12)
        for k in range(int(level.max()) + 1):
            has = np.flatnonzero(level >= k)
            row = np.full(n, -1, np.int32)
            row[has] = np.arange(len(has))
            g.layers.append((row, np.full((len(has), m if k else 2 * m), -1, np.int32)))
        seen, top = np.zeros(n, np.int32), int(level[0])
        stamp = 0
        for v in range(1, n):
            q = own[v]
            at = g.entry
            for layer in range(top, -1, -1):
                if layer > level[v]:
                    at = g._step(q, at, layer)
                    continue
                stamp += 1
                kept = g._beam(q, at, layer, width, seen, stamp)
                s, w = (np.array(x) for x in zip(*kept, strict=True))
                at = int(w[s.argmax()])
                g._link(layer, v, g._choose(w, s, m))
            if level[v] > top:
                g.entry, top = v, int(level[v])
        g.vectors = vectors
        return g

    # -- storing

    def arrays(self) -> dict[str, bytes]:
        """The flat arrays, for storing; `restore` is the inverse."""
        rows = np.concatenate([r for r, _ in self.layers]).astype("<i4").tobytes()
        links = np.concatenate([x.ravel() for _, x in self.layers]).astype("<i4").tobytes()
        return {"vectors": self.vectors.astype("<f4").tobytes(), "rows": rows, "links": links, "shape": np.array([len(self.vectors), self.vectors.shape[1], self.m, self.entry, len(self.layers)], "<i8").tobytes()}

    @classmethod
    def restore(cls, a: dict[str, bytes]) -> Graph:
        n, width, m, entry, layers = np.frombuffer(a["shape"], "<i8").tolist()
        g = cls(np.frombuffer(a["vectors"], "<f4").reshape(n, width), m)
        g.entry = entry
        rows, links = np.frombuffer(a["rows"], "<i4").reshape(layers, n), np.frombuffer(a["links"], "<i4")
        at = 0
        for k in range(layers):
            size = int((rows[k] >= 0).sum()) * (m if k else 2 * m)
            g.layers.append((rows[k], links[at : at + size].reshape(-1, m if k else 2 * m)))
            at += size
        return g
