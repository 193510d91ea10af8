"""A hierarchical navigable small-world graph over unit vectors, in flat arrays, built and searched in lock-step.

Many vectors walk the graph at once, so that each step is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np

#: Numbers an array of one step may hold, which sets how many vectors walk at once.
STEP_NUMBERS = 16_000_000
#: Rows of a beam that are followed in one step.
WAYS = 4


class Graph:
    """vectors: unit rows; links[0]: for each row 2m places, -1 where empty; links[l]: m places for the rows of level l and above."""

    def __init__(self, vectors: np.ndarray, m: int = 12, ef: int = 32, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.m, self.ef = m, ef
        n = len(self.vectors)
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int64), 12)
        top = int(self.levels.max()) if n else 0
        self.links = [np.full((n, 2 * m), -1, np.int32)]
        self.slots = [np.arange(n)]
        for level in range(1, top + 1):
            members = np.flatnonzero(self.levels >= level)
            slot = np.full(n, -1, np.int64)
            slot[members] = np.arange(len(members))
            self.slots.append(slot)
            self.links.append(np.full((len(members), m), -1, np.int32))
        self.entry = int(np.argmax(self.levels)) if n else -1
        if n:
            self._build()

    def _build(self) -> None:
        # high levels first, so that the walk from the entry always finds the upper layers in place
        order = np.argsort(-self.levels, kind="stable")
        done, size = 1, 4
        while done < len(order):
            batch = order[done : done + size]
            self._insert(batch, order[:done])
            done += len(batch)
            size = min(2048, max(4, done // 4))

    def _insert(self, batch: np.ndarray, present: np.ndarray) -> None:
        near = self._descend(self.vectors[batch], int(self.levels[batch].max()))
        for level in range(int(self.levels[batch].max()), -1, -1):
            chosen = self.levels[batch] >= level
            rows = batch[chosen]
            if not len(rows):
                continue
            ids, sims = self._beam(self.vectors[rows], near[chosen][:, None], level, self.ef)
            near[chosen] = np.where(ids[:, 0] >= 0, ids[:, 0], near[chosen])
            own_ids, own_sims = _among(self.vectors[rows], min(self.m, len(rows) - 1))
            ids = np.concatenate([ids, np.where(own_ids >= 0, rows[own_ids], -1)], 1)
            sims = np.concatenate([sims, own_sims], 1)
            self._connect(rows, ids, sims, level)

    def _connect(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        links, slot = self.links[level], self.slots[level]
        kept = self._diverse(ids, sims, self.m)
        wide = np.full((len(rows), links.shape[1]), -1, np.int32)
        wide[:, : kept.shape[1]] = kept
        links[slot[rows]] = wide
        source, target = np.repeat(rows, kept.shape[1]), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        targets, begins, times = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begins, times)
        # all new links of a target compete with its old ones, in as many rounds as its links need
        for first in range(0, int(times.max()), self.m):
            inside = (place >= first) & (place < first + self.m)
            hit = np.flatnonzero(times > first)
            extra = np.full((len(targets), self.m), -1, np.int64)
            extra[np.repeat(np.arange(len(targets)), times)[inside], place[inside] - first] = source[inside]
            for at in range(0, len(hit), 2048):
                part = hit[at : at + 2048]
                own = slot[targets[part]]
                both = np.concatenate([links[own].astype(np.int64), extra[part]], 1)
                both = _first_only(both)
                full = (both >= 0).sum(1) > links.shape[1]
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
                if full.any():
                    pool = both[full]
                    score = np.einsum("ijk,ik->ij", self.vectors[np.maximum(pool, 0)], self.vectors[targets[part][full]])
                    score[pool < 0] = -np.inf
                    best = self._diverse(pool, score, links.shape[1])
                    packed[full] = -1
                    packed[np.flatnonzero(full)[:, None], np.arange(best.shape[1])[None]] = best
                links[own] = packed

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, those nearer to the row than to any kept one; then the best of the others."""
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        out = np.full((len(ids), min(most, ids.shape[1])), -1, np.int32)
        step = max(1, STEP_NUMBERS // 4 // max(1, ids.shape[1] * (ids.shape[1] + self.vectors.shape[1])))
        for at in range(0, len(ids), step):
            i, s = ids[at : at + step], sims[at : at + step]
            v = self.vectors[np.maximum(i, 0)]
            between = v @ v.transpose(0, 2, 1)
            real = (i >= 0) & np.isfinite(s)
            kept = np.zeros(i.shape, bool)
            nearest = np.full(i.shape, -np.inf, np.float32)
            count = np.zeros(len(i), np.int64)
            for c in range(i.shape[1]):
                take = real[:, c] & (count < most) & (s[:, c] > nearest[:, c])
                kept[:, c] = take
                count += take
                np.maximum(nearest, np.where(take[:, None], between[:, c], -np.inf), out=nearest)
            rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, : out.shape[1]]
            picked = np.take_along_axis(i, rank, 1)
            picked[~np.take_along_axis(real, rank, 1)] = -1
            out[at : at + step] = picked
        return out

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Nearest row found for each query on the levels above `to`, one step at a time."""
        at = np.full(len(queries), self.entry, np.int64)
        sim = queries @ self.vectors[self.entry]
        for level in range(len(self.links) - 1, to, -1):
            active = np.arange(len(queries))
            while len(active):
                near = self.links[level][self.slots[level][at[active]]].astype(np.int64)
                score = np.einsum("ijk,ik->ij", self.vectors[np.maximum(near, 0)], queries[active])
                score[near < 0] = -np.inf
                best = score.argmax(1)
                top = score[np.arange(len(active)), best]
                better = top > sim[active]
                sim[active[better]] = top[better]
                at[active[better]] = near[better, best[better]]
                active = active[better]
        return at

    def _beam(self, queries: np.ndarray, starts: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best rows found for each query on one level, best first; -1 where fewer are found.

        Each step follows the WAYS best rows of a beam that were not followed yet. Marks of visited rows are taken away
        again one by one, so that a walk costs what it visits, whatever the size of the graph.
        """
        n, b = len(self.vectors), len(queries)
        links, slot = self.links[level], self.slots[level]
        wide = links.shape[1]
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -np.inf, np.float32)
        step = min(max(8, min(1024, STEP_NUMBERS * 4 // max(1, n), STEP_NUMBERS // (WAYS * wide * self.vectors.shape[1]))), max(1, b))
        seen = np.zeros(step * (n + 1), bool)
        for at in range(0, b, step):
            q = queries[at : at + step]
            rows = np.arange(len(q))
            i, s = ids[at : at + step], sims[at : at + step]
            i[:, 0] = starts[at : at + step, 0]
            s[:, 0] = np.einsum("ik,ik->i", self.vectors[i[:, 0]], q)
            marks = [rows * (n + 1) + i[:, 0]]
            seen[marks[0]] = True
            fresh = np.zeros(i.shape, bool)
            fresh[:, 0] = True
            active = rows
            while len(active):
                open_ = fresh[active]
                # the beam is in order, so the first fresh ones are the best
                first = np.argsort(~open_, axis=1, kind="stable")[:, :WAYS]
                real = np.take_along_axis(open_, first, 1)
                fresh[active[:, None], first] = False
                near = links[slot[np.where(real, i[active[:, None], first], i[active, 0][:, None])]]
                near = np.where(real[:, :, None], near, -1).reshape(len(active), -1)
                place = active[:, None] * (n + 1) + np.where(near < 0, n, near)
                skip = seen[place] | (near < 0)
                seen[place] = True
                marks.append(place[~skip])
                # rows that two of the followed ones link count once: the later ones are told by their order
                if WAYS > 1:
                    skip |= _repeats(near)
                count = (~skip).sum(1)
                most = int(count.max(initial=0))
                if most:
                    packed = np.argsort(skip, axis=1, kind="stable")[:, :most]
                    near = np.take_along_axis(near, packed, 1)
                    lost = np.arange(most)[None] >= count[:, None]
                    score = np.matmul(self.vectors[np.maximum(near, 0)], q[active][:, :, None])[:, :, 0]
                    score[lost] = -np.inf
                    worth = np.flatnonzero((score > s[active, -1:]).any(1))
                    if len(worth):
                        rows_in = active[worth]
                        all_s = np.concatenate([s[rows_in], score[worth]], 1)
                        all_i = np.concatenate([i[rows_in], near[worth]], 1)
                        all_f = np.concatenate([fresh[rows_in], ~lost[worth]], 1)
                        by = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
                        part = np.take_along_axis(all_s, by, 1)
                        by = np.take_along_axis(by, np.argsort(-part, axis=1), 1)
                        s[rows_in] = np.take_along_axis(all_s, by, 1)
                        i[rows_in] = np.take_along_axis(all_i, by, 1)
                        fresh[rows_in] = np.take_along_axis(all_f, by, 1) & (s[rows_in] > -np.inf)
                active = active[fresh[active].any(1)]
            i[s == -np.inf] = -1
            for m in marks:
                seen[m] = False
        return ids.astype(np.int64), sims

    def search(self, queries: np.ndarray, k: int, ef: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and similarities of the k best found for each query, best first, -1 where fewer."""
        if not len(self.vectors) or not len(queries):
            return np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
        queries = np.ascontiguousarray(queries, np.float32)
        near = self._descend(queries, 0)
        ids, sims = self._beam(queries, near[:, None], 0, max(ef, k))
        return ids[:, :k], sims[:, :k]

    def pack(self) -> dict[str, bytes]:
        """The arrays as bytes: what a table row holds of a graph."""
        upper = [np.flatnonzero(self.levels >= level).astype(np.int32) for level in range(1, len(self.links))]
        return {
            "vectors": self.vectors.tobytes(),
            "levels": self.levels.astype(np.int8).tobytes(),
            "links": b"".join(x.tobytes() for x in self.links),
            "shape": np.array([*self.vectors.shape, self.m, self.ef, self.entry, *map(len, upper)], np.int64).tobytes(),
        }

    @classmethod
    def unpack(cls, vectors: bytes, levels: bytes, links: bytes, shape: bytes) -> Graph:
        numbers = np.frombuffer(shape, np.int64)
        n, dim, m, ef, entry = map(int, numbers[:5])
        self = cls.__new__(cls)
        self.vectors, self.m, self.ef, self.entry = np.frombuffer(vectors, np.float32).reshape(n, dim), m, ef, entry
        self.levels = np.frombuffer(levels, np.int8).astype(np.int64)
        flat, at, self.links, self.slots = np.frombuffer(links, np.int32), 0, [], []
        for level, rows in enumerate([n, *map(int, numbers[5:])]):
            width = m if level else 2 * m
            self.links.append(flat[at : at + rows * width].reshape(rows, width))
            at += rows * width
            slot = np.full(n, -1, np.int64)
            slot[np.flatnonzero(self.levels >= level)] = np.arange(rows)
            self.slots.append(slot)
        return self


def _among(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of each row among the rows."""
    if k < 1:
        return np.full((len(vectors), 0), -1, np.int64), np.zeros((len(vectors), 0), np.float32)
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -np.inf)
    ids = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return ids, np.take_along_axis(sims, ids, 1)


def _repeats(ids: np.ndarray) -> np.ndarray:
    """Where a row repeats an id that stands in it before."""
    by = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(ids, by, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    out = np.empty_like(again)
    np.put_along_axis(out, by, again, 1)
    return out


def _first_only(ids: np.ndarray) -> np.ndarray:
    """ids with repeats within a row turned to -1."""
    by = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(ids, by, 1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    out = np.empty_like(ids)
    np.put_along_axis(out, by, ordered, 1)
    return out
