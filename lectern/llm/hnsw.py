"""Hierarchical navigable small-world graphs in numpy: nodes are inserted and queries searched many at a time."""

from __future__ import annotations

import io

import numpy as np

NONE = -1


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


class Hnsw:
    """Cosine graph over unit float32 rows. ``nearest`` holds, level by level, neighbours by number (NONE: free)."""

    M, EF_BUILD, BATCH, EXPAND = 16, 48, 256, 4

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(self.M)).astype(np.int64), 8)
        self.order = np.arange(n)
        if n:  # the entry point is on the highest level and is inserted first
            self.entry = int(np.argmax(self.level))
            self.order[[0, self.entry]] = self.order[[self.entry, 0]]
        self.nearest = [np.full((n, 2 * self.M if k == 0 else self.M), NONE, np.int32) for k in range(int(self.level.max()) + 1 if n else 0)]
        self._insert_all()

    def _insert_all(self):
        n, done = len(self.x), 1
        while done < n:
            batch = self.order[done : done + max(1, min(self.BATCH, done))]
            at = np.full((len(batch), 1), self.entry)
            for k in range(len(self.nearest) - 1, -1, -1):
                ids, sims = self._search(self.x[batch], at, k, self.EF_BUILD)
                at = ids[:, :1]
                rows = np.flatnonzero(self.level[batch] >= k)
                if len(rows):
                    self._link(batch[rows], ids[rows], sims[rows], k)
            done += len(batch)

    def _link(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int):
        """Neighbours of new nodes among those found and each other, and the links back."""
        room = self.nearest[k].shape[1]
        mutual = self.x[new] @ self.x[new].T
        np.fill_diagonal(mutual, -np.inf)
        near = _top(mutual, min(self.M, len(new)))
        cand = np.concatenate([ids, new[near]], axis=1)
        sim = np.concatenate([sims, np.take_along_axis(mutual, near, 1)], axis=1)
        cand[~np.isfinite(sim)] = NONE
        chosen = self._choose(cand, sim, self.M)
        self.nearest[k][new, : self.M] = chosen
        src = np.repeat(new, self.M)
        dst = chosen.ravel()
        src, dst = src[dst != NONE], dst[dst != NONE]
        # gather the links back by target; lists that overflow are chosen anew
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(targets), 512):
            t, f, c = targets[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            extra = np.full((len(t), int(c.max())), NONE, np.int64)
            slot = np.arange(extra.shape[1])[None, :] < c[:, None]
            extra[slot] = src[(f[:, None] + np.arange(extra.shape[1])[None, :])[slot]]
            both = np.concatenate([self.nearest[k][t].astype(np.int64), extra], axis=1)
            both = self._without_repeats(both)
            sim = np.where(both == NONE, -np.inf, np.einsum("qd,qcd->qc", self.x[t], self.x[both]))
            top = _top(sim, min(both.shape[1], 3 * room))
            both, sim = np.take_along_axis(both, top, 1), np.take_along_axis(sim, top, 1)
            full = (both != NONE).sum(1) > room
            out = both[:, :room].copy()
            if out.shape[1] < room:
                out = np.pad(out, ((0, 0), (0, room - out.shape[1])), constant_values=NONE)
            if full.any():
                out[full] = self._choose(both[full], sim[full], room)
            self.nearest[k][t] = out

    @staticmethod
    def _without_repeats(ids: np.ndarray) -> np.ndarray:
        s = np.sort(ids, axis=1)
        s[:, 1:][s[:, 1:] == s[:, :-1]] = NONE
        return s

    def _choose(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row: a candidate closer to the node than to any chosen one; then the closest left over."""
        top = _top(sims, min(ids.shape[1], 3 * m))
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        v = self.x[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            good = (np.where(taken, between[:, j], -np.inf).max(1) < sims[:, j]) & (ids[:, j] != NONE) & (taken.sum(1) < m)
            taken[:, j] = good
        rank = np.where(ids == NONE, 3, np.where(taken, 0, 1)) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :m]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=NONE) if out.shape[1] < m else out

    def _search(self, q: np.ndarray, at: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on level k from the nodes ``at`` (rows of numbers): numbers and similarities, best first."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[rows, at] = True
        ids = np.full((len(q), ef), NONE, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        ids[:, : at.shape[1]] = at
        sims[:, : at.shape[1]] = np.einsum("qd,qcd->qc", q, self.x[at])
        open_ = ids != NONE
        live = np.arange(len(q))
        step = max(self.EXPAND, ef // 16)
        while len(live):
            waiting = np.where(open_[live], sims[live], -np.inf)
            pick = _top(waiting, min(step, ef))
            ok = np.isfinite(np.take_along_axis(waiting, pick, 1))
            going = ok.any(1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            nodes = np.where(ok, np.take_along_axis(ids[live], pick, 1), NONE)
            near = np.where(nodes[:, :, None] == NONE, NONE, self.nearest[k][nodes]).reshape(len(live), -1)
            near = self._without_repeats(near)
            near[seen[live[:, None], near]] = NONE
            near = -np.sort(-near, axis=1)
            near = near[:, : max(1, int((near != NONE).sum(1).max()))].astype(np.int64)
            fresh = near != NONE
            r = np.broadcast_to(live[:, None], near.shape)
            seen[r[fresh], near[fresh]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[fresh] = np.einsum("nd,nd->n", q[r[fresh]], self.x[near[fresh]])
            all_s = np.concatenate([sims[live], s], axis=1)
            top = _top(all_s, ef)
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), top, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry)
        for k in range(len(self.nearest) - 1, 0, -1):
            at = self._search(q, at, k, 1)[0]
        return self._search(q, at, 0, ef)

    def within(self, q: np.ndarray, least: float, ef: int, widenings: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, nodes) with float32 similarity of at least ``least``. A beam that comes back more than half
        full of such nodes is widened four times, up to ``widenings`` times; after that the query scans the graph's rows."""
        found, todo = [], np.arange(len(q))
        for _ in range(widenings + 1):
            if not len(todo):
                break
            full = []
            for lo in range(0, len(todo), self.BATCH):
                some = todo[lo : lo + self.BATCH]
                ids, sims = self.search(q[some], ef)
                hit = (sims >= least) & (ids != NONE)
                over = hit.sum(1) * 2 > ef
                r, c = np.nonzero(hit & ~over[:, None])
                found.append((some[r], ids[r, c]))
                full.append(some[over])
            todo, ef = np.concatenate(full), 4 * ef
        for lo in range(0, len(todo), 64):
            some = todo[lo : lo + 64]
            r, c = np.nonzero(q[some] @ self.x.T >= least)
            found.append((some[r], c))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, level=self.level, entry=getattr(self, "entry", NONE), **{f"l{k}": v for k, v in enumerate(self.nearest)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Hnsw:
        made = cls.__new__(cls)
        z = np.load(io.BytesIO(raw))
        made.x, made.level, made.entry = z["x"], z["level"], int(z["entry"])
        made.nearest = [z[f"l{k}"] for k in range(sum(name.startswith("l") and name[1:].isdigit() for name in z.files))]
        return made
