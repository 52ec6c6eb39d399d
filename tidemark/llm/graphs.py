"""Graph search over vectors, many queries in lockstep, and HNSW construction: array operations only."""

from __future__ import annotations

import numpy as np


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, largest first."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))
    order = np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


def beam_search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int, expand: int = 4, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the ``ef`` best found for each query; -1 pads. ``graph`` has -1 for no neighbour.

    ``entries`` are the nodes each query starts from (queries x some). A query's beam is expanded, a few nodes at a
    time, until all that it holds has been expanded.
    """
    n, ef = len(vectors), min(ef, len(vectors))
    found, scored = np.full((len(queries), ef), -1, dtype=np.int64), np.full((len(queries), ef), -np.inf, dtype=vectors.dtype)
    block = max(1, min(block, 64_000_000 // max(n, 1)))
    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        rows = len(q)
        visited = np.zeros(rows * n, dtype=bool)
        ids, score, done = np.full((rows, ef), -1, dtype=np.int64), np.full((rows, ef), -np.inf, dtype=vectors.dtype), np.ones((rows, ef), dtype=bool)
        start = entries[lo : lo + block]
        keys = np.unique((np.arange(rows)[:, None] * n + start)[start >= 0])
        active = np.arange(rows)
        while True:
            visited[keys] = True
            who, new = keys // n, keys % n
            got = np.einsum("ij,ij->i", q[who], vectors[new])
            # Put the new ones of each row beside its beam and keep the best ef.
            begin = np.searchsorted(who, np.arange(rows + 1))
            most = int(np.diff(begin).max(initial=0))
            if most:
                touched = np.flatnonzero(np.diff(begin))
                local = np.full(rows, -1)
                local[touched] = np.arange(len(touched))
                side_ids, side = np.full((len(touched), most), -1, dtype=np.int64), np.full((len(touched), most), -np.inf, dtype=vectors.dtype)
                col = np.arange(len(keys)) - begin[who]
                side_ids[local[who], col], side[local[who], col] = new, got
                all_ids, all_s = np.concatenate([ids[touched], side_ids], 1), np.concatenate([score[touched], side], 1)
                all_done = np.concatenate([done[touched], side_ids < 0], 1)
                pick = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
                ids[touched], score[touched], done[touched] = (np.take_along_axis(x, pick, 1) for x in (all_ids, all_s, all_done))
            active = active[~done[active].all(axis=1)]
            if not len(active):
                break
            open_s = np.where(done[active], -np.inf, score[active])
            width = min(expand, ef)
            pick = np.argpartition(-open_s, width - 1, axis=1)[:, :width]
            real = np.take_along_axis(open_s, pick, 1) > -np.inf
            nodes = np.where(real, np.take_along_axis(ids[active], pick, 1), -1)
            r, c = np.nonzero(real)
            done[active[r], pick[r, c]] = True
            near = graph[nodes[r, c]]
            flat = (active[r][:, None] * n + near)[near >= 0]
            keys = np.unique(flat[~visited[flat]])
        order = np.argsort(-score, axis=1, kind="stable")
        found[lo : lo + block], scored[lo : lo + block] = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    return found, scored


def spread_out(vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each node's candidates (-1 pads): first those nearer to the node than to any chosen before them."""
    out = np.full((len(nodes), keep), -1, dtype=np.int32)
    for lo in range(0, len(nodes), 256):
        cand, own = near[lo : lo + 256], vectors[nodes[lo : lo + 256]]
        have = cand >= 0
        v = vectors[np.where(have, cand, 0)]
        to_node = np.where(have, np.einsum("ijk,ik->ij", v, own), -np.inf)
        order = np.argsort(-to_node, axis=1, kind="stable")
        cand, to_node = np.take_along_axis(cand, order, 1), np.take_along_axis(to_node, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        among = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(cand.shape, dtype=bool)
        for t in range(cand.shape[1]):
            blocked = (chosen & (among[:, t, :] > to_node[:, t, None])).any(axis=1)
            chosen[:, t] = ~blocked & (cand[:, t] >= 0) & (chosen.sum(axis=1) < keep)
        rank = np.where(cand < 0, 2, np.where(chosen, 0, 1)) * cand.shape[1] + np.arange(cand.shape[1])
        pick = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        best = np.take_along_axis(cand, pick, 1)
        out[lo : lo + 256, : best.shape[1]] = best
    return out


def build_layer(vectors: np.ndarray, members: np.ndarray, entries: np.ndarray, links: int, ef: int) -> np.ndarray:
    """One layer of an HNSW graph over ``members``: nodes come in batches, each joined to what its beam search finds."""
    n = len(vectors)
    graph = np.full((n, links), -1, dtype=np.int32)
    first = min(len(members), 4 * links)
    placed = members[:first]
    like = vectors[placed] @ vectors[placed].T
    np.fill_diagonal(like, -np.inf)
    graph[placed] = spread_out(vectors, placed, np.where(np.eye(first, dtype=bool), -1, placed[None, :].repeat(first, 0)), links) if first > 1 else -1
    at = first
    while at < len(members):
        batch = members[at : at + min(1024, at)]
        start = np.concatenate([entries[batch], np.broadcast_to(placed[:1], (len(batch), 1))], axis=1)
        start = np.where(np.isin(start, members[:at]), start, placed[0])
        near, _ = beam_search(vectors, graph, vectors[batch], start, ef)
        like = vectors[batch] @ vectors[batch].T
        np.fill_diagonal(like, -np.inf)
        peers = batch[top(like, min(links, len(batch)))] if len(batch) > 1 else np.full((1, 1), -1)
        peers = np.where(peers == batch[:, None], -1, peers)
        graph[batch] = spread_out(vectors, batch, np.concatenate([near, peers], axis=1), links)
        # Links back: a node that has no room left chooses anew among old and new.
        a = np.repeat(batch, links)
        b = graph[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, begin, count = np.unique(b, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 2 * links)
        extra = np.full((len(nodes), max(width, 1)), -1, dtype=np.int64)
        col = np.arange(len(b)) - np.repeat(begin, count)
        fits = col < width
        extra[np.repeat(np.arange(len(nodes)), count)[fits], col[fits]] = a[fits]
        old = graph[nodes]
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        graph[nodes] = spread_out(vectors, nodes, np.concatenate([old, extra], axis=1), links)
        at += len(batch)
    return graph


class Hnsw:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, links: int = 16, ef: int = 48, seed: int = 5) -> None:
        self.vectors = vectors
        n = len(vectors)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)), 8).astype(int) if n else np.zeros(0, int)
        self.layers: list[np.ndarray] = []
        self.top = np.zeros(1, dtype=np.int64)
        entries = np.zeros((n, 1), dtype=np.int64)
        for up in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= up)
            if up and len(members) < 2:
                continue
            if not self.layers:
                self.top = members[:1]
                entries[:] = members[0]
            else:
                entries = beam_search(vectors, self.layers[-1], vectors, entries, 4)[0][:, :1]
            self.layers.append(build_layer(vectors, members, entries, links * (1 if up else 2), ef))

    def rows(self) -> list[list[np.ndarray]]:
        """Each node's neighbours by layer, from the top one down; none in layers it isn't in."""
        return [[g[k][g[k] >= 0] for g in self.layers] for k in range(len(self.vectors))]

    @classmethod
    def restored(cls, vectors: np.ndarray, rows: list, top: int) -> Hnsw:
        out = cls.__new__(cls)
        out.vectors, out.top, out.layers = vectors, np.array([top]), []
        for layer in range(len(rows[0])):
            sizes = np.fromiter((len(r[layer]) for r in rows), dtype=np.int64, count=len(rows))
            graph = np.full((len(rows), max(int(sizes.max()), 1)), -1, dtype=np.int32)
            who = np.repeat(np.arange(len(rows)), sizes)
            if len(who):
                graph[who, np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate([np.asarray(r[layer]) for r in rows])
            out.layers.append(graph)
        return out

    def descend(self, queries: np.ndarray) -> np.ndarray:
        entries = np.broadcast_to(self.top, (len(queries), 1))
        for graph in self.layers[:-1]:
            entries = beam_search(self.vectors, graph, queries, entries, 4)[0][:, :1]
        return entries

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.vectors, self.layers[-1], queries, self.descend(queries), ef)

    def within(self, queries: np.ndarray, least: float, ef: int) -> list[np.ndarray]:
        """For each query all nodes found at ``least`` or nearer: a beam that is full of them is widened."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            ids, score = self.search(queries[todo], ef)
            full = (score[:, -1] >= least) & (ids.shape[1] < len(self.vectors))
            for k in np.flatnonzero(~full).tolist():
                out[todo[k]] = ids[k, (score[k] >= least) & (ids[k] >= 0)]
            todo, ef = todo[full], ef * 2
        return out
