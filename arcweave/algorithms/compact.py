"""Small graphs, and what is left of large ones, in one task: arrays in place of rounds of joins.

The loops of the other modules shuffle every round, which for a million edges is latency only. Once the number of rows
is known to be at most ONE_TASK, a single task takes them all and gives what the rounds would have given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arcweave.cluster import checkpointed

#: Rows that one task takes at most: some tens of bytes each, a few hundred MB with all that is computed from them.
ONE_TASK = 1_000_000
#: Rows of a batch that a task gives back.
SLICE = 100_000


def small(rows: DataFrame) -> bool:
    return rows.count() <= ONE_TASK


def in_one_task(rows: DataFrame, work: Callable[..., tuple], schema: str) -> DataFrame:
    """work(columns...) -> columns of ``schema``, on all rows at once; no rows give none. The columns have no nulls."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        out = work(*(x.to_numpy() for x in table.columns))
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return rows.coalesce(1).mapInArrow(run, schema)


class Adjacency:
    """The neighbours of the sorted ids as places of four bytes each: those of place v are ``to[first[v] : first[v] + size[v]]``,
    with counts m beside them if there are any."""

    def __init__(self, batches: Iterator[pa.RecordBatch], rows: int):
        to, self.m, runs, lengths, n = np.empty(rows, np.int64), None, [], [], 0
        for batch in batches:
            a, k = batch.column(0).to_numpy(), batch.num_rows
            if k:
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                runs.append(a[starts])
                lengths.append(np.diff(np.append(starts, k)))
                to[n : n + k] = batch.column(1).to_numpy()
                if batch.num_columns > 2:
                    self.m = np.empty(rows, np.int32) if self.m is None else self.m
                    self.m[n : n + k] = batch.column(2).to_numpy()
                n += k
        ids, lengths = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (runs, lengths))
        new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])  # a run may go on in the next batch
        ids, begin, lengths = ids[new], (np.cumsum(lengths) - lengths)[new], np.add.reduceat(lengths, new) if len(new) else lengths
        order = np.argsort(ids, kind="stable")
        self.n, self.ids, self.first, self.size = len(ids), ids[order], begin[order], lengths[order]
        self.to = np.empty(n, np.int32)
        for i in range(0, n, 1 << 20):
            self.to[i : i + (1 << 20)] = np.searchsorted(self.ids, to[i : i + (1 << 20)])


def with_adjacency(rows: DataFrame, work: Callable[[Adjacency], tuple], schema: str) -> DataFrame:
    """work(adjacency) -> columns of ``schema``, in one task, for graphs of any size that an algorithm takes node by node.

    rows: a, b[, m] of each undirected edge in both directions. The cluster sorts them; the task then takes 12 bytes a
    row while it reads and 4 afterwards (with m 16 and 8), and some tens of bytes a node.
    """
    names = [c.split()[0] for c in schema.split(",")]
    rows = checkpointed(rows.repartitionByRange("a").sortWithinPartitions("a", "b"))
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(Adjacency(batches, n))]
        for i in range(0, len(out[0]), SLICE):
            yield pa.RecordBatch.from_arrays([x.slice(i, SLICE) for x in out], names=names)

    return rows.coalesce(1).mapInArrow(run, schema)


def _cuts(g: Adjacency) -> tuple[np.ndarray, list[int], list[int]]:
    """Whether each place is a cut point, and the ends of the bridges: depth-first search by pointers, without recursion."""
    to, at, end = memoryview(g.to), memoryview(g.first.copy()), memoryview(g.first + g.size)
    entered, low, parent = (memoryview(np.zeros(g.n, np.int32)) for _ in range(3))
    cut, tops, bottoms, count = np.zeros(g.n, bool), [], [], 0
    for root in range(g.n):
        if entered[root]:
            continue
        count += 1
        entered[root] = low[root] = count
        parent[root], children, v = -1, 0, root
        while True:
            i = at[v]
            if i < end[v]:
                at[v] = i + 1
                w = to[i]
                e = entered[w]
                if not e:
                    count += 1
                    entered[w] = low[w] = count
                    parent[w] = v
                    children += v == root
                    v = w
                elif e < low[v] and w != parent[v]:
                    low[v] = e
                continue
            p = parent[v]
            if p < 0:
                break
            if low[v] < low[p]:
                low[p] = low[v]
            if low[v] > entered[p]:
                tops.append(min(v, p))
                bottoms.append(max(v, p))
            if p != root and low[v] >= entered[p]:
                cut[p] = True
            v = p
        cut[root] = children > 1
    return cut, tops, bottoms


def cut_points(g: Adjacency) -> tuple:
    return (g.ids[_cuts(g)[0]],)


def bridges(g: Adjacency) -> tuple:
    _, a, b = _cuts(g)
    return g.ids[np.array(a, np.int64)], g.ids[np.array(b, np.int64)]


def louvain(resolution: float, rounds: int):
    """id and community (its smallest id) by local moving in order of id; m: how many edges join the two."""

    def work(g: Adjacency) -> tuple:
        degree = np.array([g.m[i : i + k].sum(dtype=np.int64) for i, k in zip(g.first, g.size, strict=True)], np.float64)
        m2 = float(degree.sum())
        homes, weights = np.arange(g.n, dtype=np.int32), degree.copy()
        home, weight, degrees, first, size = (memoryview(x) for x in (homes, weights, degree, g.first, g.size))
        for _ in range(rounds):
            moved = False
            for v in range(g.n):
                own, d, i, k = home[v], degrees[v], first[v], size[v]
                near = homes[g.to[i : i + k]]
                if k > 256:
                    found, which = np.unique(near, return_inverse=True)
                    links = dict(zip(found.tolist(), np.bincount(which, g.m[i : i + k]).tolist(), strict=True))
                else:
                    links = {}
                    for c, x in zip(near.tolist(), g.m[i : i + k].tolist(), strict=True):
                        links[c] = links.get(c, 0.0) + x
                weight[own] -= d
                f = resolution * d
                best, most = own, links.get(own, 0.0) - f * weight[own] / m2
                for c, x in links.items():
                    gain = x - f * weight[c] / m2
                    if gain > most or gain == most and best != own and c < best:
                        if c != own:
                            best, most = c, gain
                weight[best] += d
                if best != own:
                    home[v], moved = best, True
            if not moved:
                break
        least = np.full(g.n, g.n)
        np.minimum.at(least, homes, np.arange(g.n))
        return g.ids, g.ids[least[homes]]

    return work


class Numbered:
    """Edges between places of the sorted ids, by source."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None, more: np.ndarray | None = None):
        parts = [src, dst] if more is None else [src, dst, more]
        self.ids, place = np.unique(np.concatenate(parts), return_inverse=True)
        a, b = place[: len(src)], place[len(src) : 2 * len(src)]
        order = np.argsort(a, kind="stable")
        self.n, self.a, self.b = len(self.ids), a[order], b[order]
        self.w = None if w is None else w[order]
        self.begin = np.searchsorted(self.a, np.arange(self.n + 1))

    def out_of(self, nodes: np.ndarray) -> np.ndarray:
        """The numbers of the edges that leave the nodes."""
        n = self.begin[nodes + 1] - self.begin[nodes]
        return np.repeat(self.begin[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges, ascending, and the smallest id each is connected to."""
    g = Numbered(a, b)
    a, b, up = g.a, g.b, np.arange(g.n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(higher := up[up], up):
            up = higher
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return g.ids, g.ids[up]


def depths(start: int, most: int | None):
    def work(src: np.ndarray, dst: np.ndarray) -> tuple:
        g = Numbered(src, dst, more=np.array([start]))
        depth = np.full(g.n, -1, np.int32)
        front, level = np.searchsorted(g.ids, [start]), 0
        depth[front] = 0
        while len(front) and (most is None or level < most):
            level += 1
            front = np.unique(g.b[g.out_of(front)])
            front = front[depth[front] < 0]
            depth[front] = level
        seen = depth >= 0
        return g.ids[seen], depth[seen]

    return work


def distances(source: int, rounds: int | None):
    """id, distance, predecessor, and whether the node moved in the last round, as rounds of relaxation give them."""

    def work(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple:
        g = Numbered(src, dst, w, np.array([source]))
        best, via = np.full(g.n, np.inf), np.full(g.n, -1)
        front, k = np.searchsorted(g.ids, [source]), 0
        best[front] = 0.0
        while len(front) and (rounds is None or k < rounds):
            k += 1
            e = g.out_of(front)
            to, d, p = g.b[e], best[g.a[e]] + g.w[e], g.a[e]
            order = np.lexsort((p, d, to))
            to, d, p = to[order], d[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])[: len(to)])
            first = first[d[first] < best[to[first]]]
            front = to[first]
            best[front], via[front] = d[first], p[first]
        seen = np.isfinite(best)
        moved = np.zeros(g.n, bool)
        moved[front] = True
        return g.ids[seen], best[seen], pa.array(g.ids[via[seen]], mask=via[seen] < 0), moved[seen]

    return work


def ranks(n: int, damping: float, rounds: int, tolerance: float):
    """id and PageRank of the nodes with edges, and with a null id that of the others among the n.

    Of edges (src, dst, share, there): share of the source's rank; not there: dst isn't one of the n.
    """

    def work(src: np.ndarray, dst: np.ndarray, share: np.ndarray, there: np.ndarray) -> tuple:
        g = Numbered(src, np.where(there, dst, src), np.where(there, share, 0.0))
        sink, alone = np.bincount(g.a, minlength=g.n) == 0, n - g.n
        rank, lone = np.full(g.n, 1.0 / n), 1.0 / n
        for _ in range(rounds):
            base = (1 - damping) / n + damping * (rank[sink].sum() + lone * alone) / n
            new = base + damping * np.bincount(g.b, rank[g.a] * g.w, minlength=g.n)
            change = max(np.abs(new - rank).max(initial=0.0), abs(base - lone) if alone else 0.0)
            rank, lone = new, base
            if change < tolerance:
                break
        return pa.array([*g.ids.tolist(), None], pa.int64()), np.append(rank, lone)

    return work


def strong(src: np.ndarray, dst: np.ndarray) -> tuple:
    """id, and the smallest id of its strong component: Tarjan, on lists."""
    g = Numbered(src, dst)
    heads, begin = g.b.tolist(), g.begin.tolist()
    number, low, at = [-1] * g.n, [0] * g.n, begin[:-1]
    on, component, pending = [False] * g.n, [0] * g.n, []
    count = 0
    for root in range(g.n):
        if number[root] >= 0:
            continue
        work = [root]
        while work:
            v = work[-1]
            if number[v] < 0:
                number[v] = low[v] = count
                count += 1
                pending.append(v)
                on[v] = True
            down = False
            while at[v] < begin[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if number[w] < 0:
                    work.append(w)
                    down = True
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            if down:
                continue
            work.pop()
            if work:
                low[work[-1]] = min(low[work[-1]], low[v])
            if low[v] == number[v]:
                members = [pending.pop()]
                while members[-1] != v:
                    members.append(pending.pop())
                least = min(members)
                for m in members:
                    on[m], component[m] = False, least
    return g.ids, g.ids[np.array(component, np.int64)]


def cores(least: int):
    """id and core number of undirected edges without repeats, no number below ``least``."""

    def work(a: np.ndarray, b: np.ndarray) -> tuple:
        g = Numbered(np.concatenate([a, b]), np.concatenate([b, a]))
        degree, core = np.bincount(g.a, minlength=g.n), np.zeros(g.n, np.int32)
        live, k = np.ones(g.n, bool), least
        while live.any():
            k = max(k, int(degree[live].min()))
            drop = np.flatnonzero(live & (degree <= k))
            while len(drop):
                core[drop], live[drop] = k, False
                to = g.b[g.out_of(drop)]
                degree -= np.bincount(to, minlength=g.n)
                to = np.unique(to)
                drop = to[live[to] & (degree[to] <= k)]
        return g.ids, core

    return work


def forest(src: np.ndarray, dst: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple:
    """src, dst, w of a minimum spanning forest of the edges p - q, ties by w, src, dst: Borůvka over ranks."""
    order = np.lexsort((dst, src, w))
    src, dst, w, p, q = (x[order] for x in (src, dst, w, p, q))
    _, place = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = place[: len(p)], place[len(p) :]
    n, rank = int(place.max(initial=-1)) + 1, np.arange(len(p))
    used, home = np.zeros(len(p), bool), np.arange(n)
    while len(rank):
        best = np.full(n, len(src))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        used[(new := np.unique(best[best < len(src)]))] = True
        ids, least = components(*(home[place[: len(src)][new]], home[place[len(src) :][new]]))
        up = np.arange(n)
        up[ids] = least
        home = up[home]
        a, b = up[a], up[b]
        apart = a != b
        a, b, rank = a[apart], b[apart], rank[apart]
    return src[used], dst[used], w[used]


def labels(rounds: int):
    """Synchronous label propagation over edges (a, b, m) in both directions."""

    def work(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple:
        g = Numbered(a, b, m)
        label, before = np.arange(g.n), None
        for _ in range(rounds):
            key, which = np.unique(g.a * g.n + label[g.b], return_inverse=True)
            votes = np.bincount(which, g.w)
            node, seen = key // g.n, key % g.n
            order = np.lexsort((seen, -votes, node))
            first = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
            new = label.copy()
            new[node[first]] = seen[first]
            if np.array_equal(new, label) or before is not None and np.array_equal(new, before):
                label = new
                break
            before, label = label, new
        return g.ids, g.ids[label]

    return work


def levels(src: np.ndarray, dst: np.ndarray) -> tuple:
    """id and the length of the longest path to it; -1 for what a cycle reaches or holds."""
    g = Numbered(src, dst)
    level, waits = np.full(g.n, -1, np.int32), np.bincount(g.b, minlength=g.n)
    front, k = np.flatnonzero(waits == 0), 0
    while len(front):
        level[front], k = k, k + 1
        to = g.b[g.out_of(front)]
        waits -= np.bincount(to, minlength=g.n)
        to = np.unique(to)
        front = to[waits[to] == 0]
    return g.ids, level
