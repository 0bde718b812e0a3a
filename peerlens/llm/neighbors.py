"""Problem 1: the k most similar vectors of every vector, by a hierarchical k-means tree searched best bin first.

1. The tree is fitted on a bounded sample (SAMPLE vectors, of many rows one in SAMPLE_ONE_IN up to SAMPLE_MOST, chosen by
   a hash of the id); its size is bounded with it, so it can be sent to every worker.
2. Calibration: for a few hundred sampled vectors the true neighbours are found by brute force against all rows. A
   best-bin-first search keeps a priority queue of tree nodes by distance and visits leaves in that order. For each
   true pair it is known how far the search must be widened until one of the two vectors reaches the other's home
   leaf. The margin that covers the wanted share of the pairs is the one used. Leaves visited at most are doubled until
   that share of the pairs is within reach, up to all leaves. Where too few pairs are seen, more vectors calibrate, and
   where all of the sample show too few, every leaf is visited.
3. Every row is indexed in its home leaf, and sent as a query to the further leaves that its search visits within the
   margin. A pair is found if either end visits the other's home, so few visits are needed.
4. Each leaf compares its queries with its members by one matrix product. Pairs near the threshold are computed again
   in double precision. Only the k best of each query leave the leaf; they are merged by Spark. A leaf that by the
   sample holds more than PART rows is split into parts of that size by a hash of the vector: each part is a task's work
   of its own, which the leaf's visitors and the members of the parts after it visit.

Equal vectors are one entry with a list of ids, merged before the shuffle, so that a copy in a third of all rows
neither fills a leaf nor squares its work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlens.plans import shuffle_partitions

#: Vectors that the tree is fitted on; of more than SAMPLE * SAMPLE_ONE_IN rows one in so many, up to SAMPLE_MOST. Leaves are
#: kept under MOST_LEAF rows up to SAMPLE_MOST / 4 * MOST_LEAF, four billion rows; beyond that they grow with the table.
SAMPLE, SAMPLE_ONE_IN, SAMPLE_MOST = 65_536, 2_000, 1 << 20
#: Vectors that calibrate the search at first.
CALIBRATE = 512
#: Rows that are grouped by leaf at once before the shuffle.
GROUPED = 32_768
#: Queries that are searched at once, and nodes in all their queues.
SEARCHED, QUEUED = 4_096, 1 << 23
#: Visits that are grouped by leaf at once, bytes of vectors written at once, visiting vectors compared at once in a leaf.
VISITS, WRITTEN, VISITORS = 1 << 20, 1 << 25, 65_536
#: Members of a leaf aimed at: LEAF_ROOT times the square root of the number of rows, within these bounds.
LEAF_ROOT, LEAST_LEAF, MOST_LEAF = 3.3, 2_048, 16_384
#: Rows of a part of a leaf.
PART = 65_536
_SLACK = 2e-5


class Tree:
    """A k-means tree over unit vectors. The children of node i are first[i] .. first[i] + count[i] - 1; a node without
    children is a leaf. Node 0 is the root."""

    def __init__(self, centroids: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.centroids, self.first, self.count = centroids, first, count
        self.half = (centroids.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)

    @classmethod
    def fit(cls, points: np.ndarray, leaf_points: float, branch: int, seed: int = 1) -> Tree:
        rng = np.random.default_rng(seed)
        centroids, first, count = [points.mean(axis=0) if len(points) else np.zeros(points.shape[1], np.float32)], [0], [0]
        todo = [(0, points)]
        while todo:
            node, own = todo.pop(0)
            if len(own) <= max(leaf_points, 2):
                continue
            label, centre = _kmeans(own, min(branch, int(np.ceil(len(own) / leaf_points))), rng)
            if len(centre) < 2:
                continue
            first[node], count[node] = len(centroids), len(centre)
            for c in range(len(centre)):
                todo.append((len(centroids), own[label == c]))
                centroids.append(centre[c])
                first.append(0)
                count.append(0)
        return cls(np.asarray(centroids, dtype=np.float32), np.asarray(first), np.asarray(count))

    def distances(self, q: np.ndarray, nodes: slice) -> np.ndarray:
        return np.sqrt(np.maximum(1 + self.half[nodes] - 2 * (q @ self.centroids[nodes].T), 0))

    def search(self, q: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best-bin-first search of all queries: query index, leaf, and how far the priority had to rise above that of
        the first leaf, for each visit in order. A query's first visit is its home.

        A query's queue holds nodes by distance. Its nearest node is popped: an inner node is replaced by its nearest
        children, a leaf is visited. It ends when what it pops lies more than `margin` behind its home, or after
        `most` leaves.
        """
        if not self.count[0]:
            z = np.zeros(len(q), dtype=np.int64)
            return np.arange(len(q)), z, z.astype(np.float32)
        step = max(1, min(SEARCHED, QUEUED // min(len(self.count), self._kept(most) * (min(most, self.leaves) + 6))))
        parts = [(s, *self._search(q[s : s + step], margin, most)) for s in range(0, max(1, len(q)), step)]
        return np.concatenate([r + s for s, r, _, _ in parts]), np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])

    def _kept(self, most: int) -> int:
        """Children of a node that are queued: each child that is popped leads to a visit at least, so that of more than
        `most` of them the others are never reached."""
        return min(most + 8, int(self.count.max()))

    @property
    def leaves(self) -> int:
        return int((self.count == 0).sum())

    def _search(self, q: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, keep = len(q), self._kept(most)
        queue = np.full((n, keep), np.inf, dtype=np.float32)
        node = np.zeros((n, keep), dtype=np.int32)
        used = np.zeros(n, dtype=np.int64)

        def push(rows: np.ndarray, parent: int) -> None:
            nonlocal queue, node
            first, k = self.first[parent], self.count[parent]
            more = int(used[rows].max(initial=0)) + min(k, keep) - queue.shape[1]
            if more > 0:
                room = ((0, 0), (0, max(more, queue.shape[1] // 2)))
                queue, node = np.pad(queue, room, constant_values=np.inf), np.pad(node, room)
            d, child = self.distances(q[rows], slice(first, first + k)), np.arange(first, first + k)[None, :]
            if k > keep:
                child = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                d, child = np.take_along_axis(d, child, axis=1), child + first
            at = used[rows][:, None] + np.arange(d.shape[1])
            queue[rows[:, None], at] = d
            node[rows[:, None], at] = child
            used[rows] += d.shape[1]

        active = np.arange(n)
        push(active, 0)
        home, level, visits = np.full(n, np.inf, np.float32), np.zeros(n, np.float32), np.zeros(n, np.int64)
        out: list[tuple] = [(active[:0], node[:0, 0], level[:0])]
        while len(active):
            reach = int(used[active].max())
            best = queue[active, :reach].argmin(axis=1)
            d, popped = queue[active, best], node[active, best]
            queue[active, best] = np.inf
            level[active] = np.maximum(level[active], d)
            go = np.isfinite(d) & ((visits[active] == 0) | (level[active] - home[active] <= margin))
            active, d, popped = active[go], d[go], popped[go]
            leaf = self.count[popped] == 0
            rows = active[leaf]
            new = visits[rows] == 0
            home[rows[new]], level[rows[new]] = d[leaf][new], d[leaf][new]
            visits[rows] += 1
            out.append((rows, popped[leaf], level[rows] - home[rows]))
            for p in np.unique(popped[~leaf]):
                push(active[popped == p], p)
            active = active[visits[active] < most]
        return tuple(np.concatenate(x) for x in zip(*out))


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centre = points[rng.choice(len(points), k, replace=False)].copy()
    label = np.zeros(len(points), dtype=np.int64)
    for _ in range(rounds):
        label = ((centre**2).sum(axis=1) - 2 * (points @ centre.T)).argmin(axis=1)
        size = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        edges = np.concatenate([[0], np.cumsum(size)[:-1]])
        held = size > 0
        sums = np.add.reduceat(points[order], edges[held], axis=0)
        centre[held] = sums / size[held][:, None]
    used, label = np.unique(label, return_inverse=True)
    return label, centre[used]


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold a usable vector, and these vectors as they are."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    column = column.filter(pa.array(size == dim))
    rows = np.flatnonzero(size == dim)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)  # nulls become NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None]).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, rounded to 6 places."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot = (a * b).sum(axis=1)
    return np.round(dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), 6)


def _brute(sent, dim: int, k: int, least: float):
    """The best neighbours of the calibrating vectors within each partition: q, id, similarity, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        unit = _unit(queries)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim), np.float32)]
        for batch in batches:
            rows, x = _vectors(batch.column(1), dim)
            own = batch.column(0).to_numpy()[rows]
            every = _unit(x).T
            for i in range(0, len(unit), CALIBRATE):
                q, r = np.nonzero(unit[i : i + CALIBRATE] @ every >= least - _SLACK)
                q += i
                sim = _cosines(queries[q], x[r])
                keep = (sim >= least) & (ids[q] != own[r])
                q, other, sim, vec = (np.concatenate([a, b[keep]]) for a, b in zip(best, (q, own[r], sim, x[r])))
                order = np.lexsort((other, -sim, q))
                q, other, sim, vec = q[order], other[order], sim[order], vec[order]
                new = np.ones(len(q), dtype=bool)
                new[1:] = (q[1:] != q[:-1]) | (other[1:] != other[:-1]) | (sim[1:] != sim[:-1])
                q, other, sim, vec = q[new], other[new], sim[new], vec[new]
                top = _rank(q) < 2 * k  # an id may be there with different vectors
                best = [q[top], other[top], sim[top], vec[top]]
        q, other, sim, vec = best
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(other), pa.array(sim), pa.array([v.tobytes() for v in vec], pa.binary())], ["q", "id", "sim", "vec"])

    return run


def _rank(group: np.ndarray) -> np.ndarray:
    """Position of each row within its group; the groups are sorted."""
    if not len(group):
        return np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))


def _merge_equal(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different vectors, number of ids of each, and the ids (ascending and different for each vector)."""
    view = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel()
    _, at, label = np.unique(view, return_index=True, return_inverse=True)
    order = np.lexsort((ids, label))
    label, ids = label[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (label[1:] != label[:-1]) | (ids[1:] != ids[:-1])
    return x[at], np.bincount(label[new], minlength=len(at)), ids[new]


def _hashed(x: np.ndarray) -> np.ndarray:
    """A number for each vector, the same for equal ones."""
    bits = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    mixed = (bits * (np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def _spread(sent, dim: int):
    """Rows to blocks of a leaf (of a part of it, if it has several): members (home) and visitors."""
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())

    def blocks(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, count, ids = _merge_equal(x, ids)
        start = np.concatenate([[0], np.cumsum(count)])
        step = max(1, VISITS // (sent.value[2] + int(sent.value[3].max())))
        for s in range(0, len(x), step):
            yield from grouped(ids, x, count, start, s, min(len(x), s + step))

    def grouped(ids: np.ndarray, x: np.ndarray, count: np.ndarray, start: np.ndarray, s: int, e: int) -> Iterator[pa.RecordBatch]:
        tree, margin, most, parts = sent.value
        q, leaf, _ = tree.search(_unit(x[s:e]), margin, most)
        home = np.ones(len(q), dtype=bool)
        order = np.argsort(q, kind="stable")
        home[order] = _rank(q[order]) == 0
        if parts.max() > 1:
            # the member of a part visits the parts before it, a visitor all parts of the leaf
            own = _hashed(x[s:e])[q] % parts[leaf]
            n = np.where(home, own + 1, parts[leaf])
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, home, own = np.repeat(q, n), np.repeat(home, n), np.repeat(own, n)
            home &= part == own
            leaf = np.repeat((np.cumsum(parts) - parts)[leaf], n) + part
        order = np.lexsort((q, home, leaf))
        q, leaf, home = q[order] + s, leaf[order], home[order]
        key = leaf.astype(np.int64) * 2 + home
        edges = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)]
        rows, size = [], 0
        for a, b in zip(edges, edges[1:]):
            own = q[a:b]
            listed = np.concatenate([ids[start[i] : start[i + 1]] for i in own])
            rows.append((int(leaf[a]), bool(home[a]), x[own].tobytes(), count[own].astype(np.int32).tobytes(), listed.tobytes()))
            size += len(rows[-1][2]) + len(rows[-1][4])
            if size > WRITTEN or b == len(key):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["leaf", "home", "vecs", "counts", "ids"])
                rows, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows, x = _vectors(batch.column(1), dim)
            if len(rows):
                held.append((batch.column(0).to_numpy()[rows], x))
                n += len(rows)
            if n >= GROUPED:
                yield from blocks(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield from blocks(*map(np.concatenate, zip(*held)))

    return run


class _Side:
    """Members or visitors of a leaf: different vectors with their ids."""

    def __init__(self, blocks: list[tuple], dim: int):
        x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, dim) for v, _, _ in blocks]) if blocks else np.zeros((0, dim), np.float32)
        count = np.concatenate([np.frombuffer(c, np.int32) for _, c, _ in blocks]) if blocks else np.zeros(0, np.int32)
        ids = np.concatenate([np.frombuffer(i, np.int64) for _, _, i in blocks]) if blocks else np.zeros(0, np.int64)
        view = np.ascontiguousarray(x).view(np.dtype((np.void, dim * 4))).ravel()
        _, at, label = np.unique(view, return_index=True, return_inverse=True) if len(x) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        each = np.repeat(label, count)
        order = np.lexsort((ids, each))
        each, ids = each[order], ids[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (each[1:] != each[:-1]) | (ids[1:] != ids[:-1])
        self.x, self.ids = x[at], ids[new]
        self.count = np.bincount(each[new], minlength=len(at))
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.unit = _unit(self.x) if len(self.x) else self.x


def _near(sim: np.ndarray, least: float, k: int, both: bool) -> np.ndarray:
    """Which entries of a block of single-precision similarities are to be computed exactly: those near or above the
    threshold, and where these are many, only those near or above the k + 1 best of their row (or column, if both ends
    look for neighbours). The slack is larger than the error of single precision, so none of the k best is lost."""
    near = sim >= least - _SLACK
    if near.sum() <= 4 * (k + 1) * sum(sim.shape):
        return near
    top = np.zeros_like(near)
    for axis in (1, 0) if both else (1,):
        n = sim.shape[axis]
        top |= sim >= (np.partition(sim, n - k - 2, axis=axis).take([n - k - 2], axis=axis) - _SLACK if n > k + 2 else -np.inf)
    return near & top


def _pairs(a: _Side, b: _Side, least: float, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of a and b at or above the similarity, with it, by blocks of a; of an entry with very many at least the
    k + 1 best."""
    step = max(1, 2_000_000 // max(1, len(b.x)))
    for s in range(0, len(a.x), step):
        i, j = np.nonzero(_near(a.unit[s : s + step] @ b.unit.T, least, k, not same))
        i += s
        sim = _cosines(a.x[i], b.x[j])
        keep = sim >= least
        if same:
            keep &= (i != j) | (a.count[i] > 1)
        yield i[keep], j[keep], sim[keep]


def _listed(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, sim: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entry pairs as rows (id, other id, similarity): every id of a's entry with the k + 1 smallest ids of b's."""
    others = np.minimum(b.count[j], k + 1)
    weight = a.count[i] * others
    if not len(i):
        return
    part = (np.cumsum(weight) - weight) // 500_000
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        n = weight[at]
        own = np.repeat(at, n)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        mine, other = rank // others[own], rank % others[own]
        x, y = a.ids[a.start[i[own]] + mine], b.ids[b.start[j[own]] + other]
        keep = x != y
        yield x[keep], y[keep], sim[own][keep]


def _best(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different others of each id."""
    x, y, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((y, -s, x))
    x, y, s = x[order], y[order], s[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (s[1:] != s[:-1])
    x, y, s = x[new], y[new], s[new]
    top = _rank(x) < k
    return x[top], y[top], s[top]


def _leaf_neighbours(dim: int, k: int, least: float):
    """Blocks sorted by leaf, members first, to the k best of each id in the leaf; visitors are taken by parts."""

    def rows(best: tuple) -> Iterator[pa.RecordBatch]:
        x, y, s = best
        for a in range(0, len(x), 100_000):
            c = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[c], pa.int64()), pa.array(y[c], pa.int64()), pa.array(s[c], pa.float64())], ["id", "other", "sim"])

    def within(members: _Side) -> list[tuple]:
        found: list[tuple] = []
        total = 0
        for i, j, sim in _pairs(members, members, least, k, True):
            found += _listed(members, members, i, j, sim, k)
            total += len(i)
            if total > 1_000_000:
                found, total = [_best(found, k)], 0
        return [_best(found, k)]

    def visit(members: _Side, blocks: list[tuple], found: list[tuple]) -> tuple[list[tuple], tuple]:
        """What members found so far, and what these visitors find."""
        visitors = _Side(blocks, dim)
        own: list[tuple] = []
        total = 0
        for i, j, sim in _pairs(visitors, members, least, k, False):
            own += _listed(visitors, members, i, j, sim, k)
            found += _listed(members, visitors, j, i, sim, k)
            total += len(i)
            if total > 1_000_000:
                own, found, total = [_best(own, k)], [_best(found, k)], 0
        return [_best(found, k)], _best(own, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, size = None, [], 0
        members, found = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            """Takes what is held: the members, or a part of the visitors."""
            nonlocal members, found, held, size
            if members is None:
                members = _Side([b[1:] for b in held if b[0]], dim)
                found = within(members)
            if visitors := [b[1:] for b in held if not b[0]]:
                found, own = visit(members, visitors, found)
                yield from rows(own)
            held, size = [], 0

        for batch in batches:
            for at, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if at != leaf and leaf is not None:
                    yield from settle()
                    yield from rows(found[0])
                    members, found = None, []
                leaf = at
                held.append(tuple(block))
                size += 0 if block[0] else len(block[2]) // 4
                if size >= VISITORS:
                    yield from settle()
        if leaf is not None:
            yield from settle()
            yield from rows(found[0])

    return run


def nearest(df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 10, least: float = 0.85, recall: float = 0.998, leaf_size: int | None = None, branch: int = 512, most: int = 8, sample: int | None = None, calibrate: int = CALIBRATE, part: int = PART) -> DataFrame:
    """For every vector its k most similar others: id, other, sim (cosine in double precision, rounded to 6 places).

    Ties go to the smaller id; of the k only those with sim >= least are rows. Vectors that are null, of another
    length, not finite or all zero don't count, nor rows without id (BIGINT). An id counts once; should it come with
    different vectors, the more similar one of each pair counts. An empty table gives no rows. Every row is indexed
    and every row is a query; `recall` is the share of true pairs that the search is widened to, on the calibrating
    vectors. `most` leaves are visited at most unless that share needs more: then as many more as it takes. Other columns
    are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<float>").alias("vec")).where(f"id IS NOT NULL AND size(vec) = {dim}")
    n = max(1, df.count())
    leaf_size = leaf_size or int(min(MOST_LEAF, max(LEAST_LEAF, LEAF_ROOT * n**0.5)))
    sample = sample or min(SAMPLE_MOST, max(SAMPLE, n // SAMPLE_ONE_IN))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.withColumn("chance", chance).where(F.col("chance") < min(1.0, 0.95 * sample / n)).select("id", "vec", "chance").toArrow()
    at, x = _vectors(drawn.column("vec").combine_chunks(), dim)
    ids, chance_of = drawn.column("id").to_numpy()[at], drawn.column("chance").to_numpy()[at]
    _, first = np.unique(ids, return_index=True)
    ids, x, chance_of = ids[first], x[first], chance_of[first]
    tree = Tree.fit(_unit(x), max(4.0, leaf_size * len(x) / n), branch)
    margin, most = _calibrated(spark, rows, tree, ids, x, chance_of, dim, k, least, recall, most, calibrate) if tree.count[0] else (0.0, most)
    parts = _parts(tree, x, n, part)
    sent = spark.sparkContext.broadcast((tree, margin, most, parts))
    blocks = rows.mapInArrow(_spread(sent, dim), "leaf INT, home BOOLEAN, vecs BINARY, counts BINARY, ids BINARY")
    blocks = blocks.repartition(shuffle_partitions(spark), "leaf").sortWithinPartitions("leaf", F.desc("home"))
    found = blocks.mapInArrow(_leaf_neighbours(dim, k, least), "id BIGINT, other BIGINT, sim DOUBLE")
    merged = found.repartition(shuffle_partitions(spark), "id").groupBy("id", "other").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _parts(tree: Tree, x: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each node the number of parts that its members are split into, by the share of the sample in it."""
    _, leaf, _ = tree.search(_unit(x), 0.0, 1)
    share = np.bincount(leaf, minlength=len(tree.count)) / max(1, len(x))
    return np.maximum(1, np.ceil(share * n / size)).astype(np.int64)


def _calibrated(spark, rows: DataFrame, tree: Tree, ids: np.ndarray, x: np.ndarray, chance: np.ndarray, dim: int, k: int, least: float, recall: float, most: int, calibrate: int) -> tuple[float, int]:
    """The margin within which the share `recall` of the true pairs of the calibrating vectors is found, and the leaves to
    visit at most for it. More vectors are drawn until there are enough pairs that one of them is the share left out; if
    the sample has too few, nothing is known of what is missed, and all leaves are visited."""
    order, enough = np.argsort(chance, kind="stable"), 1 / max(1e-9, 1 - recall) - 1e-6
    done, pairs, ends = 0, 0, []
    while pairs < enough and done < len(order):
        use = order[done : max(calibrate, 4 * done)]
        sent = spark.sparkContext.broadcast((ids[use], x[use]))
        near = rows.mapInArrow(_brute(sent, dim, k, least), "q BIGINT, id BIGINT, sim DOUBLE, vec BINARY")
        near = near.groupBy("q", "id").agg(F.max(F.struct("sim", "vec")).alias("s")).select("q", "id", "s.*")
        w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
        near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "vec").toPandas()
        ends.append((x[use][near.q.to_numpy(dtype=np.int64)], np.frombuffer(b"".join(near.vec), np.float32).reshape(-1, dim)))
        done, pairs = done + len(use), pairs + len(near)
    if pairs < enough:
        return np.inf, tree.leaves
    return _margin(tree, *map(np.concatenate, zip(*ends)), recall, most)


def _margin(tree: Tree, a: np.ndarray, b: np.ndarray, recall: float, most: int) -> tuple[float, int]:
    """The margin and the most visits within which the share `recall` of the pairs of rows of a and b is found. Visits
    are doubled until that share is within reach; with all leaves every pair is."""
    share = min(len(a) - 1, int(np.ceil(recall * len(a))))
    a, b = _unit(a), _unit(b)
    while True:
        visits, homes = [tree.search(end, np.inf, most) for end in (a, b)], []
        for q, leaf, _ in visits:
            order = np.argsort(q, kind="stable")
            homes.append(leaf[order][_rank(q[order]) == 0])
        needed = np.full(len(a), np.inf)
        for (q, leaf, far), home in zip(visits, reversed(homes)):
            hit = leaf == home[q]
            needed[q[hit]] = np.minimum(needed[q[hit]], far[hit])
        wanted = np.sort(needed)[share]
        if np.isfinite(wanted) or most >= tree.leaves:
            return float(wanted), most
        most = min(2 * most, tree.leaves)


def neighbour_pairs(df: DataFrame, id_col: str, vector_col: str, **options) -> DataFrame:
    """Pairs (vec_a, vec_b), vec_a < vec_b, of which at least one is among the nearest of the other; see nearest."""
    near = nearest(df, id_col, vector_col, **options)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()
