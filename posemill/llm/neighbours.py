"""Most similar vectors for every vector: NN-descent on blocks, started from random projection trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.runtime import Scratch, ship

ship(__name__)

_EDGE = np.dtype([("id", "<i8"), ("part", "<i4"), ("sim", "<f2"), ("new", "i1")])
"""A neighbour, its home block, the cosine, and how new it is: 2 if no round has joined over it yet, 1 after one round, then 0."""
_BEAM = np.dtype([("id", "<i8"), ("sim", "<f4"), ("done", "i1")])
_NONE = np.float32(-2)


# ---- worker side: numpy on Arrow tables ------------------------------------------------------------------------------


def _packed(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as one binary value per row."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.ChunkedArray | pa.Array, dtype: np.dtype | str) -> np.ndarray:
    """Binary values of one length each, back as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(n, -1)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _leaf_of(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Leaf of every row in a complete tree whose node i splits on x.planes[i] < cuts[i]."""
    node = np.zeros(len(x), np.int64)
    while len(planes) and node[0] < len(planes) if len(node) else False:
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, planes[node]) >= cuts[node])
    return (node - len(planes)).astype(np.int32)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors from the fourth column on, and which rows have one."""
    x = np.empty((batch.num_rows, batch.num_columns - 3), np.float32)
    for j in range(3, batch.num_columns):
        x[:, j - 3] = batch.column(j).to_numpy(zero_copy_only=False)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return (x[ok] / norm[ok, None]).astype(np.float32), ok


def _collapse(ids: np.ndarray, groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions, in the order of ids, of the rows that stand for all exact copies (same group, same key of the raw vector): those of smallest id."""
    order = np.lexsort((ids, keys, groups))
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(groups[order]) != 0) | (np.diff(keys[order]) != 0)
    first = order[new]
    return first[np.argsort(ids[first], kind="stable")]


@dataclass(frozen=True)
class _Cells:
    """A tree and, where its leaves would hold too many rows, further cuts of every leaf at the medians along common directions.

    The tree is bounded by the sample it is fitted on; the further cuts take a number per leaf and direction, so
    cells stay small however many rows there are.
    """

    planes: np.ndarray
    cuts: np.ndarray
    directions: np.ndarray
    medians: np.ndarray

    def count(self) -> int:
        return (len(self.planes) + 1) << len(self.directions)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        return _leaf_of(x, self.planes, self.cuts)

    def inner(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Which of the parts of its leaf a row is in."""
        if not len(self.directions):
            return np.zeros(len(x), np.int64)
        return ((x @ self.directions.T >= self.medians[leaf]) << np.arange(len(self.directions))).sum(1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        leaf = self.leaf(x)
        return (leaf + (len(self.planes) + 1) * self.inner(x, leaf)).astype(np.int32)

    def reached(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that may hold a vector within ``radius`` of a row."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        width = radius * np.sqrt((self.planes**2).sum(1))
        while len(node) and node[0] < len(self.planes):
            off = np.einsum("ij,ij->i", x[row], self.planes[node]) - self.cuts[node]
            left, right = off < width[node], off >= -width[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        leaf = node - len(self.planes)
        cell = leaf.copy()
        for i, d in enumerate(self.directions):
            off, wide = x[row] @ d - self.medians[leaf, i], radius * float(np.sqrt((d * d).sum()))
            low, high = off < wide, off >= -wide
            step = (len(self.planes) + 1) << i
            row, leaf, cell = np.concatenate([row[low], row[high]]), np.concatenate([leaf[low], leaf[high]]), np.concatenate([cell[low], cell[high] + step])
        return row, cell.astype(np.int32)


@dataclass(frozen=True)
class _Mixed:
    """Blocks of a tree whose rows are mostly of few groups: how many parts each is cut into, in how many of them a row of
    another group goes, and which (block, group) are dealt out. ``only`` these blocks are of interest."""

    parts: np.ndarray
    copies: np.ndarray
    hot: np.ndarray
    only: bool = False

    def deal(self, block: np.ndarray, groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, one for each part a row goes to, and the numbers of these parts; parts of all blocks are counted through.
        Exact copies go the same ways."""
        many, times, first = self.parts[block], self.copies[block], (np.cumsum(self.parts) - self.parts)[block]
        key = np.empty(len(keys), self.hot.dtype)
        key["block"], key["grp"] = block, groups
        times = np.where(np.isin(key, self.hot), 1, times)
        if self.only:
            times = np.where(np.isin(block, self.hot["block"]), times, 0)
        row = np.repeat(np.arange(len(keys)), times)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        at = ((keys ^ groups).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return row, (first[row] + (at[row] + turn) % many[row]).astype(np.int32)


def _locator(cells: _Cells) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (home block, id, group, key, unit vector in half precision); copies inside a batch collapse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _vectors(batch)
            if not len(x):
                continue
            ids, groups = batch.column(0).to_numpy()[ok], batch.column(1).to_numpy()[ok]
            keys, half = batch.column(2).to_numpy()[ok], x.astype(np.float16)
            first = _collapse(ids, groups, keys)
            ids, groups, keys, half = ids[first], groups[first], keys[first], half[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.cell(half.astype(np.float32))), pa.array(ids), pa.array(groups), pa.array(keys), _packed(half)], names=["home", "id", "grp", "key", "vec"]
            )

    return run


def _router(cells: _Cells, mixed: _Mixed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Located rows with their block of another tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            x = _unpacked(t["vec"], np.float16).astype(np.float32)
            leaf = cells.leaf(x)
            row, part = mixed.deal(leaf, _longs(t["grp"]), _longs(t["key"]))
            block = part + int(mixed.parts.sum()) * cells.inner(x, leaf)[row]
            taken = t.take(pa.array(row)).combine_chunks()
            yield from pa.table([pa.array((block % (2**31 - 1)).astype(np.int32)), *taken.columns], names=["block", *taken.column_names]).to_batches()

    return run


def _top(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the m largest of every row, in any order. A column's number rides in the bits that a single leaves free in a
    double: numbers are partitioned several times faster than positions."""
    free = np.int64((1 << 29) - 1)
    wide = s.astype(np.float64)
    np.negative(wide, out=wide)
    bits = wide.view(np.int64)
    bits |= np.arange(s.shape[1])
    wide.partition(m - 1, axis=1)
    bits = bits[:, :m]
    return bits & free, -(bits & ~free).view(np.float64).astype(np.float32)


def _falling(half: np.ndarray) -> np.ndarray:
    """Numbers of 16 bits that fall as the half precision values rise; the same again gives their bits back."""
    bits = half.view(np.uint16)
    return (bits ^ np.where(bits >> 15, 0, 0x7FFF).astype(np.uint16)).astype(np.uint64)


def _turns(x: np.ndarray) -> np.ndarray:
    """The how-manieth of its run every element of a sorted array is, from 0."""
    at = np.arange(len(x))
    begin = np.zeros(len(x), np.int64)
    begin[1:] = np.where(x[1:] != x[:-1], at[1:], 0)
    return at - np.maximum.accumulate(begin)


def _merge(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Positions (rows x k) of the k most similar distinct ids of every row; empty slots have sim -2."""
    order = np.argsort(ids, 1, kind="stable")
    sorted_ids = np.take_along_axis(ids, order, 1)
    again = np.zeros_like(sorted_ids, bool)
    again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    s = np.take_along_axis(sims, order, 1)
    s[again] = _NONE
    best = np.argpartition(-s, min(k, s.shape[1]) - 1, 1)[:, :k]
    out = np.take_along_axis(order, best, 1)
    # a repeated id that was masked may fill an empty slot: give it the mark of an empty one
    return np.where(np.take_along_axis(s, best, 1) <= _NONE, -1, out)


def _best_of(local: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = _merge(local, sims, k)
    got = np.take_along_axis(local, np.maximum(at, 0), 1), np.take_along_axis(sims, np.maximum(at, 0), 1)
    return np.where(at < 0, -1, got[0]), np.where(at < 0, _NONE, got[1])


def _others(groups: np.ndarray) -> int:
    """Rows outside the largest group; groups are small numbers."""
    return len(groups) - int(np.bincount(groups).max()) if len(groups) else 0


def _halves(p: np.ndarray, groups: np.ndarray, need: int) -> tuple[float, bool]:
    """Where to cut projected rows, and whether both sides then have ``need`` rows outside their largest group.

    The cut is the median; where one group has more than a fifth of the rows, all of it weighs as much as a quarter of the rest,
    so that it stays together with the rows of other groups next to it instead of being cut into pieces of its own.
    """
    counts = np.bincount(groups)
    top = int(counts.argmax())
    rest = len(p) - int(counts[top])
    if 4 * counts[top] <= rest:
        cut = np.median(p)
    else:
        order = np.argsort(p, kind="stable")
        total = np.cumsum(np.where(groups == top, rest / 4 / counts[top], 1.0)[order])
        cut = p[order[min(np.searchsorted(total, total[-1] / 2), len(p) - 1)]]
    left = p < cut
    return float(cut), min(_others(groups[left]), _others(groups[~left])) >= need


def _leaves(x: np.ndarray, groups: np.ndarray, idx: np.ndarray, size: int, need: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Leaves of at most ``size`` rows, of which a group that prevails counts as a quarter of the others; a node that no tried
    plane cuts into two with ``need`` rows of other groups each is a leaf, whatever its size."""
    todo = [idx]
    while todo:
        idx = todo.pop()
        others = _others(groups[idx])
        if len(idx) <= size or min(len(idx), others + others // 4) <= size and others < 4 * len(idx) // 5:
            yield idx
            continue
        for _ in range(4):
            a, b = rng.choice(len(idx), 2, replace=False)
            p = x[idx] @ (x[idx[a]] - x[idx[b]])
            cut, fine = _halves(p, groups[idx], need)
            left = p < cut
            if not left.any() or left.all():
                left = rng.random(len(idx)) < 0.5
                fine = min(_others(groups[idx[left]]), _others(groups[idx[~left]])) >= need
            if fine:
                todo += [idx[left], idx[~left]]
                break
        else:
            yield idx


def _forest(x: np.ndarray, groups: np.ndarray, k: int, trees: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k nearest of other groups among the rows that share a leaf with it, over several random projection trees."""
    n = len(x)
    groups = np.unique(groups, return_inverse=True)[1]
    count = trees if n > leaf else 1
    best, sims = np.full((n, count * k), -1, np.int32), np.full((n, count * k), _NONE, np.float32)
    rng = np.random.default_rng(seed)
    for tree in range(count):
        whole = False
        for idx in _leaves(x, groups, np.arange(n), leaf, max(k, leaf // 16), rng):
            whole = len(idx) == n
            large = np.flatnonzero(np.bincount(groups[idx]) > leaf) if len(idx) > leaf else []
            # rows of a group too large for a leaf meet only the rows of the others
            for own in [*large, None] if len(large) else [None]:
                rows = idx[~np.isin(groups[idx], large)] if own is None else idx[groups[idx] == own]
                seen = idx if own is None else idx[groups[idx] != own]
                m = min(k, len(seen))
                if not m:
                    continue
                step = max(1, max(leaf * leaf, 1 << 20) // len(seen))
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    s = x[at] @ x[seen].T
                    if own is None:
                        _mask_groups(s, groups[at], groups[seen])
                    top, s = _top(s, m)
                    best[at, tree * k : tree * k + m] = np.where(s > _NONE, seen[top], -1)
                    sims[at, tree * k : tree * k + m] = s
        if whole:
            break  # every other tree would give the same
    step = 1 << 14
    for lo in range(0, n, step):
        best[lo : lo + step, :k], sims[lo : lo + step, :k] = _best_of(best[lo : lo + step], sims[lo : lo + step], k)
    return best[:, :k], sims[:, :k]


def _mask_groups(s: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Takes the similarities of rows and columns of one group out, group by group where few are repeated."""
    order = np.argsort(columns, kind="stable")
    sorted_ = columns[order]
    low, high = np.searchsorted(sorted_, rows), np.searchsorted(sorted_, rows, side="right")
    if int((high - low).sum()) > s.size // 8:
        s[rows[:, None] == columns[None, :]] = _NONE
        return
    many = high - low
    at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    s[np.repeat(np.arange(len(rows)), many), order[at]] = _NONE


def _edges(near: np.ndarray, sims: np.ndarray, ids: np.ndarray, home: np.ndarray) -> np.ndarray:
    out = np.zeros(near.shape, _EDGE)
    out["id"], out["part"], out["sim"], out["new"] = np.where(near < 0, -1, ids[near]), np.where(near < 0, -1, home[near]), sims, 2
    return out


def _block_forest(k: int, trees: int, leaf: int) -> Callable[[pa.Table], pa.Table]:
    """Neighbours found in one block of another tree, addressed to the home block of every row."""

    def run(t: pa.Table) -> pa.Table:
        ids, groups, home = _longs(t["id"]), _longs(t["grp"]), _longs(t["home"])
        x = _unpacked(t["vec"], np.float16)
        first = _collapse(ids, groups, _longs(t["key"]))
        ids, groups, home, x = ids[first], groups[first], home[first], x[first].astype(np.float32)
        near, sims = _forest(x, groups, k, trees, leaf, 1 + int(t["block"][0].as_py()))
        return pa.table([pa.array(home), pa.array(ids), _packed(_edges(near, sims, ids, home))], names=["home", "id", "edges"])

    return run


def _with_incoming(ids: np.ndarray, own: np.ndarray, incoming_ids: np.ndarray, incoming: np.ndarray, k: int, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Own edges merged with those that arrived (several rows per id); also how many edges changed per id. Own edges age by a round, unless ``first``."""
    order = np.argsort(ids)
    at = order[np.searchsorted(ids, incoming_ids, sorter=order)] if len(incoming_ids) else np.zeros(0, np.int64)
    by = np.argsort(at, kind="stable")
    at, incoming = at[by], incoming[by]
    turn = _turns(at)
    out = own.copy()
    if not first:
        out["new"] = np.maximum(out["new"] - 1, 0)
    for r in range(int(turn.max()) + 1 if len(turn) else 0):
        rows = at[turn == r]
        both = np.concatenate([out[rows], incoming[turn == r]], 1)
        pos = _merge(both["id"], np.where(both["id"] < 0, _NONE, both["sim"].astype(np.float32)), k)
        merged = np.take_along_axis(both, np.maximum(pos, 0), 1)
        merged[pos < 0] = (-1, -1, _NONE, 0)
        out[rows] = merged
    fresh = np.zeros(len(ids), np.int32)
    touched = at[turn == 0]
    if len(touched):
        same = (out["id"][touched][:, :, None] == own["id"][touched][:, None, :]).any(2)
        fresh[touched] = (~same).sum(1)
    return out, fresh


def _graph_table(home: int, ids: np.ndarray, groups: np.ndarray, half: np.ndarray, edges: np.ndarray, fresh: np.ndarray) -> pa.Table:
    return pa.table(
        [pa.array(np.full(len(ids), home, np.int32)), pa.array(ids), pa.array(groups), _packed(half), _packed(edges), pa.array(fresh)],
        names=["home", "id", "grp", "vec", "edges", "fresh"],
    )


def _home_forest(k: int, trees: int, leaf: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """First graph of a home block: its own forest merged with what other trees' blocks found."""

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        ids, groups, half = _longs(t["id"]), _longs(t["grp"]), _unpacked(t["vec"], np.float16)
        first = _collapse(ids, groups, _longs(t["key"]))
        ids, groups, half = ids[first], groups[first], half[first]
        home = int(t["home"][0].as_py())
        near, sims = _forest(half.astype(np.float32), groups, k, trees, leaf, -1 - home & 0xFFFF)
        own = _edges(near, sims, ids, np.full(len(ids), home, np.int32))
        edges, fresh = _with_incoming(ids, own, _longs(found["id"]) if len(found) else np.zeros(0, np.int64), _unpacked(found["edges"], _EDGE), k, first=True)
        return _graph_table(home, ids, groups, half, edges, fresh)

    return run


def _spread(t: pa.Table, edges: np.ndarray, members: int) -> pa.Table:
    """Each row to its home block with all its edges, and to every block it has neighbours in over edges of the last two rounds with these edges.

    Of the edges that lead from these rows to one and the same row elsewhere, the ``members`` most similar go: the join there
    looks at no more, and a row that very many rows list does not gather them all.
    """
    home = _longs(t["home"])
    away = np.where((edges["part"] == home[:, None]) | (edges["new"] == 0), -1, edges["part"])
    at = np.flatnonzero(away.ravel() >= 0)
    by = at[np.lexsort((-edges["sim"].ravel()[at].astype(np.float32), edges["id"].ravel()[at]))]
    listed = edges["id"].ravel()[by]
    over = by[np.arange(len(by)) - np.searchsorted(listed, listed) >= members]
    away.ravel()[over] = -1
    kept = edges["new"] != 0
    kept.ravel()[over] = False
    away = np.sort(away, 1)
    new = away >= 0
    new[:, 1:] &= away[:, 1:] != away[:, :-1]
    row, col = np.nonzero(new)
    target = away[row, col]
    sent = edges[row]
    outside = (sent["part"] != target[:, None]) | ~kept[row]
    sent["id"][outside], sent["sim"][outside] = -1, 0
    weakest = np.where(edges["id"] < 0, _NONE, edges["sim"].astype(np.float32)).min(1)
    rows = np.concatenate([np.arange(len(home)), row])
    both = np.concatenate([edges, sent])
    take = pa.array(rows)
    return pa.table(
        [
            pa.array(np.concatenate([home, target]).astype(np.int32)), *[t[c].combine_chunks().take(take) for c in ("home", "id", "grp", "vec")],
            _packed(np.ascontiguousarray(both["id"])), _packed(np.ascontiguousarray(both["sim"])), _packed(np.ascontiguousarray(both["new"])), pa.array(weakest[rows]),
        ],
        names=["block", "home", "id", "grp", "vec", "ids", "sims", "news", "weakest"],
    )


def _spread_to(members: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                yield from _spread(t, _unpacked(t["edges"], _EDGE), members).to_batches()

    return run


def _local_join(k: int, members: int) -> Callable[[pa.Table], pa.Table]:
    """Compare the neighbours (both directions) of every row at home in a block with one another, unless neither of two is new.

    Emits, per row, at most k candidates that beat its weakest neighbour.
    """

    def run(t: pa.Table) -> pa.Table:
        block = int(t["block"][0].as_py())
        ids, groups, home = _longs(t["id"]), _longs(t["grp"]), _longs(t["home"])
        x, weakest = _unpacked(t["vec"], np.float16).astype(np.float32), _longs(t["weakest"])
        near, sims, news = _unpacked(t["ids"], np.int64), _unpacked(t["sims"], np.float16), _unpacked(t["news"], np.int8)
        # what is sorted below is packed into numbers of 64 bits, as these are sorted many times faster than positions: rows of a block
        # (memory ends long before they have more than 23 bits), the cosine and how new an edge is
        n, bit = len(ids), np.uint64(1)
        order = np.argsort(ids)
        listed = np.flatnonzero(near.ravel() >= 0)
        spot = order[np.minimum(np.searchsorted(ids, near.ravel()[listed], sorter=order), n - 1)]
        known = ids[spot] == near.ravel()[listed]
        listed, dst = listed[known], spot[known]
        src = listed // near.shape[1]
        sim, recent = sims.ravel()[listed], news.ravel()[listed]
        pairs = np.sort(src * n + dst)
        active = np.zeros(n, bool)
        active[src[recent == 2]] = active[dst[recent == 2]] = True
        mine = (home == block) & active
        low = ((2 - recent).astype(np.uint64) << np.uint64(16)) | _falling(sim)
        both = np.concatenate([((p[ok] * n + o[ok]).astype(np.uint64) << np.uint64(18)) | low[ok] for p, o in ((src, dst), (dst, src)) for ok in [mine[p]]])
        both.sort()
        both = both[np.append(True, np.diff(both >> np.uint64(18)) != 0)] if len(both) else both
        pivot, other = np.divmod((both >> np.uint64(18)).astype(np.int64), n)
        both = ((pivot.astype(np.uint64) << np.uint64(16) | both & np.uint64(0xFFFF)) * np.uint64(n) + other.astype(np.uint64)) * np.uint64(2) + ((both >> np.uint64(16) & np.uint64(3)) == 0)
        both.sort()
        recent, both = both & bit == bit, both >> bit
        pivot, other = (both // np.uint64(n) >> np.uint64(16)).astype(np.int64), (both % np.uint64(n)).astype(np.int64)
        turn = _turns(pivot)
        inside = turn < members
        pivot, other, turn, recent = pivot[inside], other[inside], turn[inside], recent[inside]
        begin = np.flatnonzero(turn == 0)
        size = np.diff(np.append(begin, len(turn)))
        by = np.argsort(-size, kind="stable")  # pivots of like size together, so that little of a chunk is padding
        begin, size = begin[by], size[by]
        bound = np.where(np.arange(len(ids) + 1) < len(ids), np.append(weakest, np.inf), np.inf).astype(np.float32)
        padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        got: list[np.ndarray] = []
        lo = 0
        while lo < len(begin) and size[lo] > 1:
            width = int(size[lo])
            hi = min(len(begin), lo + max(1, (1 << 21) // width**2))
            slot = begin[lo:hi, None] + np.arange(width)
            m = np.where(np.arange(width) < size[lo:hi, None], other[np.minimum(slot, len(other) - 1)], len(ids))
            v = padded[m]
            met = v @ v.transpose(0, 2, 1)
            better = met > bound[m][:, :, None]
            r = recent[np.minimum(slot, len(other) - 1)]
            if not r.all():
                better &= r[:, :, None] | r[:, None, :]
            at = np.flatnonzero(better)
            row = at // width
            a, b, s = m.ravel()[row], m.ravel()[row // width * width + at - row * width], met.ravel()[at]
            ok = (a != b) & (b < n)
            a, b, s = a[ok], b[ok], s[ok]
            ok = groups[a] != groups[b]
            got.append(((a[ok] * n + b[ok]).astype(np.uint64) << np.uint64(16)) | _falling(s[ok].astype(np.float16)))
            lo = hi
        found = np.concatenate(got) if got else np.zeros(0, np.uint64)
        got.clear()
        found.sort()
        key = (found >> np.uint64(16)).astype(np.int64)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        key, found = key[fresh], found[fresh]
        if len(pairs):
            fresh = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] != key
            key, found = key[fresh], found[fresh]
        a, b = np.divmod(key, n)
        found = (a.astype(np.uint64) << np.uint64(16) | found & np.uint64(0xFFFF)) * np.uint64(n) + b.astype(np.uint64)
        found.sort()
        a, b = found // np.uint64(n), (found % np.uint64(n)).astype(np.int64)
        s, a = _falling((a & np.uint64(0xFFFF)).astype(np.uint16)).astype(np.uint16).view(np.float16), (a >> np.uint64(16)).astype(np.int64)
        turn = _turns(a)
        a, b, s, turn = a[turn < k], b[turn < k], s[turn < k], turn[turn < k]
        rows, at = a[turn == 0], np.cumsum(turn == 0) - 1
        out = np.zeros((len(rows), k), _EDGE)
        out["id"], out["part"], out["sim"], out["new"] = -1, -1, _NONE, 2
        out["id"][at, turn], out["part"][at, turn], out["sim"][at, turn] = ids[b], home[b], s
        return pa.table([pa.array(home[rows]), pa.array(ids[rows]), _packed(out)], names=["home", "id", "edges"])

    return run


def _take_in(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The next graph of a home block: its rows' edges merged with the candidates sent to it."""

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        ids, own = _longs(t["id"]), _unpacked(t["edges"], _EDGE)
        edges, fresh = _with_incoming(ids, own, _longs(found["id"]) if len(found) else np.zeros(0, np.int64), _unpacked(found["edges"], _EDGE), k)
        return pa.table([t["home"], pa.array(ids), t["grp"], t["vec"], _packed(edges), pa.array(fresh)], names=["home", "id", "grp", "vec", "edges", "fresh"])

    return run


def _listed(k: int, at_least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            edges = _unpacked(t["edges"], _EDGE)
            edges = np.take_along_axis(edges, np.lexsort((-edges["id"], _falling(edges["sim"])))[:, :k], 1)
            row, rank = np.nonzero((edges["id"] >= 0) & (edges["sim"] >= at_least))
            e = edges[row, rank]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_longs(t["id"])[row]), pa.array((rank + 1).astype(np.int32)), pa.array(e["id"]), pa.array(e["sim"].astype(np.float32))],
                names=["id", "rank", "neighbour", "similarity"],
            )

    return run


def _dealt(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the hash of the id, as ids may have any step."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _full(at_least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows all of whose edges are at least so similar: they may have more such neighbours than edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                edges = _unpacked(t["edges"], _EDGE)
                whole = ((edges["id"] >= 0) & (edges["sim"] >= at_least)).all(1)
                yield pa.RecordBatch.from_arrays([pa.array(_longs(t["id"])[whole])], names=["id"])

    return run


def _visit(cells: _Cells, radius: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, once for every cell in which a neighbour within the radius may be at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch]).select(["id", "grp", "vec"])
                row, cell = cells.reached(_unpacked(t["vec"], np.float16).astype(np.float32), radius)
                yield from pa.table([pa.array(cell), *t.take(pa.array(row)).combine_chunks().columns], names=["cell", "id", "grp", "vec"]).to_batches()

    return run


def _meet(at_least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Every pair of a visitor and a row at home that are of different groups and at least so similar."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(asked) and len(rows):
            q, x = (_unpacked(t["vec"], np.float16).astype(np.float32) for t in (asked, rows))
            qg, xg, qi, xi = _longs(asked["grp"]), _longs(rows["grp"]), _longs(asked["id"]), _longs(rows["id"])
            step = max(1, (1 << 23) // len(x))
            for lo in range(0, len(q), step):
                i, j = np.nonzero((q[lo : lo + step] @ x.T >= at_least) & (qg[lo : lo + step, None] != xg[None, :]))
                found.append((qi[lo + i], xi[j]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(a), pa.array(b)], names=["id", "neighbour"])

    return run


def _enter(start_ids: np.ndarray, start_groups: np.ndarray, starts: np.ndarray, beam: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First beams of queries: the most similar of the entry points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _vectors(batch)
            if not len(x):
                continue
            ids, groups = batch.column(0).to_numpy()[ok], batch.column(1).to_numpy()[ok]
            sims = (x @ starts.T).astype(np.float32)
            sims[groups[:, None] == start_groups[None, :]] = _NONE
            top = np.argsort(-sims, 1, kind="stable")[:, :beam]
            out = np.zeros(top.shape, _BEAM)
            out["id"], out["sim"] = start_ids[top], np.take_along_axis(sims, top, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_dealt(ids, buckets)), pa.array(ids), pa.array(groups), _packed(x.astype(np.float16)), _packed(out)],
                names=["bucket", "query", "grp", "vec", "beam"],
            )

    return run


def _frontier(expand: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best members of every beam whose neighbours were not looked at yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            beam = _unpacked(t["beam"], _BEAM)
            open_ = (beam["done"] == 0) & (beam["sim"] > _NONE)
            row, col = np.nonzero(open_ & (np.cumsum(open_, 1) <= expand))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_longs(t["bucket"])[row]), pa.array(_longs(t["query"])[row]), pa.array(beam["id"][row, col])], names=["bucket", "query", "id"]
            )

    return run


def _step(beam: int, expand: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Beams of one bucket of queries after looking at the vectors their frontiers led to."""

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        query, groups, x, old = _longs(t["query"]), _longs(t["grp"]), _unpacked(t["vec"], np.float16).astype(np.float32), _unpacked(t["beam"], _BEAM).copy()
        open_ = (old["done"] == 0) & (old["sim"] > _NONE)
        old["done"][open_ & (np.cumsum(open_, 1) <= expand)] = 1
        row, ids, sims, done = (np.repeat(np.arange(len(query)), old.shape[1]), old["id"].ravel(), old["sim"].ravel(), old["done"].ravel())
        if len(found):
            order = np.argsort(query)
            at = order[np.searchsorted(query, _longs(found["query"]), sorter=order)]
            s = np.einsum("ij,ij->i", x[at], _unpacked(found["vec"], np.float16).astype(np.float32))
            s = np.where(_longs(found["grp"]) == groups[at], _NONE, s).astype(np.float32)
            row, ids, sims, done = (np.concatenate(c) for c in ((row, at), (ids, _longs(found["id"])), (sims, s), (done, np.zeros(len(at), done.dtype))))
        by = np.lexsort((-done.astype(np.int8), ids, row))
        row, ids, sims, done = row[by], ids[by], sims[by], done[by]
        new = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
        row, ids, sims, done = row[new], ids[new], sims[new], done[new]
        by = np.lexsort((ids, -sims, row))
        row, ids, sims, done = row[by], ids[by], sims[by], done[by]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        keep = turn < beam
        out = np.zeros((len(query), beam), _BEAM)
        out["id"], out["sim"], out["done"] = -1, _NONE, 1
        for name, values in (("id", ids), ("sim", sims), ("done", done)):
            out[name][row[keep], turn[keep]] = values[keep]
        return pa.table([t["bucket"], t["query"], t["grp"], t["vec"], _packed(out)], names=["bucket", "query", "grp", "vec", "beam"])

    return run


def _ranked(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            beam = _unpacked(t["beam"], _BEAM)[:, :k]
            row, rank = np.nonzero(beam["sim"] > _NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_longs(t["query"])[row]), pa.array((rank + 1).astype(np.int32)), pa.array(beam["id"][row, rank]), pa.array(beam["sim"][row, rank])],
                names=["query", "rank", "neighbour", "similarity"],
            )

    return run


# ---- driver side ------------------------------------------------------------------------------------------------------

_LOCATED = "home int, id long, grp long, key long, vec binary"
_GRAPH = "home int, id long, grp long, vec binary, edges binary, fresh int"
_FOUND = "home int, id long, edges binary"
_SPREAD = "block int, home int, id long, grp long, vec binary, ids binary, sims binary, news binary, weakest float"


@dataclass(frozen=True)
class NeighbourGraph:
    """vectors: home, id, grp, vec (unit vector in half precision); edges: id, edges (k records of id, block, cosine).

    cells are those of the home blocks, heavy the ones cut into several blocks (cell, parts), None where there are none.
    """

    vectors: DataFrame
    edges: DataFrame
    cells: _Cells
    heavy: DataFrame | None


def _fit_tree(x: np.ndarray, depth: int, rng: np.random.Generator, groups: np.ndarray | None = None, need: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Complete tree of median splits along differences of two sampled vectors.

    With ``groups``, a node is cut only where both sides keep ``need`` sampled rows outside their largest group.
    """
    groups = None if groups is None else np.unique(groups, return_inverse=True)[1]
    planes, cuts = np.zeros((2**depth - 1, x.shape[1] if x.ndim == 2 else 1), np.float32), np.zeros(2**depth - 1, np.float32)
    members = {0: np.arange(len(x))}
    for node in range(2**depth - 1):
        idx = members.pop(node)
        p = np.zeros(len(idx), np.float32)
        if len(idx) > 1:
            for _ in range(1 if groups is None else 4):
                a, b = rng.choice(idx, 2, replace=False)
                planes[node] = x[a] - x[b]
                p = x[idx] @ planes[node]
                cuts[node], fine = (np.median(p), True) if groups is None else _halves(p, groups[idx], need)
                if fine:
                    break
            else:
                planes[node], cuts[node] = 0, np.inf  # all go left
        members[2 * node + 1], members[2 * node + 2] = idx[p < cuts[node]], idx[p >= cuts[node]]
    return planes, cuts


def _cells(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], extra: int, rng: np.random.Generator) -> _Cells:
    """The tree with ``extra`` further cuts of every leaf; a leaf of few sampled rows is cut at the medians of all."""
    planes, cuts = tree
    directions = rng.normal(size=(extra, planes.shape[1])).astype(np.float32)
    p = x @ directions.T if extra and len(x) else np.zeros((len(x), extra), np.float32)
    medians = np.tile(np.median(p, 0) if len(p) and extra else np.zeros(extra), (len(planes) + 1, 1)).astype(np.float32)
    leaf = _leaf_of(x, planes, cuts) if len(x) else np.zeros(0, np.int32)
    for i in np.flatnonzero(np.bincount(leaf, minlength=len(medians)) >= 8) if extra else []:
        medians[i] = np.median(p[leaf == i], 0)
    return _Cells(planes, cuts, directions, medians)


def _counted(x: np.ndarray, groups: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, group) of the sampled rows, how many there are of each, and whether the group prevails: more than half of a block, and 8 rows."""
    block = _leaf_of(x, *tree)
    pair, counts = np.unique(np.rec.fromarrays([block, groups], dtype=[("block", "<i4"), ("grp", "<i8")]), return_counts=True)
    return pair, counts, (2 * counts > np.bincount(block, minlength=len(tree[0]) + 1)[pair["block"]]) & (counts >= 8)


def _mix(
    x: np.ndarray, groups: np.ndarray, home: tuple[np.ndarray, np.ndarray], tree: tuple[np.ndarray, np.ndarray], rows_each: float, block_rows: int, only: bool
) -> _Mixed:
    """How to deal out the blocks of a tree, judged by sampled rows that stand for ``rows_each`` rows: groups that prevail in a
    block of the tree or of the home tree, or have more than half of ``block_rows`` in a block."""
    at_home, _, first = _counted(x, groups, home)
    pair, counts, second = _counted(x, groups, tree)
    blocks, size = len(tree[0]) + 1, counts * rows_each
    hot = (np.isin(pair["grp"], np.concatenate([at_home["grp"][first], pair["grp"][second]])) & (counts >= 8)) | (size > block_rows / 2)
    dealt = np.bincount(pair["block"][hot], size[hot], blocks)
    other = np.bincount(pair["block"], size, blocks) - dealt
    parts = np.maximum(1, np.maximum(np.ceil(dealt / block_rows), np.ceil((dealt + other) / (2 * block_rows)))).astype(np.int64)
    # every part takes all other rows of the block, up to about block_rows of them
    copies = np.maximum(1, np.minimum(parts, parts * block_rows // np.maximum(other, 1))).astype(np.int64)
    return _Mixed(parts, copies, np.ascontiguousarray(pair[hot]).view(np.dtype([("block", "<i4"), ("grp", "<i8")])), only)


def _source(rows: DataFrame, record_id: str, group: str, vector: list[str]) -> DataFrame:
    return rows.where(F.col(record_id).isNotNull() & F.col(group).isNotNull()).select(
        F.col(record_id).cast("long").alias("id"), F.xxhash64(group).alias("grp"), F.xxhash64(*vector).alias("key"),
        *[F.col(c).cast("float").alias(f"v{i}") for i, c in enumerate(vector)]
    )


def neighbour_graph(
    rows: DataFrame, record_id: str, group: str, vector: list[str], k: int = 14, block_rows: int = 16_000, sample: int = 20_000,
    trees: int = 4, leaf: int = 512, members: int = 40, rounds: int = 6, settled: float = 0.02, seed: int = 7,
    mixing: int = 6, least_blocks: int = 16,
) -> NeighbourGraph:
    """k nearest neighbours by cosine, of another group, of every distinct vector.

    Start: two random projection trees, fitted on about ``sample`` (at most twice as many) sampled vectors, cut the collection into blocks of about
    ``block_rows``, at least ``least_blocks`` of them where they keep 1000 rows each so that all executors have work, with further cuts along common directions where the trees have too few leaves for that (_Cells); every row goes to
    its block of either tree, and inside a block ``trees`` further trees with leaves of at most ``leaf`` rows give first, rough
    neighbours. A home block of more than twice ``block_rows`` is dealt out by hash. A group that prevails somewhere is not cut off
    from the others: trees inside a block, and the second tree of blocks, cut only where rows of other groups stay on both sides, and a
    block too large for that is dealt out in parts, each with the rows of other groups. Blocks with such a group are made by ``mixing``
    trees instead of one, as its rows fill one another's home blocks.

    NN-descent then makes the graph: in each round every row joins the neighbours that list it and those it lists (at most
    ``members``), their vectors being shuffled once per block that needs them instead of once per pair, and improvements
    travel back to the block where a row is at home. It ends when fewer than ``settled`` of all edges changed, or after
    ``rounds``. Every row is indexed; only the trees are fitted on a sample.

    Exact copies (same group, same vector as given, by the hash that copies_of compares; multiples of a vector are none) collapse to the row of smallest id, within each batch before the shuffle, so a group
    of copies with a third of all rows is no hot block. Defined cases: rows with a null id or group, with a null, NaN or infinite
    component or a zero vector are left out; rows have fewer than k edges only where hardly any rows of other groups exist; an
    empty table gives no rows. Ids must not be negative. Other columns are ignored. Returns the graph table for
    neighbour_list, similar_pairs and greedy_search.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    source = _source(rows, record_id, group, vector)
    n = source.count()
    share = min(1.0, sample / max(n, 1))
    # by hash, so the sample and with it the graph is the same on any cluster
    picked = source.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    table = picked.toPandas().sort_values("id")
    drawn, kinds = table.iloc[:, 3:].to_numpy(np.float32), table["grp"].to_numpy(np.int64)
    norm = np.sqrt((drawn.astype(np.float64) ** 2).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    drawn, kinds = (drawn[ok] / norm[ok, None]).astype(np.float32), kinds[ok]
    distinct = np.sort(_collapse(np.arange(len(drawn)), kinds, table["key"].to_numpy(np.int64)[ok]))
    block_rows = min(block_rows, max(1000, n // least_blocks))
    depth = extra = 0
    while n > block_rows * 2**depth and 16 * 2 ** (depth + 1) <= max(len(drawn), 1):
        depth += 1
    while n > block_rows * 2 ** (depth + extra + 1) and len(drawn):
        extra += 1
    parts = n // (2 * block_rows)

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        """Rows in as many partitions as hold about two blocks each, where that is more than a shuffle has anyway."""
        return rows.repartition(parts, key) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows

    rng = np.random.default_rng(seed)
    first = _fit_tree(drawn, depth, rng)
    second = _fit_tree(drawn[distinct], depth, rng, kinds[distinct])
    home = _cells(drawn[distinct], first, extra, rng)
    located = scratch.cut(source.mapInArrow(_locator(home), _LOCATED), wide=True)
    heavy = None
    if n > 2 * block_rows:
        crowded = scratch.cut(located.groupBy("home").agg(F.count("*").alias("c")).where(F.col("c") > 2 * block_rows).select("home", F.ceil(F.col("c") / block_rows).cast("int").alias("parts")))
        if crowded.limit(1).count():
            heavy = crowded.withColumnRenamed("home", "cell")
            part = F.pmod(F.xxhash64("key", "grp"), F.coalesce("parts", F.lit(1)))
            last, located = located, scratch.cut(located.join(crowded, "home", "left").select(_home_of("home", part, home).alias("home"), "id", "grp", "key", "vec"))
            scratch.drop(last)
    if depth:
        found = None
        for i in range(mixing):
            tree = second if not i else _fit_tree(drawn[distinct], depth, rng, kinds[distinct])
            mixed = _mix(drawn[distinct], kinds[distinct], first, tree, n / max(len(drawn), 1), block_rows, i > 0)
            blocks = _cells(drawn[distinct], tree, extra, rng)
            here = dealt(located.mapInArrow(_router(blocks, mixed), f"block int, {_LOCATED}"), "block").groupBy("block").applyInArrow(_block_forest(k, trees, leaf), _FOUND)
            found = here if found is None else found.unionByName(here)
            if not len(mixed.hot):
                break
    else:
        found = spark.createDataFrame([], _FOUND)
    start = dealt(located, "home").groupBy("home").cogroup(dealt(found, "home").groupBy("home"))
    graph = scratch.cut(start.applyInArrow(_home_forest(k, trees if depth else 2 * trees, leaf), _GRAPH))
    scratch.drop(located)
    for _ in range(rounds):
        candidates = dealt(graph.drop("fresh").mapInArrow(_spread_to(members), _SPREAD), "block").groupBy("block").applyInArrow(_local_join(k, members), _FOUND)
        candidates = scratch.cut(candidates)  # before the graph is shuffled, so that the files of the two shuffles never lie side by side
        last, graph = graph, scratch.cut(dealt(graph, "home").groupBy("home").cogroup(dealt(candidates, "home").groupBy("home")).applyInArrow(_take_in(k), _GRAPH))
        scratch.drop(last, candidates)
        moved, total = graph.agg(F.sum("fresh"), F.count("*")).first()
        if not total or moved < settled * k * total:
            break
    return NeighbourGraph(graph.select("home", "id", "grp", "vec"), graph.select("id", "edges"), home, heavy)


def _home_of(cell: str, part: Column, cells: _Cells) -> Column:
    """Block of a part of a cell; where numbers run out two blocks may share one, which does no harm."""
    return F.pmod(F.col(cell).cast("long") + part * cells.count(), F.lit(2**31 - 1)).cast("int")


def neighbour_list(graph: NeighbourGraph, k: int, at_least: float = -1.0) -> DataFrame:
    """id, rank, neighbour, similarity (to about 0.0005, vectors being kept in half precision)."""
    return graph.edges.select("id", "edges").mapInArrow(_listed(k, at_least), "id long, rank int, neighbour long, similarity float")


def copies_of(rows: DataFrame, record_id: str, group: str, vector: list[str]) -> DataFrame:
    """(representative, member) for every row whose exact vector occurs again in its group; rows with a missing component have no copies."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in vector])
    keyed = rows.where(F.col(record_id).isNotNull() & F.col(group).isNotNull() & whole).select(
        F.col(record_id).cast("long").alias("member"), F.xxhash64(group).alias("g"), F.xxhash64(*vector).alias("h1"), F.xxhash64(F.lit(1), *vector).alias("h2")
    )
    key, scratch = ["g", "h1", "h2"], Scratch(rows.sparkSession, "copies")
    keyed = scratch.cut(keyed, wide=True)
    classes = keyed.groupBy(*key).agg(F.min("member").alias("representative"), F.count("*").alias("n")).where("n > 1")
    classes = scratch.cut(classes)
    return keyed.join(classes, key).select("representative", "member")


def _neighbours_of_full(graph: NeighbourGraph, at_least: float, scratch: Scratch, asked_rows: int = 1000) -> DataFrame | None:
    """(id, neighbour) of all rows that may have more neighbours of such a similarity than edges; None where there are none.

    Such a row visits every home block whose cell comes within the distance the similarity allows, so no neighbour is missed;
    a block with many visitors is met by ``asked_rows`` of them at a time.
    """
    full = scratch.cut(graph.edges.mapInArrow(_full(at_least), "id long"))
    if not full.limit(1).count():
        return None
    radius = float(np.sqrt(max(0.0, 2 - 2 * at_least))) + 0.003  # unit vectors of half precision
    asked = graph.vectors.join(full, "id", "left_semi").mapInArrow(_visit(graph.cells, radius), "cell int, id long, grp long, vec binary")
    part = F.lit(0)
    if graph.heavy is not None:
        asked = asked.join(graph.heavy, "cell", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        part = F.col("part")
    asked = scratch.cut(asked.select(_home_of("cell", part, graph.cells).alias("home"), "id", "grp", "vec").dropDuplicates(["home", "id"]))
    turns = asked.groupBy("home").agg(F.ceil(F.count("*") / asked_rows).cast("int").alias("turns"))
    rows = graph.vectors.join(turns, "home").select("home", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "grp", "vec")
    asked = asked.join(turns, "home").select("home", F.pmod(F.xxhash64("id"), "turns").cast("int").alias("turn"), "id", "grp", "vec")
    return asked.groupBy("home", "turn").cogroup(rows.groupBy("home", "turn")).applyInArrow(_meet(at_least), "id long, neighbour long")


def similar_pairs(rows: DataFrame, record_id: str, group: str, vector: list[str], graph: NeighbourGraph, at_least: float) -> DataFrame:
    """Pairs (id_a < id_b) of rows of different groups with a cosine of at least ``at_least``, from the graph.

    Rows all of whose edges are that similar may have more such neighbours than edges; theirs are looked up exactly in the
    blocks that can hold them (_neighbours_of_full), so the width of the graph cuts nothing off. Candidates within the
    rounding of half precision are computed again from the stored vectors in double precision; copies are added afterwards.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    near = neighbour_list(graph, 1 << 20, at_least - 0.004).select("id", "neighbour")
    more = _neighbours_of_full(graph, at_least - 0.004, scratch)
    near = near if more is None else near.unionByName(more)
    pairs = scratch.cut(near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct())
    x = rows.select(F.col(record_id).cast("long").alias("i"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(vector)])
    packed = x.select("i", F.array(*[f"v{i}" for i in range(len(vector))]).alias("v"))
    both = pairs.join(packed.select(F.col("i").alias("a"), F.col("v").alias("va")), "a").join(packed.select(F.col("i").alias("b"), F.col("v").alias("vb")), "b")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)
    exact = both.where(dot("va", "vb") >= F.lit(at_least) * F.sqrt(dot("va", "va") * dot("vb", "vb"))).select("a", "b")
    exact = scratch.cut(exact, wide=True)
    copies = scratch.cut(copies_of(rows, record_id, group, vector))
    left = exact.join(copies.withColumnRenamed("representative", "a").withColumnRenamed("member", "ma"), "a", "left")
    full = left.join(copies.withColumnRenamed("representative", "b").withColumnRenamed("member", "mb"), "b", "left")
    a, b = F.coalesce("ma", "a"), F.coalesce("mb", "b")
    return full.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))


def greedy_search(
    graph: NeighbourGraph, queries: DataFrame, record_id: str, group: str, vector: list[str], k: int, beam: int = 160, expand: int = 16, starts: int = 2048,
    rounds: int = 30, bucket_rows: int = 2000,
) -> DataFrame:
    """query, rank, neighbour, similarity: the k most similar indexed vectors of other groups for every query vector.

    Best-first search on the graph, all queries at once: each keeps a beam of the best vectors seen, and a round joins the neighbours
    of its best unexpanded members with their vectors. Searches start at the best of the entry points, a fixed
    sample of one in 16 indexed vectors (256 to ``starts`` of them, a few hundred kilobytes); they end when no beam has an unexpanded member, or after ``rounds``.

    Defined cases: queries with a null id or group, a missing component or a zero vector get no rows; an empty index or query set
    gives none; ids must not be negative. Other columns are ignored.
    """
    scratch = Scratch(queries.sparkSession, "search")
    starts = max(256, min(starts, graph.vectors.count() // 16))
    entry = graph.vectors.select("id", "grp", "vec").orderBy(F.xxhash64("id"), "id").limit(starts).toArrow()
    schema = "bucket int, query long, grp long, vec binary, beam binary"
    source = _source(queries, record_id, group, vector)
    if not len(entry):
        return queries.sparkSession.createDataFrame([], "query long, rank int, neighbour long, similarity float")
    buckets = max(1, -(-source.count() // bucket_rows))
    points = _unpacked(entry["vec"], np.float16).astype(np.float32)
    state = scratch.cut(source.mapInArrow(_enter(_longs(entry["id"]), _longs(entry["grp"]), points, beam, buckets), schema))
    links = graph.edges.mapInArrow(_neighbour_ids, "id long, near array<long>")
    for _ in range(rounds):
        frontier = scratch.cut(state.mapInArrow(_frontier(expand), "bucket int, query long, id long"))
        if not frontier.limit(1).count():
            break
        reached = frontier.join(links, "id").select("bucket", "query", F.explode("near").alias("id")).distinct()
        seen = reached.join(graph.vectors.select("id", "grp", "vec"), "id").select("bucket", "query", "id", "grp", "vec")
        last, state = state, scratch.cut(state.groupBy("bucket").cogroup(seen.groupBy("bucket")).applyInArrow(_step(beam, expand), schema))
        scratch.drop(last, frontier)
    return state.mapInArrow(_ranked(k), "query long, rank int, neighbour long, similarity float")


def _neighbour_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            near = [r[r >= 0] for r in _unpacked(t["edges"], _EDGE)["id"]]
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array(near, pa.list_(pa.int64()))], names=["id", "near"])
