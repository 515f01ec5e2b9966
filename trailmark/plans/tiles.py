"""Work on all pairs of rows, in tiles: rows fall into blocks by their keys, and a task holds one pair of blocks.

A row travels once for each block, so that what is shuffled grows as the rows do. Pairs are made,
summed up or searched inside a task, some hundred thousand at a time; they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 12  # blocks of a table, while a block is no larger than BLOCK_BYTES
BLOCK_BYTES = 32 << 20
ROWS, COLUMNS = 256, 1024  # of the piece of a tile that is worked on at once
CLOSE = 1e-6  # squared distances below this share of the squared norms are worked out from differences
INF = float("inf")

Run = Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]]


def tiled(items: DataFrame, carry: list[str], size: Column, run: Run, schema: str, block: int = 256, measured: DataFrame | None = None) -> DataFrame:
    """What ``run`` makes of every pair of blocks, the second None where a block meets itself. items: key and ``carry``; size: bytes of a row, of the items or of rows with the same keys that are ``measured`` in their place."""
    own = items.where("key is not null").select("key", *carry)
    n, total = (own if measured is None else measured).agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    blocks = max(1, min(-(-n // block), GRID), -(-total // BLOCK_BYTES))
    own = own.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_b", o).alias("_x"), F.greatest("_b", o).alias("_y")))
    dealt = own.withColumn("_p", F.explode(places)).select("_p._x", "_p._y", "_b", "key", *carry)
    dealt = dealt.repartitionById(blocks * (blocks + 1) // 2, F.expr(f"int(_x * ({2 * blocks} - _x - 1) div 2 + _y)"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        for x, y in sorted(set(zip(t["_x"].to_pylist(), t["_y"].to_pylist(), strict=True))):  # one, unless partitions were put together
            here = t.filter(pc.and_(pc.equal(t["_x"], x), pc.equal(t["_y"], y)))
            left, right = (here.filter(pc.equal(here["_b"], b)).drop_columns(["_x", "_y", "_b"]).combine_chunks() for b in (x, y))
            if left.num_rows and right.num_rows:
                yield from run(left, None if x == y else right)

    return dealt.mapInArrow(each, schema)


def coded(keys: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array | None]:
    """Numbers in the order of the keys; whole numbers stand for themselves, else the names by number come with them."""
    if pa.types.is_integer(keys[0].type):
        return [k.to_numpy() for k in keys], None
    d = pa.concat_arrays(keys).dictionary_encode()
    order = pc.array_sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.split(rank[d.indices.to_numpy()], np.cumsum([len(k) for k in keys])[:-1]), d.dictionary.take(pa.array(order))


def named(codes: np.ndarray, names: pa.Array | None, kind: pa.DataType) -> pa.Array:
    return pa.array(codes, kind) if names is None else names.take(pa.array(codes))


class Side:
    """Columns of the rows on one side of a tile, as arrays."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.columns = columns

    def __len__(self) -> int:
        return len(self.columns["code"])

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def part(self, lo: int, hi: int) -> Side:
        return Side({k: v[lo:hi] for k, v in self.columns.items()})

    def sorted_by(self, *names: str) -> Side:
        order = np.lexsort([self.columns[k] for k in reversed(names)])
        return Side({k: v[order] for k, v in self.columns.items()})


def column(t: pa.Table, name: str) -> np.ndarray:
    c = t[name].combine_chunks()
    if pa.types.is_list(c.type):
        c = np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), -1)
        return c
    return c.to_numpy(zero_copy_only=False)


def sides(left: pa.Table, right: pa.Table | None, carry: list[str], vector: str | None = None) -> tuple[Side, Side, pa.Array | None]:
    """Both sides with ``code``, the carried columns and, for a vector, what distances() needs."""
    tables = [t for t in (left, right) if t is not None]
    keys, names = coded([t["key"].combine_chunks() for t in tables])
    made = []
    for t, codes in zip(tables, keys, strict=True):
        own = {"code": codes} | {c: column(t, c) for c in carry}
        if vector:
            v = own[vector]
            sq, one = (v * v).sum(1), np.ones(len(v))
            own |= {vector: v, "v": v, "sq": sq, "row": np.column_stack([-2 * v, sq, one]), "col": np.column_stack([v, one, sq])}
        made.append(Side(own))
    return made[0], made[-1], names


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``, alike in both directions."""
    return np.concatenate([np.sqrt(((a[k : k + 16384] - b[k : k + 16384]) ** 2).sum(1)) for k in range(0, len(a), 16384)] or [np.zeros(0)])


def distances(p: Side, q: Side) -> np.ndarray:
    """Euclidean distances from one product of matrices; close pairs, where that is not exact, from differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        d = p["row"] @ q["col"].T
        if not d.min() > CLOSE * (p["sq"].max() + q["sq"].max()):
            r, c = np.nonzero(~(d > CLOSE * (p["sq"][:, None] + q["sq"][None, :])))
            d[r, c] = 0
            np.sqrt(d, out=d)
            for k in range(0, len(r), 65536):
                x, y = r[k : k + 65536], c[k : k + 65536]
                d[x, y] = exact(p["v"][x], q["v"][y])
            return d
        return np.sqrt(d, out=d)


def pieces(l: Side, r: Side, same: bool) -> Iterator[tuple[Side, Side, np.ndarray | None]]:  # noqa: E741
    """Pieces of a tile in which every pair is met once, and which of their cells are pairs (None: all)."""
    if same:
        l = r = l.sorted_by("code")  # noqa: E741
    for a in range(0, len(l), ROWS):
        p = l.part(a, a + ROWS)
        for c in range(a if same else 0, len(r), COLUMNS):
            q = r.part(c, c + COLUMNS)
            yield p, q, p["code"][:, None] < q["code"][None, :] if same and c < a + ROWS or same and p["code"][-1] >= q["code"][0] else None


def pair_batch(p: np.ndarray, q: np.ndarray, keep: np.ndarray | None, names: pa.Array | None, kind: pa.DataType, **values: np.ndarray) -> pa.RecordBatch:
    """i < j and values of the kept cells; p, q: codes of rows and columns."""
    i, j = np.minimum(p[:, None], q[None, :]), np.maximum(p[:, None], q[None, :])
    pick = (lambda x: x.ravel()) if keep is None else (lambda x: x[keep])
    return pa.RecordBatch.from_arrays([named(pick(i), names, kind), named(pick(j), names, kind), *(pa.array(pick(v)) for v in values.values())], ["i", "j", *values])


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded half away from zero, as SQL does."""
    if digits is None:
        return x
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**digits + 0.0  # no negative zero


def pair_rows(items: DataFrame, carry: list[str], size: Column, cell: Callable[[Side, Side], np.ndarray], name: str = "dist", vector: str | None = None, block: int = 256, digits: int | None = None, measured: DataFrame | None = None) -> DataFrame:
    """i, j and a number for every pair of keys i < j. items: key and ``carry``; cell: numbers of a piece."""
    kind = items.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        l, r, names = sides(left, right, carry, vector)  # noqa: E741
        for p, q, keep in pieces(l, r, right is None):
            yield pair_batch(p["code"], q["code"], keep, names, left["key"].type, **{name: rounded(cell(p, q), digits)})

    return tiled(items, carry, size, run, f"i {kind}, j {kind}, {name} double", block, measured)


def farthest(items: DataFrame, size: Column, vector: str, block: int = 256) -> float | None:
    """The largest finite distance of two keys."""

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        l, r, _ = sides(left, right, [vector], vector)  # noqa: E741
        top = -INF
        for p, q, keep in pieces(l, r, right is None):
            d = distances(p, q)
            d = d[np.isfinite(d) if keep is None else keep & np.isfinite(d)]
            top = max(top, float(d.max(initial=-INF)))
        if top > -INF:
            yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])

    return tiled(items, [vector], size, run, "top double", block).agg(F.max("top")).first()[0]


def best_pairs(items: DataFrame, carry: list[str], size: Column, cell: Callable[[Side, Side], tuple[np.ndarray, list[np.ndarray]]], names: list[str], most: int, vector: str | None = None, block: int = 256) -> DataFrame:
    """i, j and numbers of the best pairs of each tile, by the numbers from the highest on, then i and j. cell: which pairs of a piece count, and their numbers."""
    kind = items.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        l, r, known = sides(left, right, carry, vector)  # noqa: E741
        held = None
        for p, q, keep in pieces(l, r, right is None):
            fits, numbers = cell(p, q)
            fits = fits if keep is None else fits & keep
            if held is not None and len(held[0]) == most:
                fits = fits & (numbers[0] >= held[2][-1])
            x, y = np.nonzero(fits)
            if not len(x):
                continue
            new = [np.minimum(p["code"][x], q["code"][y]), np.maximum(p["code"][x], q["code"][y]), *(n[x, y] for n in numbers)]
            both = new if held is None else [np.concatenate(z) for z in zip(held, new, strict=True)]
            order = np.lexsort([both[1], both[0], *(-n for n in both[:1:-1])])[:most]
            held = [z[order] for z in both]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*(named(c, known, left["key"].type) for c in held[:2]), *map(pa.array, held[2:])], ["i", "j", *names])

    return tiled(items, carry, size, run, f"i {kind}, j {kind}, " + ", ".join(f"{n} double" for n in names), block)


def both_ways(l: Side, r: Side, same: bool) -> Iterator[tuple[Side, Side]]:  # noqa: E741
    """Each side against the other; a block that meets itself does so once."""
    yield l, r
    if not same:
        yield r, l


def runs(ids: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))


def group_sums(items: DataFrame, group: str, size: Column, vector: str, by_row: bool, block: int = 256, measured: DataFrame | None = None) -> DataFrame:
    """Sums and counts of the distances between rows and groups (key, own, other, s, n), or between groups (own, other, s, n; no nulls or NaN in them). items: key, vector, group."""
    kinds = {c: items.schema[c].dataType.simpleString() for c in ("key", group)}

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        same, kind = right is None, left["key"].type
        l, r, names = sides(left, right, [vector, group], vector)  # noqa: E741
        l = l.sorted_by(group)  # noqa: E741
        r = l if same else r.sorted_by(group)
        for a, b in both_ways(l, r, same):
            starts = runs(b[group])
            others, counts = b[group][starts], np.diff([*starts, len(b)])
            number = np.repeat(np.arange(len(starts)), counts)
            for k in range(0, len(a), ROWS):
                p = a.part(k, k + ROWS)
                s, n = np.zeros((len(p), len(starts))), np.zeros((len(p), len(starts)), np.int64)
                for c in range(0, len(b), COLUMNS):
                    q = b.part(c, c + COLUMNS)
                    d = distances(p, q)
                    at = runs(q[group])
                    here = slice(number[c], number[c] + len(at))
                    n[:, here] += np.diff([*at, len(q)])
                    out = p["code"][:, None] == q["code"][None, :] if same else None
                    if not by_row and np.isnan(d.sum()):
                        out = np.isnan(d) if out is None else out | np.isnan(d)
                    if out is not None and out.any():
                        d[out] = 0
                        n[:, here] -= np.add.reduceat(out, at, axis=1, dtype=np.int64)
                    s[:, here] += np.add.reduceat(d, at, axis=1)
                if by_row:
                    x, y = np.nonzero(n)
                    yield pa.RecordBatch.from_arrays([named(p["code"][x], names, kind), pa.array(p[group][x]), pa.array(others[y]), pa.array(s[x, y]), pa.array(n[x, y])], ["key", "own", "other", "s", "n"])
                else:
                    own = runs(p[group])
                    s, n = np.add.reduceat(s, own, axis=0), np.add.reduceat(n, own, axis=0)
                    x, y = np.nonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(p[group][own][x]), pa.array(others[y]), pa.array(s[x, y]), pa.array(n[x, y])], ["own", "other", "s", "n"])

    return tiled(items, [vector, group], size, run, ("key {key}, " if by_row else "").format(**kinds) + f"own {kinds[group]}, other {kinds[group]}, s double, n long", block, measured)


def near_rows(items: DataFrame, size: Column, vector: str, k: int, block: int = 256) -> DataFrame:
    """key, near: the distances of up to k nearest rows in each block. items: key, vector."""
    kind = items.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        l, r, names = sides(left, right, [vector], vector)  # noqa: E741
        for a, b in both_ways(l, r, right is None):
            for x in range(0, len(a), ROWS):
                p = a.part(x, x + ROWS)
                best, at = np.full((len(p), k), INF), np.full((len(p), k), -1)
                for c in range(0, len(b), COLUMNS):
                    q = b.part(c, c + COLUMNS)
                    d = distances(p, q)
                    if right is None:
                        d[p["code"][:, None] == q["code"][None, :]] = INF
                    rows = np.flatnonzero(~(d.min(1) >= best.max(1)))  # others have no nearer one here
                    if not len(rows):
                        continue
                    few = min(k, len(q))
                    first = np.argpartition(d[rows], few - 1, axis=1)[:, :few] if few < len(q) else np.tile(np.arange(len(q)), (len(rows), 1))
                    dist, where = np.hstack([best[rows], d[rows[:, None], first]]), np.hstack([at[rows], c + first])
                    pick = np.argpartition(dist, k - 1, axis=1)[:, :k]
                    best[rows], at[rows] = np.take_along_axis(dist, pick, 1), np.take_along_axis(where, pick, 1)
                there = (at >= 0) & (best < INF) if right is None else at >= 0
                row, col = np.nonzero(there)
                near = exact(p["v"][row], b["v"][at[row, col]])
                offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([named(p["code"], names, left["key"].type), pa.ListArray.from_arrays(pa.array(offsets), pa.array(near))], ["key", "near"])

    return tiled(items, [vector], size, run, f"key {kind}, near array<double>", block)


class _Pool:
    """Points that are not yet in a tree, each with the least edge to it: its weight, then its ends."""

    def __init__(self, side: Side) -> None:
        self.v, self.col, self.core, self.code = (side[k].copy() for k in ("v", "col", "core", "code"))
        self.n = len(self.code)
        self.best, self.lo, self.hi = np.full(self.n, INF), np.zeros(self.n, self.code.dtype), np.zeros(self.n, self.code.dtype)
        self.far = float(side["sq"].max())

    def least(self) -> int:
        best = self.best[: self.n]
        k = int(best.argmin())
        ties = np.flatnonzero(best == best[k])
        return k if len(ties) < 2 else int(ties[np.lexsort([self.hi[ties], self.lo[ties]])[0]])

    def take(self, k: int) -> tuple[np.ndarray, float, int]:
        out = self.v[k].copy(), float(self.core[k]), self.code[k]
        self.n -= 1
        for x in (self.v, self.col, self.core, self.code, self.best, self.lo, self.hi):
            x[k] = x[self.n]
        return out

    def reach(self, v: np.ndarray, core: float, code: int) -> None:
        n, best = self.n, self.best[: self.n]
        sq = float(v @ v)
        d = self.col[:n] @ np.concatenate([-2 * v, [sq, 1.0]])
        rough = np.maximum(np.maximum(np.sqrt(np.maximum(d, 0, out=d), out=d), self.core[:n]), core)
        at = np.flatnonzero(~(rough > best + 1e-7 * (self.far + sq) ** 0.5))  # these alone are worked out exactly
        if not len(at):
            return
        w = np.maximum(np.maximum(exact(self.v[at], v[None, :].repeat(len(at), 0)), self.core[at]), core)
        lo, hi, old = np.minimum(self.code[at], code), np.maximum(self.code[at], code), best[at]
        less = (w < old) | (w == old) & ((lo < self.lo[at]) | (lo == self.lo[at]) & (hi < self.hi[at]))
        at = at[less]
        self.best[at], self.lo[at], self.hi[at] = w[less], lo[less], hi[less]


def tile_tree(l: Side, r: Side | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """Minimum spanning tree of the mutual reachability within a side, or between two, by Prim's algorithm: codes i < j and weights. Equal weights are told apart by i and j."""
    pools = [_Pool(l)] if r is None else [_Pool(l), _Pool(r)]
    i, j, w = [], [], []
    side, point = 0, pools[0].take(0)
    while True:
        other = pools[(side + 1) % len(pools)]
        if other.n:
            other.reach(*point)
        tops = [(float(p.best[k]), p.lo[k], p.hi[k], s, k) for s, p in enumerate(pools) if p.n for k in (p.least(),)]
        if not tops:
            return np.array(i, l["code"].dtype), np.array(j, l["code"].dtype), np.array(w, float)
        weight, lo, hi, side, k = min(tops)
        if weight < INF:
            i.append(lo), j.append(hi), w.append(weight)
        point = pools[side].take(k)


def tree_edges(items: DataFrame, size: Column, vector: str, block: int = 256, measured: DataFrame | None = None) -> DataFrame:
    """i, j, reach: edges among which are those of a minimum spanning tree of the mutual reachability of all rows, less than twice the rows for each block. items: key, vector, core."""
    kind = items.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        l, r, names = sides(left, right, [vector, "core"], vector)  # noqa: E741
        i, j, w = tile_tree(l, None if right is None else r)
        yield pa.RecordBatch.from_arrays([named(i, names, left["key"].type), named(j, names, left["key"].type), pa.array(w)], ["i", "j", "reach"])

    return tiled(items, [vector, "core"], size, run, f"i {kind}, j {kind}, reach double", block, measured)
