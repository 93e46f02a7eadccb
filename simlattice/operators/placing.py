"""Places of twins among all rows of their pool, counted in memory: no pair meets the pool row by row.

A distance is the rounded difference of two values, so what is nearer than a twin is a range of values around a row's own. A task gets
the rows of a group as arrays, keeps the pools in order, and each pair of classes asks for the numbers of rows in two ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs of classes that are looked at in one go, rows of a batch, and cells of a table of counts.
AT_ONCE, BATCH, CELLS = 1 << 19, 1 << 17, 1 << 22


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, -1 for null, and the values."""
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    own = own.dictionary_encode()
    return own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), own.dictionary


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of the keys, the first one first, and where each class of equal rows starts, with the end."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.r_[np.flatnonzero(new), len(order)]


def distance(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """The difference, rounded half away from zero."""
    with np.errstate(all="ignore"):
        d = np.abs(a - b)
        more = d * scale
        whole = np.floor(more)
        whole += more - whole >= 0.5
        out = whole / scale
    return np.where(np.isfinite(out), out, d)


class Pool:
    """Rows (source, value, how many) of a group; placed() counts those nearer than a target, and those as near."""

    def __init__(self, source: np.ndarray, value: np.ndarray, n: np.ndarray, digits: int):
        self.scale = 10.0**digits
        order, starts = _classes(source, value)
        self.source, self.value = source[order[starts[:-1]]], value[order[starts[:-1]]]
        self.n = np.add.reduceat(n[order], starts[:-1]) if len(order) else n[:0]
        with np.errstate(all="ignore"):
            steps = np.rint(self.value * self.scale)
            # then a rounded difference is the difference of steps
            self.grid = bool((np.abs(steps) < 1e12).all() and (np.abs(self.value * self.scale - steps) < 1e-3).all())
        if not self.grid:
            return
        steps = steps.astype(np.int64)
        self.low = int(steps.min()) if len(steps) else 0
        steps -= self.low
        self.width = (int(steps.max()) if len(steps) else 0) + 2
        kinds = int(self.source.max()) + 1 if len(steps) else 1
        key = self.source * self.width + steps
        if kinds * self.width <= CELLS:
            self.keys, cells = None, np.bincount(key + 1, self.n, kinds * self.width + 1).astype(np.int64)
            self.upto = np.cumsum(cells)  # at source * width + step: rows of the sources before, and of this one below the step
        else:
            keys, at = np.unique(key, return_inverse=True)
            self.keys, self.upto = keys, np.r_[0, np.cumsum(np.bincount(at, self.n, len(keys)).astype(np.int64))]

    def placed(self, source: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows at a and targets at b of a source, both of the pool's values: (nearer, as near)."""
        return self._on_grid(source, a, b) if self.grid else self._anywhere(source, a, b)

    def _steps(self, x: np.ndarray) -> np.ndarray:
        return np.rint(x * self.scale).astype(np.int64) - self.low

    def _below(self, source: np.ndarray, step: np.ndarray) -> np.ndarray:
        at = source + np.clip(step, 0, self.width - 1)
        return self.upto[at if self.keys is None else np.searchsorted(self.keys, at)]

    def _on_grid(self, source, a, b):
        a, b, source = self._steps(a), self._steps(b), source * self.width
        d = np.abs(a - b)
        upto = self._below(source, a + d + 1) - self._below(source, a - d)
        nearer = np.where(d > 0, self._below(source, a + d) - self._below(source, a - d + 1), 0)
        return nearer, upto - nearer

    def _anywhere(self, source, a, b):
        """Distances of each a to the whole pool; NaN is the largest one and equals itself."""
        nearer, near = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        cuts = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)] if len(a) else [0]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            d = np.r_[distance(a[x], self.value, self.scale), distance(a[x], b[x:y], self.scale)]
            kinds, code = np.unique(d, return_inverse=True)
            key = self.source * len(kinds) + code[: len(self.value)]
            order = np.argsort(key)
            key, upto = key[order], np.r_[0, np.cumsum(self.n[order])]
            first, target = source[x:y] * len(kinds), source[x:y] * len(kinds) + code[len(self.value) :]
            left = upto[np.searchsorted(key, target)]
            nearer[x:y], near[x:y] = left - upto[np.searchsorted(key, first)], upto[np.searchsorted(key, target, "right")] - left
        return nearer, near


def twin_places(rows: pa.Table, pool: bool, digits: int, keep: int) -> Iterator[tuple]:
    """(a, b, members of a, members of b, kept class of a, twice the rank) of pairs of classes, in parts; classes are slices of rows.

    Of rows(_stem, _source, _value, _n, _own, _k0 ...), those that are own are asked for, among all. a and b are classes' numbers."""
    stem, source = _codes(rows["_stem"])[0], _codes(rows["_source"])[0]
    null = rows["_value"].is_null().to_numpy()
    value, n, own = rows["_value"].fill_null(0.0).to_numpy(), rows["_n"].to_numpy(), rows["_own"].to_numpy()
    kept = np.zeros(len(n), np.int64)
    for k in range(keep):
        code, values = _codes(rows[f"_k{k}"])
        kept = np.unique(kept * (len(values) + 1) + code + 1, return_inverse=True)[1]
    among = ~null & (source >= 0) if pool else ~null
    all_ = Pool(source[among] if pool else np.zeros(among.sum(), np.int64), value[among], n[among], digits)
    # equal values have one number, NaN too
    number = np.where(null, -1, np.unique(value, return_inverse=True)[1])
    twin = np.flatnonzero((stem >= 0) & (source >= 0))
    order, ends = _classes(stem[twin], source[twin], number[twin])
    b_rows = twin[order]
    b = b_rows[ends[:-1]]
    mine = twin[own[twin]]
    order, a_ends = _classes(number[mine], stem[mine], source[mine], kept[mine])
    a_rows = mine[order]
    a = a_rows[a_ends[:-1]]
    if not len(a):
        return
    nb, na = np.add.reduceat(n[b_rows], ends[:-1]), np.add.reduceat(n[a_rows], a_ends[:-1])
    low, high = np.searchsorted(stem[b], stem[a]), np.searchsorted(stem[b], stem[a], "right")
    upto = np.r_[0, np.cumsum(high - low)]
    x0 = 0
    while x0 < len(a):
        x1 = max(x0 + 1, int(np.searchsorted(upto, upto[x0] + AT_ONCE, "right")) - 1)
        for y0 in range(0, max(1, int((high - low)[x0])) if x1 == x0 + 1 else 1, AT_ONCE):  # one class may meet many
            many = np.minimum(high[x0:x1] - low[x0:x1] - y0, AT_ONCE) if x1 == x0 + 1 else high[x0:x1] - low[x0:x1]
            x = np.repeat(np.arange(x0, x1), many)
            y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + low[x] + y0
            met = source[a[x]] != source[b[y]]
            x, y = x[met], y[met]
            p, q = a[x], b[y]
            known = np.flatnonzero(~(null[p] | null[q]))
            va, vb = value[p[known]], value[q[known]]
            nearer, near = all_.placed(source[q[known]] if pool else np.zeros(len(known), np.int64), va, vb)
            if not pool:  # a row is none of its own pool: that of a twin is another source's, but the pool of all has it
                own_d, d = distance(va, va, all_.scale), distance(va, vb, all_.scale)
                nearer, near = nearer - ((own_d < d) | (np.isnan(d) & ~np.isnan(own_d))), near - ((own_d == d) | (np.isnan(d) & np.isnan(own_d)))
            twice = np.full(len(p), 1, np.int64)  # a distance that is not known: nothing is nearer or as near, the twin included
            twice[known] = 1 + 2 * nearer + near
            yield x, y, (a_rows, a_ends, na), (b_rows, ends, nb), kept[p], p, twice
        x0 = x1


def counts(rows: pa.Table, pool: bool, digits: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(keep..., rank, n): how many pairs of rows have a rank."""
    total: dict[tuple[int, int], int] = {}
    first: dict[int, int] = {}
    wide = 2 * int(rows["_n"].to_numpy().sum()) + 4
    for x, y, (_, _, na), (_, _, nb), kept, p, twice in twin_places(rows, pool, digits, len(keep)):
        weight, key = na[x] * nb[y], kept * wide + twice
        if len(key) and int(key.max()) < CELLS:
            sums = np.bincount(key, weight)  # whole numbers under 2^53
            found = np.flatnonzero(sums)
            sums = sums[found]
        else:
            found, at = np.unique(key, return_inverse=True)
            sums = np.bincount(at, weight, len(found))
        for k, w in zip(found.tolist(), sums.tolist(), strict=True):
            total[k] = total.get(k, 0) + int(w)
        if keep:
            classes, at = np.unique(kept, return_index=True)
            first |= dict(zip(classes.tolist(), p[at].tolist(), strict=True))
    keys = np.array(list(total), np.int64)
    at = pa.array([first[k] for k in (keys // wide).tolist()] if keep else [], pa.int64())
    columns = [rows[f"_k{k}"].take(at).combine_chunks() for k in range(len(keep))] + [pa.array((keys % wide) / 2), pa.array(list(total.values()), pa.int64())]
    yield from pa.table(columns, names=[*keep, "rank", "n"]).to_batches()


def members(rows: pa.Table, pool: bool, digits: int) -> Iterator[pa.RecordBatch]:
    """(a, b, rank) of rows."""
    ids = rows["_id"].combine_chunks()
    for x, y, (a_rows, a_ends, _), (b_rows, b_ends, _), _, _, twice in twin_places(rows, pool, digits, 0):
        if not len(x):
            continue
        na, nb = np.diff(a_ends)[x], np.diff(b_ends)[y]
        upto = np.r_[0, np.cumsum(na * nb)]
        ia, ib, rank = ids.take(pa.array(a_rows)), ids.take(pa.array(b_rows)), twice / 2
        # a batch is a stretch of all pairs of rows, wherever classes begin and end
        for s in range(0, int(upto[-1]), BATCH):
            e = min(s + BATCH, int(upto[-1]))
            u, v = int(np.searchsorted(upto, s, "right")) - 1, int(np.searchsorted(upto, e))
            many = np.minimum(upto[u + 1 : v + 1], e) - np.maximum(upto[u:v], s)
            k = np.repeat(np.arange(u, v), many)
            place = np.arange(s, e) - upto[k]
            size = nb[k]
            yield pa.RecordBatch.from_arrays([ia.take(pa.array(a_ends[x[k]] + place // size)), ib.take(pa.array(b_ends[y[k]] + place % size)), pa.array(rank[k])], names=["a", "b", "rank"])


def classes(rows: pa.Table, pool: bool, digits: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, keep..., rank) of classes, each by its smallest id."""
    rows = rows.sort_by("_id")  # a class's first row is its smallest: orders are stable
    ids = rows["_id"].combine_chunks()
    for x, y, (a_rows, a_ends, na), (b_rows, b_ends, nb), _, p, twice in twin_places(rows, pool, digits, len(keep)):
        kept = [rows[f"_k{k}"].take(pa.array(p)).combine_chunks() for k in range(len(keep))]
        columns = [ids.take(pa.array(a_rows[a_ends[x]])), ids.take(pa.array(b_rows[b_ends[y]])), pa.array(na[x]), pa.array(nb[y]), *kept, pa.array(twice / 2)]
        yield from pa.table(columns, names=["a", "b", "na", "nb", *keep, "rank"]).to_batches(max_chunksize=BATCH)
