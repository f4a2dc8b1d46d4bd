"""Categories as seen by titles: the arithmetic of :func:`category_stats.requester_view`, in numpy over Arrow batches.

Rows come in groups, one for each category, or several where a category is crowded (:data:`MOST`). A group that is a whole category is worked out
from its own rows; those of crowded categories bring the category's totals with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from atlaswright.functions.geo import EARTH_KM

#: Rows of a category beyond which it is divided into several groups; rows that are worked on at once; pairs that are worked on at once.
MOST, _ROWS, _PAIRS = 20_000, 50_000, 1 << 17
#: Located articles up to which all of a category meet in pairs. Nodes in each direction, and how far a position is from the box of the means, in half its longest side, to count by interpolation: what that leaves out is some 64 ** -8 of the box.
DIRECT, NODES, FAR = 256, 8, 32
#: Articles up to which the pairs of many categories are formed together.
_TINY = 32

VIEW = "category string, title string, lat double, lon double, dispersion double, n_located bigint, ratio double"
SUMS = "category string, sums array<double>, near array<double>"

_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def units(degrees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees as a whole number of units of 1e-12, rounded half away from zero, in two parts (millions, rest) whose sums do not overflow."""
    x = degrees * 1e12
    whole = np.trunc(x)
    n = (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0.0)).astype(np.int64)
    return n // 10**6, n % 10**6


def mean(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean degrees of sums of units, rounded half up to nine places in whole numbers, as ``category_stats._mean``; NaN where ``n`` is 0."""
    safe = np.maximum(n, 1)
    first, rest = np.divmod(high, safe)
    q = first * 10**6 + (rest * 10**6 + low) // safe
    return np.where(n > 0, (q + 500) // 1000 / 1e9, np.nan)


def _haversine(y: np.ndarray, x: np.ndarray, y2: np.ndarray, x2: np.ndarray) -> np.ndarray:
    y, x, y2, x2 = (np.radians(v) for v in (y, x, y2, x2))
    a = np.clip(np.sin((y2 - y) / 2) ** 2 + np.cos(y) * np.cos(y2) * np.sin((x2 - x) / 2) ** 2, 0, 1)
    return 2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the sphere of diameter 1, 3 x n; with the degrees below, 5 x n."""
    y, x = np.radians(lat), np.radians(lon)
    c = np.cos(y) / 2
    return np.stack([c * np.cos(x), c * np.sin(x), np.sin(y) / 2, lat, lon])


def _km(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of points (5 x ...) by their chords; those nearly opposite, of which chords tell little, by the haversine."""
    d = p[0] - q[0]
    a = d * d
    for k in (1, 2):
        d = p[k] - q[k]
        a += d * d
    opposite = a > 0.999
    km = np.arcsin(np.sqrt(np.minimum(a, 1.0, out=a), out=a), out=a)
    km *= 2 * EARTH_KM
    if opposite.any():
        at = np.nonzero(opposite)
        p, q = (np.broadcast_to(v, (5, *a.shape))[(slice(None), *at)] for v in (p, q))
        km[at] = _haversine(p[3], p[4], q[3], q[4])
    return km


def _met(to: np.ndarray, points: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Of each of ``to`` the sum of distances to all ``points`` (each so many times)."""
    out, step = np.zeros(to.shape[1]), max(1, _PAIRS // max(1, points.shape[1]))
    for k in range(0, out.size, step):
        km = _km(to[:, k : k + step, None], points[:, None, :])
        out[k : k + step] = km.sum(1) if times is None else km @ times
    return out


def box(least: float, most: float, n: int) -> tuple[float, float]:
    """Middle and half side (never 0) of what the means without one article of n can be, from the sum over all, by the extremes of the positions: an offset of the sum / (n - 1)."""
    return -(least + most) / 2 / (n - 1), max((most - least) / 2 / (n - 1) * 1.0001, 1e-6)


class Box:
    """Sums of distances to points of a small box: nodes of the box for what is far from it and from its opposite, the rest one by one."""

    def __init__(self, mid_y: float, half_y: float, mid_x: float, half_x: float) -> None:
        self.mid, self.half = (mid_y, mid_x), (half_y, half_x)
        ys, xs = np.meshgrid(mid_y + half_y * _AT, mid_x + half_x * _AT, indexing="ij")
        self.nodes, self.middle = _vectors(ys.ravel(), xs.ravel()), _vectors(np.array([mid_y]), np.array([mid_x]))
        self.reach = EARTH_KM * np.radians(min(180.0, FAR * max(half_y, half_x)))

    def near(self, points: np.ndarray) -> np.ndarray:
        km = _km(points, self.middle)
        return (km <= self.reach) | (km >= np.pi * EARTH_KM - self.reach)

    def sums(self, points: np.ndarray) -> np.ndarray:
        return _met(self.nodes, points)

    def at(self, sums: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The sums of the nodes, interpolated: Chebyshev polynomials of both directions."""

        def weights(v: np.ndarray, k: int) -> np.ndarray:
            t = np.cos(np.arange(NODES)[:, None] * np.arccos(_AT)) * (2 / NODES)
            t[0] /= 2
            return np.polynomial.chebyshev.chebvander((v - self.mid[k]) / self.half[k], NODES - 1) @ t

        return ((weights(lat, 0) @ sums.reshape(NODES, NODES)) * weights(lon, 1)).sum(1)


def _once(flat: np.ndarray) -> np.ndarray:
    """Positions (lat, lon, times) of which each comes once."""
    at, back = np.unique(flat.reshape(-1, 3)[:, :2], axis=0, return_inverse=True)
    return np.column_stack([at, np.bincount(back.ravel(), flat.reshape(-1, 3)[:, 2], len(at))])


def _others(lat: np.ndarray, lon: np.ndarray, own_y: np.ndarray, own_x: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Sums of the distances of all other positions to the means (``own``), in one category; only where ``asked``."""
    p, q = _vectors(lat, lon), _vectors(own_y, own_x)[:, asked]
    out = np.full(lat.size, np.nan)
    if q.shape[1] <= DIRECT or lat.size <= DIRECT:
        step, ask, got = max(1, _PAIRS // lat.size), np.nonzero(asked)[0], []
        for k in range(0, ask.size, step):
            km = _km(q[:, k : k + step, None], p[:, None, :])
            km[np.arange(km.shape[0]), ask[k : k + step]] = 0.0
            got.append(km.sum(1))
        out[asked] = np.concatenate(got) if got else []
        return out
    n = lat.size
    by, bx = (box(v.min() - s, v.max() - s, n) for v, s in ((lat, lat.sum()), (lon, lon.sum())))
    b = Box(*by, *bx)
    near = b.near(p)
    some = _once(np.column_stack([lat, lon, np.ones(n)])[near])
    total = b.at(b.sums(p[:, ~near]), own_y[asked], own_x[asked])
    out[asked] = total + _met(q, _vectors(some[:, 0], some[:, 1]), some[:, 2]) - _km(p[:, asked], q)
    return out


def node_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Located rows of crowded categories (category, lat, lon, n, box) to :data:`SUMS`: partial sums of distances to the whole category's mean and to all nodes, and positions near the box."""
    state: dict[str, list] = {}

    def done() -> pa.RecordBatch:
        rows = [(c, s, _once(np.concatenate(near)).ravel() if near else np.zeros(0)) for c, (_, s, near) in state.items()]
        state.clear()
        cols = [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (1, 2))]
        return pa.RecordBatch.from_arrays(cols, ["category", "sums", "near"])

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("category").dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        col = {c: batch.column(c).to_numpy(zero_copy_only=False)[order] for c in batch.schema.names if c != "category"}
        edges = [*np.nonzero(np.r_[True, np.diff(code[order]) != 0])[0], code.size]
        for i, j in zip(edges, edges[1:]):
            c = names.dictionary[int(code[order[i]])].as_py()
            if c not in state:
                state[c] = [Box(*(float(col[k][i]) for k in ("mid_y", "half_y", "mid_x", "half_x"))), np.zeros(NODES * NODES + 1), []]
            b, sums, near = state[c]
            lat, lon = col["lat"][i:j], col["lon"][i:j]
            p = _vectors(lat, lon)
            few = col["n"][i] <= DIRECT
            close = np.ones(j - i, bool) if few else b.near(p)
            sums[0] += _km(p, _vectors(col["mean_y"][i : i + 1], col["mean_x"][i : i + 1])).sum()
            if not few:
                sums[1:] += b.sums(p[:, ~close])
            if close.any():
                near.append(np.column_stack([lat, lon, np.ones(j - i)])[close])
                held += int(close.sum())
        if len(state) > 4096 or held > 1_000_000:
            held = 0
            yield done()
    if state:
        yield done()


def views(compat: bool):  # noqa: ANN201
    """Rows in the order of ``key`` to :data:`VIEW`; a key's groups are never divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= _ROWS:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                upto = int(np.searchsorted(key, key[-1]))
                if upto:
                    yield from _view(t.slice(0, upto), compat).to_batches(max_chunksize=10_000)
                held, rows = [t.slice(upto).combine_chunks().to_batches()[0]], t.num_rows - upto
                if not upto:
                    rows = 0  # one key so far: looked at again after as many rows
        if held:
            yield from _view(pa.Table.from_batches(held), compat).to_batches(max_chunksize=10_000)

    return run


def _view(t: pa.Table, compat: bool) -> pa.Table:
    t = t.combine_chunks()

    def edges(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, name = t.column("key").to_numpy(), t.column("category").combine_chunks()
        other = np.r_[True, key[1:] != key[:-1]]
        differs = np.r_[True, ~pc.equal(name.slice(1), name.slice(0, len(name) - 1)).to_numpy(zero_copy_only=False)]
        return other, differs

    other, differs = edges(t)
    if (differs & ~other).any():  # categories that share a key
        t = t.sort_by([("key", "ascending"), ("category", "ascending")]).combine_chunks()
        other, differs = edges(t)
    num = lambda c: pc.fill_null(t.column(c), float("nan") if pa.types.is_floating(t.schema.field(c).type) else 0).to_numpy()
    group = np.cumsum(other | differs) - 1
    groups = int(group[-1]) + 1
    lat, lon, times, asked, kind = num("lat"), num("lon"), num("times"), num("asked") == 1, num("kind")
    there = (kind == 0) & (times > 0) & ~np.isnan(lat) & ~np.isnan(lon)

    # of each group, of its own rows; the rows of crowded categories replace that
    at = np.nonzero(there)[0]
    g, y, x = group[at], lat[at], lon[at]
    n_articles, n_located = np.zeros(groups, np.int64), np.bincount(g, minlength=groups)
    np.add.at(n_articles, group[times > 0], times[times > 0])
    parts = [units(y), units(x)]
    sums = []
    for pair in parts:
        for part in pair:
            s = np.zeros(groups, np.int64)
            np.add.at(s, g, part)
            sums.append(s)
    crowded = np.nonzero(kind == 1)[0]
    values = t.column("sums").combine_chunks()
    of = lambda r: np.array(values[int(r)].as_py(), float)
    for r in crowded:
        v = of(r)[:8].astype(np.int64)
        for s, k in zip((n_articles, n_located, *sums), (v[0], v[1], v[2] * 10**6 + v[3], v[4], v[5] * 10**6 + v[6], v[7])):
            s[group[r]] = k
    whole_y, whole_x = mean(sums[0], sums[1], n_located), mean(sums[2], sums[3], n_located)
    others = n_located[g] - 1
    own_y, own_x = (mean(sums[k][g] - parts[k // 2][0], sums[k + 1][g] - parts[k // 2][1], others) for k in (0, 2))
    whole = np.bincount(g, _km(_vectors(y, x), _vectors(whole_y[g], whole_x[g])), groups)
    with np.errstate(invalid="ignore", divide="ignore"):
        whole = whole / n_located

    own = np.full(at.size, np.nan)
    ask = asked[at] & (others > 0)
    is_crowded = np.zeros(groups, bool)
    is_crowded[group[crowded]] = True
    starts = np.searchsorted(g, np.arange(groups + 1))
    size = np.diff(starts)
    tiny = ~is_crowded & (size <= _TINY)
    _tiny_pairs(own, np.nonzero(ask & tiny[g])[0], g, starts, y, x, own_y, own_x)
    for k in np.nonzero(~is_crowded & (size > _TINY))[0]:
        s = slice(starts[k], starts[k + 1])
        if ask[s].any():
            own[s] = _others(y[s], x[s], own_y[s], own_x[s], ask[s])
    close = np.nonzero(kind == 2)[0]
    for r in crowded:
        k = group[r]
        s = slice(starts[k], starts[k + 1])
        v = of(r)[8:]
        whole[k] = v[4] / n_located[k] if n_located[k] else np.nan
        got = np.nonzero(ask[s])[0] + s.start
        if not got.size:
            continue
        near = [of(c) for c in close[group[close] == k]]
        near = _once(np.concatenate([np.zeros(0), *near]))
        q = _vectors(own_y[got], own_x[got])
        total = _met(q, _vectors(near[:, 0], near[:, 1]), near[:, 2]) - _km(_vectors(y[got], x[got]), q)
        if n_located[k] > DIRECT:
            total += Box(*v[:4]).at(v[5:], own_y[got], own_x[got])
        own[got] = total
    with np.errstate(invalid="ignore", divide="ignore"):
        own = np.where(ask, own / others, np.nan)

    seen = np.nonzero((kind == 0) & asked & (n_articles[group] > 0))[0]
    place = np.full(group.size, -1)
    place[at] = np.arange(at.size)
    p, k = place[seen], group[seen]
    member = p >= 0
    less = (member & (n_located[k] > 1) if compat else member).astype(np.int64)
    pick = lambda mine, all_: np.where(member, np.append(mine, np.nan)[p], all_[k])
    located, total = n_located[k] - less, n_articles[k] - less
    num = lambda v: pa.array(v, pa.float64(), from_pandas=True)
    out = t.select(["category", "title"]).take(pa.array(seen))
    cols = [pick(own_y, whole_y), pick(own_x, whole_x), pick(own, whole)]
    ratio = np.where(total > 0, located / (np.maximum(total, 0) + 1), 0.0)
    return pa.table([*out.columns, *map(num, cols), pa.array(located, pa.int64()), pa.array(ratio, pa.float64())], ["category", "title", "lat", "lon", "dispersion", "n_located", "ratio"])


def _tiny_pairs(own: np.ndarray, rows: np.ndarray, g: np.ndarray, starts: np.ndarray, y: np.ndarray, x: np.ndarray, own_y: np.ndarray, own_x: np.ndarray) -> None:
    """Fills ``own`` at ``rows`` with the sums of distances to the others of their group: pairs of many groups together."""
    for k in range(0, rows.size, _PAIRS // _TINY):
        r = rows[k : k + _PAIRS // _TINY]
        first, n = starts[g[r]], starts[g[r] + 1] - starts[g[r]]
        left = np.repeat(np.arange(r.size), n)
        right = np.arange(left.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        other = right != r[left]
        left, right = left[other], right[other]
        p, q = _vectors(y[first.min() : (first + n).max()], x[first.min() : (first + n).max()]), _vectors(own_y[r], own_x[r])
        own[r] = np.bincount(left, _km(p[:, right - first.min()], q[:, left]), r.size)
