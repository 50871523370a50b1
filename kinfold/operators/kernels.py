"""Distance arithmetic on one block of rows, used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.vectors import METRICS

CHUNK = 4_000_000


def to_matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """`list<double>` column -> (rows, d) matrix; missing values are refused."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    n = len(col)
    if n == 0:
        return np.empty((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if col.null_count or len(flat) % n or np.isnan(flat).any():
        raise ValueError("Feature vectors must have one length and no missing values")
    return flat.reshape(n, -1)


def check_metric(metric: str, p: float) -> None:
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    if metric == "minkowski" and p < 1:
        raise ValueError("p must be at least 1")


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 2.0):
    """Exact (len(a), len(b)) distances, one feature at a time so memory stays at the result."""
    out = np.zeros((len(a), len(b)))
    if metric == "cosine":
        for j in range(a.shape[1]):
            out += np.multiply.outer(a[:, j], b[:, j])
        norm = np.sqrt(np.multiply.outer((a * a).sum(axis=1), (b * b).sum(axis=1)))
        return 1.0 - np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    for j in range(a.shape[1]):
        t = np.subtract.outer(a[:, j], b[:, j])
        if metric == "manhattan":
            out += np.abs(t, out=t)
        elif metric == "euclidean" or p == 2.0:
            out += np.multiply(t, t, out=t)
        else:
            out += np.abs(t, out=t) ** p
    if metric == "manhattan":
        return out
    if metric == "euclidean" or p == 2.0:
        return np.sqrt(out, out=out)
    return out ** (1.0 / p)


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Exact distance of a[i] and b[i]."""
    if metric == "cosine":
        norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        return 1.0 - np.divide((a * b).sum(axis=1), norm, out=np.zeros(len(a)), where=norm > 0)
    t = np.abs(a - b)
    if metric == "manhattan":
        return t.sum(axis=1)
    if metric == "euclidean" or p == 2.0:
        return np.sqrt((t * t).sum(axis=1))
    return (t**p).sum(axis=1) ** (1.0 / p)


class _Screen:
    """Cheap scores of tiles of (a, b) pairs: `tile` gives them, every pair within a distance `t` of row i has a score
    of at most `threshold(t)[i]`, and a pair with score x is no farther apart than `bound(x)`."""

    rows, cols = 256, 1024

    def tile(self, s: int, e: int, t: int, u: int) -> np.ndarray:
        return self.a[s:e] @ self.b[t:u].T


class _Products(_Screen):
    """Euclidean and cosine: one matrix product, the squared length of b being one more feature."""

    def __init__(self, a, b, cosine):
        self.cosine = cosine
        if cosine:
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            self.a = -a / np.where(na > 0, na, 1.0)[:, None]
            self.b = b / np.where(nb > 0, nb, 1.0)[:, None]
            self.own, self.slack = np.full(len(a), 1.0), np.full(len(a), 1e-12)
        else:
            sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            self.a = np.concatenate([-2.0 * a, np.ones((len(a), 1))], axis=1)
            self.b = np.concatenate([b, sb[:, None]], axis=1)
            self.own = sa
            self.slack = 8e-14 * a.shape[1] * (sa + sb.max(initial=0.0)) + 1e-300

    def threshold(self, s, e, limit):
        return (limit if self.cosine else limit * limit) - self.own[s:e] + self.slack[s:e]

    def bound(self, s, e, score):
        most = np.maximum(0.0, score + self.own[s:e] + self.slack[s:e])
        return most if self.cosine else np.sqrt(most)


class _Steps(_Screen):
    """Manhattan on whole numbers of steps: |x - y| = 2 max(x, y) - x - y, with sums that fit 16 bits. What rounding to
    steps takes from a row bounds the error of its distances."""

    rows, cols = 64, 4096

    def __init__(self, a, b):
        d = a.shape[1]
        low = np.minimum(a.min(axis=0), b.min(axis=0))
        span = float((np.maximum(a.max(axis=0), b.max(axis=0)) - low).max())
        self.step = max(span / (65535 // d), 1e-300)

        def cut(x):
            x = x - low
            q = np.minimum(np.rint(x / self.step), 65535 // d)
            return q.astype(np.uint16).T.copy(), q.sum(axis=1), np.abs(x - q * self.step).sum(axis=1) + 1e-12 * d * span

        (self.a, self.own, lost), (self.b, other, lost_b) = cut(a), cut(b)
        self.other = (other / 2).astype(np.float32)
        # A 32-bit float holds the half steps counted here to less than a tenth.
        self.lost = lost + lost_b.max(initial=0.0) + 0.2 * self.step

    def tile(self, s, e, t, u):
        out, top = np.zeros((e - s, u - t), np.uint16), np.empty((e - s, u - t), np.uint16)
        for x, y in zip(self.a[:, s:e], self.b[:, t:u], strict=True):
            out += np.maximum.outer(x, y, out=top)
        return out - self.other[t:u]

    def threshold(self, s, e, limit):
        return (limit + self.lost[s:e]) / (2 * self.step) + self.own[s:e] / 2

    def bound(self, s, e, score):
        return (score - self.own[s:e] / 2) * (2 * self.step) + self.lost[s:e]


class _Powers(_Screen):
    """Minkowski in 32 bits around the mean; what the rounding takes from a row bounds the error of its distances."""

    rows, cols = 32, 2048

    def __init__(self, a, b, p):
        self.p, middle = p, b.mean(axis=0) if len(b) else 0.0
        a, b = a - middle, b - middle
        self.scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0), 1e-300)

        def cut(x):
            x = x / self.scale
            y = x.astype(np.float32)
            return y.T.copy(), (np.abs(x - y) ** p).sum(axis=1) ** (1.0 / p)

        (self.a, lost), (self.b, lost_b) = cut(a), cut(b)
        self.lost = lost + lost_b.max(initial=0.0) + 1e-10
        self.part = 1.0 + 2e-7 * (len(self.a) + 16) * max(1.0, p)

    def tile(self, s, e, t, u):
        shape = (e - s, u - t)
        out, gap, square = np.zeros(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
        for x, y in zip(self.a[:, s:e], self.b[:, t:u], strict=True):
            np.subtract.outer(x, y, out=gap)
            np.abs(gap, out=gap)
            if self.p == 3.0:
                np.multiply(gap, gap, out=square)
                out += np.multiply(gap, square, out=gap)
            else:
                out += np.power(gap, np.float32(self.p), out=gap)
        return out

    def threshold(self, s, e, limit):
        return (((limit / self.scale) + self.lost[s:e]) * self.part) ** self.p

    def bound(self, s, e, score):
        return (score.astype(float) ** (1.0 / self.p) * self.part + self.lost[s:e]) * self.scale


class _Exact(_Screen):
    """Distances as they are, for what the other screens do not take."""

    rows = 64

    def __init__(self, a, b, metric, p):
        self.a, self.b, self.metric, self.p = a, b, metric, p

    def tile(self, s, e, t, u):
        return distances(self.a[s:e], self.b[t:u], self.metric, self.p)

    def threshold(self, s, e, limit):
        return limit * (1 + 1e-12) + 1e-300

    def bound(self, s, e, score):
        return score * (1 + 1e-12)


def _screen(a, b, metric, p) -> _Screen:
    if metric == "cosine":
        return _Products(a, b, True)
    if metric == "euclidean" or (metric == "minkowski" and p == 2.0):
        return _Products(a, b, False)
    if not (len(a) and len(b)) or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return _Exact(a, b, metric, p)
    if metric == "manhattan" or p == 1.0:
        return _Steps(a, b) if a.shape[1] <= 4096 else _Exact(a, b, metric, p)
    return _Powers(a, b, p) if p <= 8.0 else _Exact(a, b, metric, p)


def nearest(a, b, b_ids, k, metric, p, limit=None):
    """Flat (row of a, id, distance) of the k nearest b-rows of each a-row, ties by id.

    `limit` (per a-row) drops b-rows that are farther than an already known k-th distance.
    A cheap screen keeps a superset, exact distances decide. Pairs are screened in tiles that fit a
    processor's cache; the k-th scores met so far narrow what later tiles keep.
    """
    screen = _screen(a, b, metric, p)
    rows, cols, dist = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    for s in range(0, len(a), screen.rows):
        e = min(len(a), s + screen.rows)
        most = np.full(e - s, np.inf) if limit is None else limit[s:e].astype(float)
        held, size, full = [], 0, 6 * k * (e - s)
        for t in range(0, len(b), screen.cols):
            score = screen.tile(s, e, t, min(len(b), t + screen.cols))
            hit = score <= screen.threshold(s, e, most)[:, None]
            if score.shape[1] > k and np.count_nonzero(hit) > 8 * k * (e - s):
                kth = np.partition(score, k - 1, axis=1)[:, k - 1]
                most = np.minimum(most, screen.bound(s, e, kth))
                hit = score <= screen.threshold(s, e, most)[:, None]
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            r, c = np.divmod(at, score.shape[1])
            held.append((r, c + t, score.ravel()[at]))
            size += len(at)
            if size > full:
                most, held, size = _narrow(screen, s, e, most, held, k)
                full = max(full, 2 * size)
        if not held:
            continue
        r, c = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        step = max(1, CHUNK // max(1, a.shape[1]))
        d = [pair_distances(a[s + r[i : i + step]], b[c[i : i + step]], metric, p) for i in range(0, len(r), step)]
        d = np.concatenate(d)
        if limit is not None:
            keep = d <= limit[s:e][r]
            r, c, d = r[keep], c[keep], d[keep]
        r, c, d = keep_top(r, c, d, k) if _in_order(b_ids) else (r, c, d)
        rows.append(r + s)
        cols.append(c)
        dist.append(d)
    return keep_top(np.concatenate(rows), b_ids[np.concatenate(cols)], np.concatenate(dist), k)


def _in_order(ids) -> bool:
    return len(ids) < 2 or bool((ids[:-1] <= ids[1:]).all())


def _narrow(screen, s, e, most, held, k):
    """Tighter limits by the k-th scores of the pairs held, and the pairs that remain within them."""
    r, c, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((score, r))
    r, c, score = r[order], c[order], score[order]
    ends = np.searchsorted(r, np.arange(e - s + 1))
    kth = np.full(e - s, np.inf)
    some = np.flatnonzero(np.diff(ends) >= k)
    kth[some] = score[ends[some] + k - 1]
    most = np.minimum(most, screen.bound(s, e, kth))
    keep = score <= screen.threshold(s, e, most)[r]
    return most, [(r[keep], c[keep], score[keep])], int(keep.sum())


def keep_top(rows, ids, dist, k):
    """First k entries of each row by (distance, id)."""
    order = np.lexsort((ids, dist, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
    lengths = np.diff(np.r_[starts, len(rows)]) if len(rows) else []
    rank = np.arange(len(rows)) - np.repeat(starts, lengths) if len(rows) else np.arange(0)
    keep = rank < k
    return rows[keep], ids[keep], dist[keep]


def id_array(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as a sortable numpy array."""
    out = col.to_numpy() if isinstance(col, pa.ChunkedArray) else col.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def fast_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; pairs too close for that are recomputed."""
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    size = sa[:, None] + sb[None, :]
    d2 = size - 2.0 * (a @ b.T)
    r, c = np.nonzero(d2 < 1e-5 * size)
    d2[r, c] = 0.0
    np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)
    step = max(1, CHUNK // max(1, a.shape[1]))
    for s in range(0, len(r), step):
        i, j = r[s : s + step], c[s : s + step]
        d2[i, j] = pair_distances(a[i], b[j], "euclidean", 2.0)
    return d2


def euclidean_tiles(a: np.ndarray, b: np.ndarray, step: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(s, t, distances of a[s : s + step] to b[t : t + step]) of all tiles, those of one `s` in a row.

    One matrix product with the squared lengths as two more features, in memory that the next tile takes again;
    pairs too close for that are recomputed, as in `fast_euclidean`.
    """
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    a_wide = np.concatenate([-2.0 * a, sa[:, None], np.ones((len(a), 1))], axis=1)
    b_wide = np.concatenate([b, np.ones((len(b), 1)), sb[:, None]], axis=1).T.copy()
    held = np.empty(min(step, len(a)) * min(step, len(b)))
    for s in range(0, len(a), step):
        left = a_wide[s : s + step]
        for t in range(0, len(b), step):
            right = b_wide[:, t : t + step]
            d = held[: len(left) * right.shape[1]].reshape(len(left), -1)
            np.matmul(left, right, out=d)
            least = 1e-5 * (sa[s : s + step].max() + sb[t : t + step].max())
            close = np.flatnonzero(d < least) if d.min() < least else np.empty(0, int)
            i, j = np.divmod(close, d.shape[1])
            near = d[i, j] < 1e-5 * (sa[s + i] + sb[t + j])
            i, j = i[near], j[near]
            d[i, j] = 0.0
            np.sqrt(d, out=d)
            some = max(1, CHUNK // max(1, a.shape[1]))
            for r in range(0, len(i), some):
                x, y = i[r : r + some], j[r : r + some]
                d[x, y] = pair_distances(a[s + x], b[t + y], "euclidean", 2.0)
            yield s, t, d
