"""Image operators on dense volumes (band, row, column); ``functions.volumes.per_volume`` runs them on DataFrames, a volume a task.

Where a plain DataFrame form is natural it stands at the end of this file.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.volumes import VOXEL, neighbours, offsets, roll, shift
from .filters import convolve_axis, lower_median

# -- binary and grey morphology --------------------------------------------------------------------


def sphere(radius: int) -> list[tuple[int, int, int]]:
    return offsets("sphere", radius)


def disc(radius: int) -> list[tuple[int, int, int]]:
    return [o for o in offsets("sphere", radius) if o[0] == 0]


def element(raster: np.ndarray) -> list[tuple[int, int, int]]:
    """A raster's present voxels as offsets from its middle."""
    return [tuple(int(x) - n // 2 for x, n in zip(p, raster.shape)) for p in np.argwhere(raster)]


def dilate(a: np.ndarray, se: Iterable) -> np.ndarray:
    return np.any([roll(a, tuple(-x for x in o)) > 0 for o in se], axis=0).astype(float)


def erode(a: np.ndarray, se: Iterable) -> np.ndarray:
    return np.all([roll(a, o) > 0 for o in se], axis=0).astype(float)


def grey_dilate(a: np.ndarray, se: Iterable) -> np.ndarray:
    return np.max([roll(a, o, -np.inf) for o in se], axis=0)


def grey_erode(a: np.ndarray, se: Iterable) -> np.ndarray:
    return np.min([roll(a, o, np.inf) for o in se], axis=0)


def euclidean(a: np.ndarray, to_foreground: bool = True) -> np.ndarray:
    """Distance of each voxel to the nearest present (or absent) voxel, by three passes of lower envelopes."""
    on = (a > 0) if to_foreground else (a <= 0)
    d = np.where(on, 0.0, 1e12)
    for axis in range(a.ndim):
        d = np.moveaxis(d, axis, -1)
        n = d.shape[-1]
        gap = (np.arange(n)[:, None] - np.arange(n)[None, :]) ** 2
        d = np.moveaxis(np.min(d[..., None, :] + gap, axis=-1), -1, axis)
    return np.where(d < 1e11, np.sqrt(d), np.inf)


def distance_morphology(a: np.ndarray, radius: float, how: str) -> np.ndarray:
    """Spherical ``erode``, ``dilate``, ``close`` or ``open`` by distance."""
    if how == "dilate":
        return (euclidean(a) <= radius).astype(float)
    if how == "erode":
        return (euclidean(a, False) > radius).astype(float)
    first, second = ("dilate", "erode") if how == "close" else ("erode", "dilate")
    wide = np.pad(a, int(radius) + 1) if how == "close" else a
    out = distance_morphology(distance_morphology(wide, radius, first), radius, second)
    return out[tuple(slice(int(radius) + 1, -int(radius) - 1) for _ in a.shape)] if how == "close" else out


#: Chamfer weights of steps along one, two and three axes.
CHAMFER = (0.8875, 1.34224, 1.59772)


def chamfer(a: np.ndarray, region: np.ndarray | None = None, weights=CHAMFER, pixdim=(1.0, 1.0, 1.0), sweeps: int = 200) -> np.ndarray:
    """Shortest path length to present voxels by steps to 26 neighbours, within a region if given; infinite where none leads there."""
    d = np.where(a > 0, 0.0, np.inf)
    free = np.ones(a.shape, bool) if region is None else (region > 0) | (a > 0)
    steps = [(o, math.sqrt(sum((x * p) ** 2 for x, p in zip(o, pixdim))) * weights[sum(map(abs, o)) - 1] / math.sqrt(sum(map(abs, o)))) for o in itertools.product(*[(-1, 0, 1) if n > 1 else (0,) for n in a.shape]) if any(o)]
    for _ in range(sweeps):
        new = np.minimum(d, np.min([roll(d, o, np.inf) + w for o, w in steps], axis=0))
        new[~free] = np.inf
        if np.array_equal(new, d):
            break
        d = new
    return d


def chamfer_slices(a: np.ndarray) -> np.ndarray:
    return np.stack([chamfer(s[None])[0] for s in a])


# -- components and topology -----------------------------------------------------------------------


def label(a: np.ndarray, neighbourhood: int = 26) -> np.ndarray:
    """Connected components numbered 1, 2, ... in order of their first voxel; 6 or 26 neighbours."""
    on = a > 0
    out = np.where(on, np.arange(1, a.size + 1).reshape(a.shape), 0)
    table = [o for o in offsets(neighbourhood) if any(o)]
    while True:
        near = np.where(neighbours(out, table) > 0, neighbours(out, table), a.size + 1).min(axis=0)
        new = np.where(on, np.minimum(out, near), 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(on, flat[new], 0)  # jump to the label of the label
        if np.array_equal(new, out):
            break
        out = new
    kept = np.unique(out[on])
    return np.where(on, np.searchsorted(kept, out) + 1, 0).astype(float)


def label_slices(a: np.ndarray, neighbourhood: int = 8) -> np.ndarray:
    """Components of each slice, 4 or 8 neighbours."""
    out, at = np.zeros(a.shape), 0
    for b, s in enumerate(a):
        x = label(s[None], 6 if neighbourhood == 4 else 26)[0]
        out[b] = np.where(x > 0, x + at, 0)
        at = int(max(out[b].max(), at))
    return out


def select_big(labels: np.ndarray) -> np.ndarray:
    """The most frequent label's voxels."""
    n = np.bincount(labels[labels > 0].astype(int)) if (labels > 0).any() else np.zeros(1, int)
    return (labels == n.argmax()).astype(float) if n.any() else np.zeros(labels.shape)


def delete_small(labels: np.ndarray, least: int) -> np.ndarray:
    n = np.bincount(labels.astype(int).ravel())
    return np.where(n[labels.astype(int)] >= least, labels, 0)


def border(a: np.ndarray, neighbourhood: int = 6) -> np.ndarray:
    """Present voxels with an absent neighbour."""
    near = neighbours((a > 0).astype(float), offsets(neighbourhood))
    return ((a > 0) & (near.min(axis=0) == 0)).astype(float)


def _patches(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of present voxels, their 3 x 3 x 3 neighbourhoods)."""
    at = np.argwhere(a > 0)
    p = np.pad(a > 0, 1)
    return at, np.stack([p[b : b + 3, r : r + 3, c : c + 3] for b, r, c in at]) if len(at) else np.zeros((0, 3, 3, 3), bool)


def _count_components(patch: np.ndarray, kind: int) -> int:
    """Components of a patch without its middle that touch the middle."""
    x = patch.astype(float).copy()
    x[1, 1, 1] = 0
    if kind == 6:  # within the 18-neighbourhood
        x[::2, ::2, ::2] = 0
    lab = label(x, kind)
    touch = [lab[1 + o[0], 1 + o[1], 1 + o[2]] for o in offsets(kind) if any(o)]
    return len({v for v in touch if v > 0})


def simple_points(a: np.ndarray) -> np.ndarray:
    """Present voxels that can go without a change of topology: one component of foreground (26) and one of background (6)."""
    out = np.zeros(a.shape)
    for at, patch in zip(*_patches(a)):
        out[tuple(at)] = float(_count_components(patch, 26) == 1 and _count_components(~patch, 6) == 1)
    return out


def topological_class(a: np.ndarray) -> np.ndarray:
    """1 interior, 2 isolated, 3 border, 4 curve, 5 curve junction, 6 surface, 7 surface-curve, 8 surface junction, 9 surfaces-curves junction."""
    out = np.zeros(a.shape)
    for at, patch in zip(*_patches(a)):
        fore, back = _count_components(patch, 26), _count_components(~patch, 6)
        out[tuple(at)] = 1 if back == 0 else 2 if fore == 0 else 3 if (back, fore) == (1, 1) else 4 if (back, fore) == (1, 2) else 5 if back == 1 else 6 if (back, fore) == (2, 1) else 7 if back == 2 else 8 if fore == 1 else 9
    return out


def euler(a: np.ndarray, neighbourhood: int = 26) -> int:
    """Euler characteristic: vertices - edges + faces - cells of voxels as closed cubes (26), or of their dual graph (6)."""
    on = np.pad(a > 0, 1)
    pick = np.any if neighbourhood == 26 else np.all
    total = 0
    for axes in itertools.product((0, 1), repeat=3):  # along which axes a cell is shared by two voxels
        parts = [on[tuple(slice(s, on.shape[i] - 1 + s if axes[i] else on.shape[i]) for i, s in enumerate(o))] for o in itertools.product(*[(0, 1) if x else (0,) for x in axes])]
        cells = int(pick(parts, axis=0).sum())
        dim = 3 - sum(axes)
        total += (-1) ** (dim if neighbourhood == 26 else sum(axes)) * cells
    return total


def plane_points(a: np.ndarray) -> np.ndarray:
    """Present voxels where foreground parts the background in two: surface points."""
    out = np.zeros(a.shape)
    for at, patch in zip(*_patches(a)):
        out[tuple(at)] = float(_count_components(~patch, 6) == 2)
    return out


def thin(a: np.ndarray, keep_ends: bool = True) -> np.ndarray:
    """Removal of simple points from the outside in, by distance to the background; curve ends stay with ``keep_ends``."""
    x = (a > 0).astype(float)
    depth = euclidean(x, False)
    while True:
        changed = False
        places = np.argwhere(border(x) > 0)
        for at in places[np.argsort(depth[tuple(places.T)], kind="stable")]:
            p = np.pad(x, 1)[at[0] : at[0] + 3, at[1] : at[1] + 3, at[2] : at[2] + 3] > 0
            if keep_ends and p.sum() <= 2:
                continue
            if _count_components(p, 26) == 1 and _count_components(~p, 6) == 1:
                x[tuple(at)], changed = 0, True
        if not changed:
            return x


def skeleton(a: np.ndarray) -> np.ndarray:
    """Thinning that keeps surface points too."""
    x = (a > 0).astype(float)
    keep = plane_points(x)
    depth = euclidean(x, False)
    for at in sorted(map(tuple, np.argwhere(x > 0)), key=lambda p: depth[p]):
        if keep[at]:
            continue
        p = np.pad(x, 1)[at[0] : at[0] + 3, at[1] : at[1] + 3, at[2] : at[2] + 3] > 0
        if p.sum() > 2 and _count_components(p, 26) == 1 and _count_components(~p, 6) == 1 and depth[at] <= 1:
            x[at] = 0
    return x


def skeleton_slices(a: np.ndarray) -> np.ndarray:
    return np.stack([thin(s[None])[0] for s in a])


# -- smoothing and edges ---------------------------------------------------------------------------


def vote(a: np.ndarray, kind: int = 26, rounds: int = 1) -> np.ndarray:
    """The most frequent value of the neighbourhood; of equals the smallest."""
    for _ in range(rounds):
        near = neighbours(a, offsets(kind))
        values = np.unique(a)
        a = values[np.argmax([(near == v).sum(axis=0) for v in values], axis=0)]
    return a


def median(a: np.ndarray, size: int = 3, ignore_background: bool = False) -> np.ndarray:
    h = size // 2
    near = neighbours(a, list(itertools.product(range(-h, h + 1), repeat=3)), np.nan)
    on = ~np.isnan(near)
    if ignore_background:
        on &= near != 0
    out = lower_median(near, on)
    return np.where(a == 0, 0, out) if ignore_background else out


def median_slices(a: np.ndarray, size: int = 3) -> np.ndarray:
    return np.concatenate([median2(s, size)[None] for s in a])


def median2(s: np.ndarray, size: int) -> np.ndarray:
    h = size // 2
    near = np.stack([roll(s, o, np.nan) for o in itertools.product(range(-h, h + 1), repeat=2)])
    return lower_median(near, ~np.isnan(near))


def box(a: np.ndarray, size: int = 3) -> np.ndarray:
    for axis in range(a.ndim):
        a = convolve_axis(a, np.ones(size) / size, axis)
    return a


def gradient(a: np.ndarray, sigma: float = 1.0) -> list[np.ndarray]:
    """Derivatives along each axis of the smoothed volume."""
    n = int(3 * sigma + 1)
    t = np.arange(-n, n + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    out = []
    for axis in range(a.ndim):
        x = a
        for other in range(a.ndim):
            if other != axis and a.shape[other] > 1:
                x = convolve_axis(x, g / g.sum(), other)
        k = t * g / (t * t * g).sum()
        y = np.zeros(a.shape)
        for i, w in zip(t, k):
            o = tuple(int(i) if d == axis else 0 for d in range(a.ndim))
            y += w * (roll(x, o) + x * (1 - roll(np.ones_like(x), o)))  # the face's value goes on beyond it
        out.append(y)
    return out


def magnitude(parts: Iterable[np.ndarray]) -> np.ndarray:
    return np.sqrt(sum(p * p for p in parts))


def edges(a: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.3) -> np.ndarray:
    """Thin edges: gradient magnitudes that are largest along their direction, from ``high`` of the maximum on, and those from ``low`` on that are connected to them."""
    g = gradient(a, sigma)
    m = magnitude(g)
    if not m.max():
        return np.zeros(a.shape)
    unit = [np.where(m > 0, x / np.where(m > 0, m, 1), 0) for x in g]
    at = np.indices(a.shape).astype(float)
    ahead, behind = (sample(m, np.stack([p + s * u for p, u in zip(at, unit)])) for s in (1, -1))
    ridge = (m >= ahead) & (m > behind)
    weak, strong = ridge & (m >= low * m.max()), ridge & (m >= high * m.max())
    lab = label(weak)
    return np.isin(lab, np.unique(lab[strong & (lab > 0)])).astype(float) * (lab > 0)


def cluster_enhance(a: np.ndarray, step: float = 0.1, extent: float = 0.5, height: float = 2.0) -> np.ndarray:
    """Threshold-free enhancement of positive values: over thresholds h the sum of size^extent h^height of each voxel's cluster (26), times the step."""
    out = np.zeros(a.shape)
    for h in np.arange(step, a.max(initial=0) + step / 2, step):
        lab = label(a >= h).astype(int)
        out += np.where(lab > 0, np.bincount(lab.ravel())[lab] ** extent * h**height * step, 0)
    return out


def recursive_gradient(a: np.ndarray, alpha: float = 1.0) -> list[np.ndarray]:
    """Derivatives by recursive exponential smoothing of parameter alpha, run along each axis both ways."""
    decay = math.exp(-alpha)

    def run(x: np.ndarray, axis: int, derivative: bool) -> np.ndarray:
        x = np.moveaxis(x, axis, 0)
        up, down = np.zeros_like(x), np.zeros_like(x)
        c = (1 - decay) ** 2 / (1 + 2 * alpha * decay - decay**2)
        for i in range(len(x)):
            p1, p2 = (up[i - 1] if i else x[0] * 0), (up[i - 2] if i > 1 else x[0] * 0)
            q = x[i - 1] if i else x[0]
            up[i] = (q if derivative else c * (x[i] + decay * (alpha - 1) * q)) + 2 * decay * p1 - decay**2 * p2
        for i in range(len(x) - 1, -1, -1):
            p1, p2 = (down[i + 1] if i + 1 < len(x) else x[0] * 0), (down[i + 2] if i + 2 < len(x) else x[0] * 0)
            q = x[i + 1] if i + 1 < len(x) else x[-1]
            q2 = x[i + 2] if i + 2 < len(x) else x[-1]
            down[i] = (q if derivative else c * (decay * (alpha + 1) * q - decay**2 * q2)) + 2 * decay * p1 - decay**2 * p2
        out = (1 - decay) ** 2 * (down - up) / 2 if derivative else up + down
        return np.moveaxis(out, 0, axis)

    out = []
    for axis in range(a.ndim):
        x = run(a, axis, True)
        for other in range(a.ndim):
            if other != axis and a.shape[other] > 2:
                x = run(x, other, False)
        out.append(x)
    return out


def contrast(a: np.ndarray, width: float = 2.0, background: float | None = None) -> np.ndarray:
    """mean -+ width deviations stretched to 0 .. 255."""
    on = a > background if background is not None else np.ones(a.shape, bool)
    if not on.any() or a[on].std() == 0:
        return np.zeros(a.shape)
    m, s = a[on].mean(), a[on].std(ddof=1)
    return np.where(on, np.clip((a - (m - width * s)) / (2 * width * s) * 255, 0, 255), 0)


def clip_tails(a: np.ndarray, low: float = 0.01, high: float = 0.01, bins: int = 10_000) -> np.ndarray:
    """The histogram's tails of these shares clipped, the rest stretched to 0 .. 255."""
    n, edge = np.histogram(a, bins)
    share = np.cumsum(n) / max(n.sum(), 1)
    lo = edge[np.searchsorted(share, low)]
    hi = edge[min(np.searchsorted(share, 1 - high) + 1, bins)]
    return np.clip((a - lo) / max(hi - lo, 1e-12) * 255, 0, 255)


def equalize(a: np.ndarray, exponent: float = 1.0) -> np.ndarray:
    v, at, n = np.unique(a, return_inverse=True, return_counts=True)
    share = np.cumsum(n) / n.sum()
    return (share[at].reshape(a.shape) ** exponent) * 255


def map_range(a: np.ndarray, low: float, high: float, to: tuple[float, float] = (0, 255)) -> np.ndarray:
    return np.clip((a - low) / (high - low) * (to[1] - to[0]) + to[0], *to)


# -- resampling and geometry -----------------------------------------------------------------------


def rotation(x: float, y: float, z: float) -> np.ndarray:
    """Rotations about the three axes, one after another, in radians."""
    cx, sx, cy, sy, cz, sz = math.cos(x), math.sin(x), math.cos(y), math.sin(y), math.cos(z), math.sin(z)
    return np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])


def euler_angles(m: np.ndarray) -> tuple[float, float, float]:
    return math.atan2(-m[1, 2], m[2, 2]), math.asin(max(-1.0, min(1.0, m[0, 2]))), math.atan2(-m[0, 1], m[0, 0])


def quaternion_rotation(q: Iterable[float]) -> np.ndarray:
    a, b, c, d = np.asarray(list(q), float) / np.linalg.norm(list(q))
    return np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])


def inverse(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m)


def _spline3(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0))


def _prefilter(a: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through the samples."""
    for axis, n in enumerate(a.shape):
        if n > 1:
            m = np.diag(np.full(n, 4 / 6)) + np.diag(np.full(n - 1, 1 / 6), 1) + np.diag(np.full(n - 1, 1 / 6), -1)
            a = np.moveaxis(np.tensordot(np.linalg.inv(m), a, (1, axis)), 0, axis)
    return a


def _bicubic(t: np.ndarray, k: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (k + 2) * t**3 - (k + 3) * t * t + 1, np.where(t < 2, k * t**3 - 5 * k * t * t + 8 * k * t - 4 * k, 0))


def sample(a: np.ndarray, at: np.ndarray, how: str = "linear") -> np.ndarray:
    """Values at places (3 x ...), 0 outside: ``nearest``, ``linear``, ``cubic`` (bicubic) or ``spline``."""
    if how == "nearest":
        i = np.floor(at + 0.5).astype(int)
        ok = np.all([(i[k] >= 0) & (i[k] < n) for k, n in enumerate(a.shape)], axis=0)
        return np.where(ok, a[tuple(np.clip(i[k], 0, n - 1) for k, n in enumerate(a.shape))], 0.0)
    reach, kernel = {"linear": ((0, 1), lambda t: np.maximum(1 - np.abs(t), 0)), "cubic": ((-1, 0, 1, 2), _bicubic), "spline": ((-1, 0, 1, 2), _spline3)}[how]
    if how == "spline":
        a = _prefilter(a)
    base = np.floor(at).astype(int)
    ok = np.all([(at[k] >= 0) & (at[k] <= n - 1) for k, n in enumerate(a.shape)], axis=0)
    out = np.zeros(at.shape[1:])
    for o in itertools.product(*[reach if n > 1 else (0,) for n in a.shape]):
        i = [base[k] + o[k] for k in range(3)]
        w = np.prod([kernel(at[k] - i[k]) if n > 1 else np.ones(at.shape[1:]) for k, n in enumerate(a.shape)], axis=0)
        there = np.all([(i[k] >= 0) & (i[k] < n) for k, n in enumerate(a.shape)], axis=0) if how == "spline" else True
        out += np.where(there, w * a[tuple(np.clip(i[k], 0, n - 1) for k, n in enumerate(a.shape))], 0)
    return np.where(ok, out, 0.0)


def resample(a: np.ndarray, matrix: np.ndarray, shift_: Iterable[float], shape: tuple[int, int, int] | None = None, how: str = "linear") -> np.ndarray:
    """out[x] = a[matrix x + shift]."""
    grid = np.indices(shape or a.shape).astype(float)
    at = np.tensordot(matrix, grid, (1, 0)) + np.asarray(list(shift_), float).reshape(3, 1, 1, 1)
    return sample(a, at, how)


def scale(a: np.ndarray, shape: tuple[int, int, int], how: str = "linear") -> np.ndarray:
    ratio = [(n - 1) / max(m - 1, 1) for n, m in zip(a.shape, shape)]
    return resample(a, np.diag(ratio), (0, 0, 0), shape, how)


def rotate_slice(s: np.ndarray, angle: float) -> np.ndarray:
    """By three shears about the middle."""
    t, u = -math.tan(angle / 2), math.sin(angle)
    for axis, k in ((1, t), (0, u), (1, t)):
        s = shear(s, k, axis)
    return s


def shear(s: np.ndarray, k: float, axis: int) -> np.ndarray:
    """Rows (axis 1) or columns (axis 0) moved by k times their distance from the middle."""
    grid = np.indices((1, *s.shape)).astype(float)
    other = 2 if axis == 0 else 1
    grid[axis + 1] += k * (grid[other] - (s.shape[other - 1] - 1) / 2)
    return sample(s[None], grid)[0]


def moments(a: np.ndarray, p: int = 0, q: int = 0, r: int = 0) -> float:
    """Central moment of a binary volume."""
    at = np.argwhere(a > 0)
    d = at - at.mean(0)
    return float((d[:, 0] ** p * d[:, 1] ** q * d[:, 2] ** r).sum())


def principal_axes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variances, directions as columns), largest first."""
    at = np.argwhere(a > 0)
    w, v = np.linalg.eigh(np.cov(at.T) if len(at) > 1 else np.zeros((3, 3)))
    return w[::-1], v[:, ::-1]


def radius(a: np.ndarray) -> float:
    """Largest distance of a present voxel from their middle."""
    at = np.argwhere(a > 0)
    return float(np.sqrt(((at - at.mean(0)) ** 2).sum(1).max())) if len(at) else 0.0


# -- DataFrame forms -------------------------------------------------------------------------------


def dilate_rows(volume: DataFrame, se: list, shape: tuple[int, int, int]) -> DataFrame:
    """Present voxels with a voxel of the element over a present one."""
    out = shift(volume.filter("value > 0"), se).select(*VOXEL).distinct()
    for x, n in zip(VOXEL, shape):
        out = out.filter(F.col(x).between(0, n - 1))
    return out.withColumn("value", F.lit(1.0))


def erode_rows(volume: DataFrame, se: list) -> DataFrame:
    """Voxels whose whole element is present: as many neighbours as it has places."""
    on = volume.filter("value > 0").select(*VOXEL, "value")
    n = shift(on, se).groupBy(*VOXEL).agg(F.count("*").alias("n")).filter(F.col("n") == len(se))
    return n.select(*VOXEL, F.lit(1.0).alias("value"))


def grey_rows(volume: DataFrame, se: list, how: str = "max") -> DataFrame:
    """Maximum or minimum of present neighbours at present voxels."""
    out = shift(volume, se).groupBy(*VOXEL).agg((F.max if how == "max" else F.min)("value").alias("value"))
    return out.join(volume.select(*VOXEL), list(VOXEL), "left_semi")


def border_rows(volume: DataFrame, kind: int = 6) -> DataFrame:
    """Present voxels with fewer present neighbours than there are places."""
    on = volume.filter("value > 0").select(*VOXEL, "value")
    full = shift(on, offsets(kind)).groupBy(*VOXEL).agg(F.count("*").alias("n")).filter(F.col("n") == len(offsets(kind)))
    return on.join(full.select(*VOXEL), list(VOXEL), "left_anti")


def select_big_rows(labels: DataFrame) -> DataFrame:
    """Voxels of the most frequent label, the smallest of equals."""
    top = labels.filter("value > 0").groupBy("value").count().orderBy(F.desc("count"), "value").limit(1).select("value")
    return labels.join(F.broadcast(top), "value", "left_semi")  # one row


def delete_small_rows(labels: DataFrame, least: int) -> DataFrame:
    keep = labels.groupBy("value").count().filter(F.col("count") >= least).select("value")
    return labels.join(keep, "value", "left_semi")


def equalize_rows(volume: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Histogram equalisation from counts of distinct values; the window has a row for each value."""
    n = volume.groupBy("value").agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return volume.join(n.select("value", (F.pow(share, F.lit(exponent)) * 255).alias("out")), "value").select(*VOXEL, F.col("out").alias("value"))


def centroid_rows(labels: DataFrame) -> DataFrame:
    """Size, centroid and second central moments of each label."""
    g = labels.filter("value > 0").groupBy(F.col("value").cast("int").alias("label"))
    return g.agg(F.count("*").alias("size"), *(F.avg(x).alias(f"{x}0") for x in VOXEL), *(F.var_pop(x).alias(f"{x}{x}") for x in VOXEL), *(F.covar_pop(x, y).alias(f"{x}{y}") for x, y in (("b", "r"), ("b", "c"), ("r", "c"))))


def tracks(labels: DataFrame) -> DataFrame:
    """Run-length form (label, band, row, col, length) by gaps and islands along columns."""
    on = labels.filter("value > 0")
    w = Window.partitionBy("b", "r", "value").orderBy("c")
    runs = on.withColumn("_g", F.col("c") - F.row_number().over(w)).groupBy("b", "r", "value", "_g").agg(F.min("c").alias("col"), F.count("*").alias("length"))
    return runs.select(F.col("value").cast("int").alias("label"), F.col("b").alias("band"), F.col("r").alias("row"), "col", "length")


def untrack(runs: DataFrame) -> DataFrame:
    """Voxels of run-length rows."""
    c = F.explode(F.sequence(F.col("col"), (F.col("col") + F.col("length") - 1).cast("int")))
    return runs.select(F.col("band").alias("b"), F.col("row").alias("r"), c.alias("c"), F.col("label").cast("double").alias("value"))


def nearest_scale_rows(volume: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Nearest-neighbour scaling: each new voxel takes the old one at the rounded place, found by an equality join on each axis."""
    spark, out = volume.sparkSession, volume
    for x, n, m in zip(VOXEL, old, new):
        table = spark.range(m).select(F.col("id").cast("int").alias("_new"), F.floor(F.col("id") * ((n - 1) / max(m - 1, 1)) + 0.5).cast("int").alias(x))
        out = out.join(table, x).drop(x).withColumnRenamed("_new", x)
    return out.select(*VOXEL, "value")
