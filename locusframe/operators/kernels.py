"""Geometric kernels on arrays of one task: triangulations, hulls, clipping, small fits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np

GHOST = -1


def orient(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Sign of twice the area of (a, b, c), exact when the floating result is in doubt."""
    l, r = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)  # noqa: E741
    det = l - r
    if abs(det) > 4e-16 * (abs(l) + abs(r)):
        return det
    A = Fraction
    exact = (A(ax) - A(cx)) * (A(by) - A(cy)) - (A(ay) - A(cy)) * (A(bx) - A(cx))
    return (exact > 0) - (exact < 0)


def in_circle(a: Sequence[float], b: Sequence[float], c: Sequence[float], d: Sequence[float]) -> float:
    """Positive if d lies inside the circle through the counter-clockwise a, b, c."""
    adx, ady, bdx, bdy, cdx, cdy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    p, q, r, s, t, u = bdx * cdy, cdx * bdy, cdx * ady, adx * cdy, adx * bdy, bdx * ady
    al, bl, cl = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
    det = al * (p - q) + bl * (r - s) + cl * (t - u)
    size = al * (abs(p) + abs(q)) + bl * (abs(r) + abs(s)) + cl * (abs(t) + abs(u))
    if abs(det) > 2e-15 * size:
        return det
    F = Fraction
    adx, ady, bdx, bdy, cdx, cdy = F(a[0]) - F(d[0]), F(a[1]) - F(d[1]), F(b[0]) - F(d[0]), F(b[1]) - F(d[1]), F(c[0]) - F(d[0]), F(c[1]) - F(d[1])
    al, bl, cl = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
    exact = al * (bdx * cdy - cdx * bdy) + bl * (cdx * ady - adx * cdy) + cl * (adx * bdy - bdx * ady)
    return (exact > 0) - (exact < 0)


def _curve_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices along rows of cells walked to and fro, so that neighbours in the order lie close.

    Cells are cut by ranks, so that a few far points do not put the rest into one cell.
    """
    n = len(x)
    side = max(1, int(math.sqrt(n / 4)))
    cx, cy = (np.searchsorted(np.sort(v), v) * side // n for v in (x, y))
    return np.lexsort((y, np.where(cy % 2, side - cx, cx), cy))


class Delaunay2D:
    """Incremental triangulation with ghost triangles at the hull.

    ``third[u, v]`` is the corner w of the counter-clockwise triangle (u, v, w).
    Of cocircular points the one of smallest index is taken as pulled into the
    circle of the others, so they are cut into a fan about it and the result
    depends on the points alone, not on the order of insertion; pass points in id order.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.pts = list(zip(x.tolist(), y.tolist(), strict=True))
        self.third: dict[tuple[int, int], int] = {}
        order = _curve_order(np.asarray(x), np.asarray(y)).tolist() if len(x) else []
        seen: dict[tuple[float, float], int] = {}
        #: Points with the coordinates of another one of smaller index.
        self.copies: dict[int, int] = {}
        for i, p in enumerate(self.pts):
            if p in seen:
                self.copies[i] = seen[p]
            else:
                seen[p] = i
        order = [i for i in order if i not in self.copies]
        start = self._start(order)
        if start is None:
            return
        a, b, c = start
        self._add(a, b, c)
        self._add(b, a, GHOST)
        self._add(c, b, GHOST)
        self._add(a, c, GHOST)
        self.at = (a, b)
        for i in order:
            if i not in start:
                self._insert(i)

    def _start(self, order: list[int]) -> tuple[int, int, int] | None:
        if len(order) < 3:
            return None
        a, b = order[0], order[1]
        for c in order[2:]:
            s = orient(*self.pts[a], *self.pts[b], *self.pts[c])
            if s:
                return (a, b, c) if s > 0 else (b, a, c)
        return None

    def _add(self, u: int, v: int, w: int) -> None:
        t = self.third
        t[u, v], t[v, w], t[w, u] = w, u, v

    def _drop(self, u: int, v: int, w: int) -> None:
        t = self.third
        del t[u, v], t[v, w], t[w, u]

    def _conflict(self, u: int, v: int, w: int, i: int) -> bool:
        """Whether triangle (u, v, w) cannot stay when point i is there."""
        p = self.pts
        if GHOST in (u, v, w):
            while w != GHOST:
                u, v, w = v, w, u
            s = orient(*p[u], *p[v], *p[i])
            if s:
                return s > 0
            (ux, uy), (vx, vy), (ix, iy) = p[u], p[v], p[i]
            return min(ux, vx) <= ix <= max(ux, vx) and min(uy, vy) <= iy <= max(uy, vy)
        s = in_circle(p[u], p[v], p[w], p[i])
        if s:
            return s > 0
        m = min(u, v, w)
        if i < m:
            return True
        while u != m:
            u, v, w = v, w, u
        return orient(*p[v], *p[w], *p[i]) < 0  # the side across from m lies between m and i: they get the diagonal

    def _locate(self, i: int) -> tuple[int, int, int]:
        """The triangle with point i, by walking from the last one."""
        p, t = self.pts, self.third
        u, v = self.at
        w = t[u, v]
        if w == GHOST:
            u, v = v, u
            w = t[u, v]
        x, y = p[i]
        while True:
            if GHOST in (u, v, w):
                return u, v, w
            if orient(*p[u], *p[v], x, y) < 0:
                u, v = v, u
            elif orient(*p[v], *p[w], x, y) < 0:
                u, v = w, v
            elif orient(*p[w], *p[u], x, y) < 0:
                u, v = u, w
            else:
                return u, v, w
            w = t[u, v]

    def _insert(self, i: int) -> None:
        t = self.third
        u, v, w = self._locate(i)
        if not self._conflict(u, v, w, i):  # on a tie: a neighbour across the nearest edge is in conflict
            for a, b in ((u, v), (v, w), (w, u)):
                x = t[b, a]
                if self._conflict(b, a, x, i):
                    u, v, w = b, a, x
                    break
        self._drop(u, v, w)
        stack = [(u, v), (v, w), (w, u)]
        new = []
        while stack:
            a, b = stack.pop()
            x = t.get((b, a))
            if x is not None and self._conflict(b, a, x, i):
                self._drop(b, a, x)
                stack += [(a, x), (x, b)]
            else:
                new.append((a, b))
        for a, b in new:
            self._add(a, b, i)
            if a != GHOST and b != GHOST:
                self.at = (a, b)

    def triangles(self) -> np.ndarray:
        """(n, 3) indices, counter-clockwise, smallest first, in order."""
        out = [(u, v, w) for (u, v), w in self.third.items() if w != GHOST and u != GHOST and v != GHOST and u < v and u < w]
        return np.array(sorted(out), np.int64).reshape(-1, 3)


def circumcircles(x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii."""
    ax, ay = x[tri[:, 0]], y[tri[:, 0]]
    bx, by, cx, cy = x[tri[:, 1]] - ax, y[tri[:, 1]] - ay, x[tri[:, 2]] - ax, y[tri[:, 2]] - ay
    d = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux = (cy * (bx**2 + by**2) - by * (cx**2 + cy**2)) / d
        uy = (bx * (cx**2 + cy**2) - cx * (bx**2 + by**2)) / d
    return ax + ux, ay + uy, np.hypot(ux, uy)


def clip_cell(x: float, y: float, nx: Sequence[float], ny: Sequence[float], box: tuple[float, float, float, float]) -> tuple[float, list[int], bool]:
    """Voronoi cell of (x, y) among its neighbours within a box: area, neighbours whose edge is left, whether the box cuts it."""
    x0, y0, x1, y1 = box
    poly = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    edge = [-1, -1, -1, -1]  # what cut the edge from a corner to the next one; -1: the box
    for k in sorted(range(len(nx)), key=lambda j: (nx[j] - x) ** 2 + (ny[j] - y) ** 2):
        mx, my, dx, dy = (x + nx[k]) / 2, (y + ny[k]) / 2, nx[k] - x, ny[k] - y
        s = [(px - mx) * dx + (py - my) * dy for px, py in poly]
        if max(s, default=0) <= 0:
            continue
        out, name = [], []
        for j in range(len(poly)):
            n = (j + 1) % len(poly)
            if s[j] <= 0:
                out.append(poly[j])
                name.append(edge[j])
            if (s[j] <= 0) != (s[n] <= 0):
                f = s[j] / (s[j] - s[n])
                out.append((poly[j][0] + f * (poly[n][0] - poly[j][0]), poly[j][1] + f * (poly[n][1] - poly[j][1])))
                name.append(k if s[j] <= 0 else edge[j])
        poly, edge = out, name
        if not poly:
            break
    area = 0.0
    left: set[int] = set()
    for j in range(len(poly)):
        (px, py), (qx, qy) = poly[j], poly[(j + 1) % len(poly)]
        area += (px - x) * (qy - y) - (qx - x) * (py - y)
        if math.hypot(qx - px, qy - py) > 0:
            left.add(edge[j])
    return abs(area) / 2, sorted(left - {-1}), -1 in left


def hull_2d(pts: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    p = sorted(set(map(tuple, pts.tolist())))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def half(q):
        out: list = []
        for r in q:
            while len(out) > 1 and orient(*out[-2], *out[-1], *r) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def shoelace(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def _general_position(pts: np.ndarray) -> np.ndarray:
    """Points moved by up to a ten-millionth of their extent, always alike, in extended precision.

    So no four lie in a plane and no five on a sphere, and the sign of a determinant is beyond its rounding.
    """
    p = np.asarray(pts, np.longdouble)
    scale = float(np.ptp(pts, axis=0).max()) or 1.0
    return p + np.random.default_rng(41).uniform(-1, 1, p.shape) * (1e-7 * scale)


def _det3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Determinants of rows a, b, c (n, 3)."""
    return a[:, 0] * (b[:, 1] * c[:, 2] - b[:, 2] * c[:, 1]) - a[:, 1] * (b[:, 0] * c[:, 2] - b[:, 2] * c[:, 0]) + a[:, 2] * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])


def hull_3d(pts: np.ndarray) -> np.ndarray:
    """Faces (n, 3) of the convex hull, outward. Points in a plane have none; a side of many points is cut into triangles over them."""
    pts = np.asarray(pts, float)
    n = len(pts)
    if n < 4:
        return np.zeros((0, 3), np.int64)
    scale = np.ptp(pts, axis=0).max() or 1.0
    a = 0
    b = int(np.argmax(((pts - pts[a]) ** 2).sum(1)))
    c = int(np.argmax((np.cross(pts - pts[a], pts[b] - pts[a]) ** 2).sum(1)))
    vol = (np.cross(pts[b] - pts[a], pts[c] - pts[a]) * (pts - pts[a])).sum(1)
    d = int(np.argmax(np.abs(vol)))
    if abs(vol[d]) <= 1e-12 * scale**3:
        return np.zeros((0, 3), np.int64)
    q = _general_position(pts)
    faces = np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)])
    out = _det3(q[faces[:, 1]] - q[faces[:, 0]], q[faces[:, 2]] - q[faces[:, 0]], q[[a, b, c, d]].mean(0) - q[faces[:, 0]]) > 0
    faces[out] = faces[out][:, [0, 2, 1]]
    for i in range(n):
        if i in (a, b, c, d):
            continue
        see = _det3(q[faces[:, 1]] - q[faces[:, 0]], q[faces[:, 2]] - q[faces[:, 0]], q[i] - q[faces[:, 0]]) > 0
        if not see.any():
            continue
        f = faces[see]
        edges = {(u, v) for u, v in np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]).tolist()}
        rim = [(u, v, i) for u, v in edges if (v, u) not in edges]
        faces = np.vstack([faces[~see], np.array(sorted(rim))])
    return faces.astype(np.int64)


def mesh_volume(pts: np.ndarray, faces: np.ndarray) -> float:
    """Signed tetrahedra of a closed, oriented mesh."""
    if not len(faces):
        return 0.0
    p, q, r = (pts[faces[:, k]] for k in range(3))
    return float(abs((np.cross(p, q) * r).sum() / 6))


def _curve_order3(p: np.ndarray) -> np.ndarray:
    """Indices along bars of cells walked to and fro, cells cut by ranks."""
    n = len(p)
    side = max(1, int((n / 4) ** (1 / 3)))
    cx, cy, cz = (np.searchsorted(np.sort(v), v) * side // n for v in p.T)
    cy = np.where(cz % 2, side - cy, cy)
    cx = np.where((cy + cz) % 2, side - cx, cx)
    return np.lexsort((p[:, 2], cx, cy, cz))


def delaunay_3d(pts: np.ndarray) -> np.ndarray:
    """Tetrahedra (n, 4), in order: found point by point in one far tetrahedron, of the points in general position.

    What a point's spheres hold is reached from one of them across sides, so a point costs what is about it, not all that there is.

    Whether a point lies in a sphere is told by the sphere's centre where that is clear, else by a determinant in
    extended precision. Tetrahedra that are flat but for the points' small moves go.
    """
    pts = np.asarray(pts, float)
    n = len(pts)
    if n < 4:
        return np.zeros((0, 4), np.int64)
    centre, size = pts.mean(0), (np.ptp(pts, axis=0).max() or 1.0) * 1e4
    far = centre + size * np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]])
    exact = np.vstack([_general_position(pts), far.astype(np.longdouble)]) - centre
    p = exact.astype(float)

    def sphere(t):
        """Centre, squared radius and orientation of each tetrahedron; the radius is nan where the centre is not clear."""
        a = p[t[:, 0]]
        m = np.stack([p[t[:, k]] - a for k in (1, 2, 3)], 1)
        det = np.linalg.det(m)
        clear = np.abs(det) > 1e-4 * np.sqrt((m**2).sum(2)).prod(1)
        c = np.full((len(t), 3), np.nan)
        if clear.any():
            c[clear] = np.linalg.solve(m[clear], ((m[clear] ** 2).sum(2) / 2)[..., None])[..., 0]
        x = exact[t]
        turn = np.sign(_det3(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0], x[:, 3] - x[:, 0])).astype(float)
        return a + c, (c**2).sum(1), turn

    def holds(t, turn, i):
        """Whether the spheres of t hold point i, by the lifted determinant."""
        x = exact[t] - exact[i]
        w = (x**2).sum(2)
        d = -w[:, 0] * _det3(x[:, 1], x[:, 2], x[:, 3]) + w[:, 1] * _det3(x[:, 0], x[:, 2], x[:, 3])
        d += -w[:, 2] * _det3(x[:, 0], x[:, 1], x[:, 3]) + w[:, 3] * _det3(x[:, 0], x[:, 1], x[:, 2])
        return d * turn < 0

    def held(ks, i):
        """Which of the tetrahedra ks have point i in their spheres."""
        d2 = ((cen[ks] - p[i]) ** 2).sum(1)
        bad = d2 < r2[ks]
        unsure = np.flatnonzero(~(np.abs(d2 - r2[ks]) > 1e-6 * r2[ks]))
        if len(unsure):
            bad[unsure] = holds(tets[ks[unsure]], turn[ks[unsure]], i)
        return bad

    # Slots of tetrahedra: corners, the slot across from each corner (-1: none), sphere, and whether it is in use.
    size = 8 * n + 64
    tets, across = np.zeros((size, 4), np.int64), np.full((size, 4), -1, np.int64)
    cen, r2, turn, live = np.zeros((size, 3)), np.zeros(size), np.zeros(size), np.zeros(size, bool)
    tets[0] = [n, n + 1, n + 2, n + 3]
    cen[:1], r2[:1], turn[:1] = sphere(tets[:1])
    live[0] = True
    used, free, last = 1, [], 0
    corners = p.tolist()
    for i in _curve_order3(pts).tolist():
        at, start = last, -1
        x, y, z = corners[i]
        for _ in range(4 * used):  # walk towards the point, across any side that it lies beyond
            t = tets[at].tolist()
            for k, (a, b, d) in enumerate(((1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2))):
                (ax, ay, az), (bx, by, bz), (dx, dy, dz), (kx, ky, kz) = corners[t[a]], corners[t[b]], corners[t[d]], corners[t[k]]
                bx, by, bz, dx, dy, dz = bx - ax, by - ay, bz - az, dx - ax, dy - ay, dz - az
                mx, my, mz = by * dz - bz * dy, bz * dx - bx * dz, bx * dy - by * dx
                if (mx * (x - ax) + my * (y - ay) + mz * (z - az)) * (mx * (kx - ax) + my * (ky - ay) + mz * (kz - az)) < 0:
                    break
            else:
                break
            to = int(across[at, k])
            if to < 0:
                break
            at = to
        if held(np.array([at]), i)[0]:
            start = at
        if start < 0:
            ks = np.flatnonzero(live[:used])
            start = int(ks[held(ks, i)][0])
        hit, front = [np.array([start])], np.array([start])
        gone = {start}
        while len(front):
            near = across[front].reshape(-1)
            near = np.array([k for k in dict.fromkeys(near.tolist()) if k >= 0 and k not in gone], np.int64)
            front = near[held(near, i)] if len(near) else near
            gone.update(front.tolist())
            hit.append(front)
        old = np.concatenate(hit)
        out = across[old]
        live[old] = False
        row, col = np.nonzero((out < 0) | live[out])  # sides to what stays
        sides = tets[old[row]][np.arange(4)[None] != col[:, None]].reshape(-1, 3)
        beyond = out[row, col]
        m = len(sides)
        slots = (free + old.tolist())[-m:] if len(free) + len(old) >= m else free + old.tolist() + list(range(used, used + m - len(free) - len(old)))
        free = (free + old.tolist())[: max(len(free) + len(old) - m, 0)]
        used = max(used, max(slots) + 1)
        slots = np.array(slots)
        if used > size:  # points may have far more tetrahedra than the usual seven each
            grow = lambda v: np.concatenate([v, np.zeros((used, *v.shape[1:]), v.dtype)])
            tets, across, cen, r2, turn, live = map(grow, (tets, across, cen, r2, turn, live))
            size += used
        ok = np.flatnonzero(beyond >= 0)
        place = (across[beyond[ok]] == old[row[ok]][:, None]).argmax(1)  # where the outer ones held what goes
        tets[slots] = np.column_stack([sides, np.full(m, i)])
        # Across from the new corner lies what was beyond; the other sides meet in pairs over the edges of the rim.
        across[slots, 3] = beyond
        across[beyond[ok], place] = slots[ok]
        e = np.sort(sides[:, [[1, 2], [0, 2], [0, 1]]].reshape(-1, 2), 1)
        pair = np.argsort(e[:, 0] * (n + 4) + e[:, 1], kind="stable").reshape(-1, 2)
        one, two = pair[:, 0], pair[:, 1]
        across[slots[one // 3], one % 3], across[slots[two // 3], two % 3] = slots[two // 3], slots[one // 3]
        cen[slots], r2[slots], turn[slots] = sphere(tets[slots])
        live[slots] = True
        last = int(slots[0])
    tets = tets[:used][live[:used]]
    keep = np.sort(tets[(tets < n).all(1)], 1)
    m = np.stack([pts[keep[:, k]] - pts[keep[:, 0]] for k in (1, 2, 3)], 1)
    keep = keep[np.abs(np.linalg.det(m)) > 1e-10 * np.sqrt((m**2).sum(2)).prod(1)]
    return keep[np.lexsort(keep.T[::-1])]


def clip_polyhedron(centre: np.ndarray, others: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[float, list[int], bool]:
    """Voronoi cell of a point among its neighbours in a box: volume, neighbours that bound it, whether the box does."""
    x0, y0, z0 = lo
    x1, y1, z1 = hi
    v = lambda i, j, k: np.array([(x0, x1)[i], (y0, y1)[j], (z0, z1)[k]])
    faces = [
        (-1, [v(0, 0, 0), v(0, 1, 0), v(1, 1, 0), v(1, 0, 0)]), (-1, [v(0, 0, 1), v(1, 0, 1), v(1, 1, 1), v(0, 1, 1)]),
        (-1, [v(0, 0, 0), v(1, 0, 0), v(1, 0, 1), v(0, 0, 1)]), (-1, [v(0, 1, 0), v(0, 1, 1), v(1, 1, 1), v(1, 1, 0)]),
        (-1, [v(0, 0, 0), v(0, 0, 1), v(0, 1, 1), v(0, 1, 0)]), (-1, [v(1, 0, 0), v(1, 1, 0), v(1, 1, 1), v(1, 0, 1)]),
    ]
    for k in np.argsort(((others - centre) ** 2).sum(1)).tolist():
        m, d = (centre + others[k]) / 2, others[k] - centre
        cut, left = [], []
        for name, poly in faces:
            s = [float(np.dot(q - m, d)) for q in poly]
            if max(s) <= 0:
                left.append((name, poly))
                continue
            out = []
            for j in range(len(poly)):
                n = (j + 1) % len(poly)
                if s[j] <= 0:
                    out.append(poly[j])
                if (s[j] <= 0) != (s[n] <= 0):
                    q = poly[j] + s[j] / (s[j] - s[n]) * (poly[n] - poly[j])
                    out.append(q)
                    cut.append(q)
            if len(out) > 2:
                left.append((name, out))
        if len(cut) > 2:
            c = np.mean(cut, 0)
            e1 = np.cross(d, [1.0, 0, 0] if abs(d[0]) < 0.9 * np.linalg.norm(d) else [0, 1.0, 0])
            e2 = np.cross(d, e1)
            cut.sort(key=lambda q: math.atan2(np.dot(q - c, e2), np.dot(q - c, e1)))
            left.append((k, cut))
        faces = left
    vol = 0.0
    for _, poly in faces:
        for j in range(1, len(poly) - 1):
            vol += abs(float(np.dot(np.cross(poly[0] - centre, poly[j] - centre), poly[j + 1] - centre))) / 6
    return vol, sorted({n for n, _ in faces} - {-1}), any(n == -1 for n, _ in faces)


def pca(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes as rows, longest first."""
    c = p.mean(0)
    _, v = np.linalg.eigh(np.cov((p - c).T, bias=True))
    return c, v.T[::-1]


def bounding_ellipsoid(p: np.ndarray, tol: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Centre and semi-axes (longest first) of a (1 + tol)-approximation of the smallest ellipsoid (Khachiyan)."""
    p = np.unique(np.asarray(p, float), axis=0)
    n, d = p.shape
    if n <= d:
        return p.mean(0), np.zeros(d)
    q = np.vstack([p.T, np.ones(n)])
    u = np.full(n, 1 / n)
    for _ in range(10_000):
        m = np.einsum("ij,ij->j", q, np.linalg.solve(q @ (u[:, None] * q.T), q))
        j = int(np.argmax(m))
        if m[j] <= (1 + tol) * (d + 1):
            break
        step = (m[j] - d - 1) / ((d + 1) * (m[j] - 1))
        u *= 1 - step
        u[j] += step
    c = p.T @ u
    a = np.linalg.pinv((p.T * u) @ p - np.outer(c, c)) / d
    w = np.linalg.eigvalsh(a)
    axes = np.sort(1 / np.sqrt(np.maximum(w, 1e-300)))[::-1]
    grow = math.sqrt(max(1.0, float(np.max(np.einsum("ij,jk,ik->i", p - c, a, p - c)))))
    return c, axes * grow


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Intersection of a polygon with a convex one (Sutherland-Hodgman)."""
    if len(clip) < 3:
        return np.zeros((0, 2))
    area2 = np.dot(clip[:, 0], np.roll(clip[:, 1], -1)) - np.dot(clip[:, 1], np.roll(clip[:, 0], -1))
    ring = clip if area2 > 0 else clip[::-1]
    out = [tuple(q) for q in subject]
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        if not out:
            break
        s = [(b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) for q in out]
        new = []
        for j in range(len(out)):
            n = (j + 1) % len(out)
            if s[j] >= 0:
                new.append(out[j])
            if (s[j] >= 0) != (s[n] >= 0):
                f = s[j] / (s[j] - s[n])
                new.append((out[j][0] + f * (out[n][0] - out[j][0]), out[j][1] + f * (out[n][1] - out[j][1])))
        out = new
    return np.array(out, float).reshape(-1, 2)


def is_convex(p: np.ndarray) -> bool:
    return abs(shoelace(hull_2d(p)) - shoelace(p)) <= 1e-12 * shoelace(p)


def ears(p: np.ndarray) -> list[np.ndarray]:
    """Triangles of a simple polygon, by cutting off ears."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    ring = [q for q, r in zip(p.tolist(), np.roll(p, 1, 0).tolist(), strict=True) if q != r]
    if sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 0:
        ring.reverse()
    out = []
    while len(ring) > 2:
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            t = turn(a, b, c)
            others = (q for q in ring if q not in (a, b, c))
            if t == 0 or t > 0 and not any(turn(a, b, q) >= 0 and turn(b, c, q) >= 0 and turn(c, a, q) >= 0 for q in others):
                break
        else:
            raise ValueError("a polygon crosses itself")
        if t > 0:
            out.append(np.array([a, b, c]))
        del ring[i]
    return out


def clip_polygons(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Intersection of two simple polygons as convex pieces that do not overlap."""
    if len(a) < 3 or len(b) < 3:
        return []
    one, two = ([p] if is_convex(p) else ears(p) for p in (a, b))
    got = [clip_convex(s, t) for s in one for t in two]
    return [g for g in got if shoelace(g) > 0]


def chain_edges(edges: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Directed outline edges put together to rings, in order of their smallest corners."""
    nxt: dict[int, list[int]] = {}
    for u, v in sorted(edges):
        nxt.setdefault(u, []).append(v)
    rings = []
    while nxt:
        start = min(nxt)
        ring, at = [], start
        while at in nxt:
            ring.append(at)
            to = nxt[at].pop(0)
            if not nxt[at]:
                del nxt[at]
            at = to
            if at == start:
                break
        rings.append(ring)
    return rings


def levenberg(f, x: np.ndarray, y: np.ndarray, p0: Sequence[float], steps: int = 200) -> np.ndarray:
    """Least-squares parameters of y = f(x, p), with a numeric Jacobian."""
    p, lam = np.array(p0, float), 1e-3
    err = lambda q: y - f(x, q)
    r = err(p)
    best = float(r @ r)
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(f(x, p + h * e) - f(x, p - h * e)) / (2 * hk) for e, hk in zip(np.eye(len(p)), h, strict=True)], 1)
        a, g = jac.T @ jac, jac.T @ r
        while lam < 1e12:
            try:
                d = np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g)
            except np.linalg.LinAlgError:
                lam *= 10
                continue
            new = err(p + d)
            s = float(new @ new)
            if np.isfinite(s) and s <= best:
                small = best - s <= 1e-14 * max(best, 1e-300) and np.all(np.abs(d) <= 1e-10 * np.maximum(np.abs(p), 1e-10))
                p, r, best, lam = p + d, new, s, max(lam / 10, 1e-12)
                if small:
                    return p
                break
            lam *= 10
        else:
            return p
    return p
