"""Delaunay triangulation of the points of one tile, by insertion, with exact tests; and interpolation in it."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

OUT = -1  # the vertex beyond the hull: (u, v, OUT) is the outside of the hull's edge


class Delaunay:
    """``after[u, v]`` is the third corner, counter-clockwise, of the triangle on the left of the edge from u to v.

    Points must differ. If they all lie on one line there are no triangles.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x.tolist(), y.tolist()
        self.exact: list[tuple[int, int] | None] = [None] * len(x)
        self.scale = max((Fraction(v).denominator for v in [*self.x, *self.y]), default=1)  # all are powers of two
        self.rank = np.argsort(np.lexsort((y, x)), kind="stable").tolist()
        self.after: dict[tuple[int, int], int] = {}
        order = self._order(x, y)
        first = next((k for k in range(2, len(order)) if self.turn(order[0], order[1], order[k])), None)
        if first is None:
            return
        a, b, c = order[0], order[1], order[first]
        if self.turn(a, b, c) < 0:
            a, b = b, a
        for u, v, w in ((a, b, c), (b, a, OUT), (c, b, OUT), (a, c, OUT)):
            self._add(u, v, w)
        self.near = (a, b)
        for k, p in enumerate(order[2:], 2):
            if k != first:
                self._insert(p)

    @staticmethod
    def _order(x: np.ndarray, y: np.ndarray) -> list[int]:
        """Along rows of squares, back and forth, so that the walk to the next point is short."""
        rows = max(1, round(math.sqrt(len(x) / 2)))
        low, high = (y.min(), y.max()) if len(y) else (0.0, 0.0)
        band = np.clip(((y - low) / (high - low) * rows).astype(int), 0, rows - 1) if high > low else np.zeros(len(y), int)
        return np.lexsort((np.where(band % 2, -x, x), band)).tolist()

    def _whole(self, k: int) -> tuple[int, int]:
        if self.exact[k] is None:
            self.exact[k] = tuple(int(Fraction(v) * self.scale) for v in (self.x[k], self.y[k]))
        return self.exact[k]

    def turn(self, a: int, b: int, c: int) -> int:
        """1 if c lies left of the line from a to b, -1 if right, 0 on it; exact."""
        x, y = self.x, self.y
        left, right = (x[a] - x[c]) * (y[b] - y[c]), (y[a] - y[c]) * (x[b] - x[c])
        d = left - right
        if abs(d) > 4e-16 * (abs(left) + abs(right)):
            return 1 if d > 0 else -1
        (ax, ay), (bx, by), (cx, cy) = map(self._whole, (a, b, c))
        d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        return (d > 0) - (d < 0)

    def inside(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether p lies in the circle through a, b, c (counter-clockwise); exact, four on one circle by the rule of the module."""
        x, y = self.x, self.y
        px, py = x[p], y[p]
        ax, ay, bx, by, cx, cy = x[a] - px, y[a] - py, x[b] - px, y[b] - py, x[c] - px, y[c] - py
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        d = aa * (bx * cy - by * cx) + bb * (cx * ay - cy * ax) + cc * (ax * by - ay * bx)
        size = aa * (abs(bx * cy) + abs(by * cx)) + bb * (abs(cx * ay) + abs(cy * ax)) + cc * (abs(ax * by) + abs(ay * bx))
        if abs(d) > 1.2e-15 * size:
            return d > 0
        (px, py), *rest = map(self._whole, (p, a, b, c))
        (ax, ay), (bx, by), (cx, cy) = ((u - px, v - py) for u, v in rest)
        d = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if d:
            return d > 0
        top = min((a, b, c, p), key=self.rank.__getitem__)  # the one raised most
        if top == p:
            return False
        others = {a: (p, b, c), b: (a, p, c), c: (a, b, p)}[top]
        return self.turn(*others) > 0

    def _conflict(self, u: int, v: int, w: int, p: int) -> bool:
        if OUT not in (u, v, w):
            return self.inside(u, v, w, p)
        while w != OUT:
            u, v, w = v, w, u
        side = self.turn(u, v, p)
        if side:
            return side > 0
        x, y = self.x, self.y
        return min((x[u], y[u]), (x[v], y[v])) < (x[p], y[p]) < max((x[u], y[u]), (x[v], y[v]))

    def _add(self, u: int, v: int, w: int) -> None:
        self.after[u, v], self.after[v, w], self.after[w, u] = w, u, v

    def _drop(self, u: int, v: int, w: int) -> None:
        del self.after[u, v], self.after[v, w], self.after[w, u]

    def walk(self, turn, start: tuple[int, int]) -> tuple[int, int, int]:
        """The triangle that holds a place, or the outside of a hull edge it lies beyond; ``turn(u, v)`` is the side of u-v the place lies on."""
        u, v = start
        w = self.after[u, v]
        if OUT in (u, v, w):
            while w != OUT:
                u, v, w = v, w, u
            u, v = v, u
            w = self.after[u, v]
        came = None
        while w != OUT:
            for a, b, c in ((u, v, w), (v, w, u), (w, u, v)):
                if (a, b) != came and turn(a, b) < 0:
                    u, v = b, a
                    came, w = (u, v), self.after[u, v]
                    break
            else:
                return u, v, w
        return u, v, w

    def _insert(self, p: int) -> None:
        u, v, w = self.walk(lambda a, b: self.turn(a, b, p), self.near)
        self._drop(u, v, w)
        edges, rim = [(u, v), (v, w), (w, u)], []
        while edges:
            u, v = edges.pop()
            w = self.after.get((v, u))
            if w is None:
                continue
            if self._conflict(v, u, w, p):
                self._drop(v, u, w)
                edges += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            self._add(u, v, p)
        self.near = next((u, v) for u, v in rim if u != OUT and v != OUT)

    def triangles(self) -> list[tuple[int, int, int]]:
        return [(u, v, w) for (u, v), w in self.after.items() if OUT not in (u, v, w) and u < v and u < w]

    def circumradius(self, u: int, v: int, w: int) -> float:
        x, y = self.x, self.y
        a, b, c = (math.hypot(x[i] - x[j], y[i] - y[j]) for i, j in ((u, v), (v, w), (w, u)))
        twice = abs((x[v] - x[u]) * (y[w] - y[u]) - (y[v] - y[u]) * (x[w] - x[u]))
        return a * b * c / (2 * twice) if twice else math.inf


def _side(x, y, u: int, v: int, qx: float, qy: float) -> int:
    left, right = (x[u] - qx) * (y[v] - qy), (y[u] - qy) * (x[v] - qx)
    d = left - right
    if abs(d) > 4e-16 * (abs(left) + abs(right)):
        return 1 if d > 0 else -1
    ux, uy, vx, vy, ex, ey = map(Fraction, (x[u], y[u], x[v], y[v], qx, qy))
    d = (ux - ex) * (vy - ey) - (uy - ey) * (vx - ex)
    return (d > 0) - (d < 0)


def interpolate(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray, reach: float, fill: bool) -> np.ndarray:
    """Heights at places (gx, gy). Points differ. nan where no triangle within ``reach`` holds the place and no point, if asked for, is within twice that."""
    out = np.full(len(gx), np.nan)
    if not len(x):
        return out
    net = Delaunay(x, y)
    if net.after:
        at, held = net.near, {}
        for k, (qx, qy) in enumerate(zip(gx.tolist(), gy.tolist())):
            found = net.walk(lambda a, b: _side(net.x, net.y, a, b, qx, qy), at)
            if OUT in found:
                continue
            at = found[:2]
            corners = tuple(sorted(found, key=net.rank.__getitem__))  # one order, so that rounding doesn't depend on the tile
            if corners not in held:
                held[corners] = net.circumradius(*corners) <= reach
            if held[corners]:
                a, b, c = corners
                bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
                d = bx * cy - cx * by
                s, t = ((qx - x[a]) * cy - cx * (qy - y[a])) / d, (bx * (qy - y[a]) - (qx - x[a]) * by) / d
                out[k] = z[a] + s * (z[b] - z[a]) + t * (z[c] - z[a])
    if fill:
        order = np.lexsort((y, x))  # of equally near points the first by (x, y)
        rest = np.flatnonzero(np.isnan(out))
        for at in range(0, len(rest), max(1, (1 << 20) // len(x))):
            part = rest[at : at + max(1, (1 << 20) // len(x))]
            far = np.hypot(gx[part, None] - x[order][None, :], gy[part, None] - y[order][None, :])
            best = far.argmin(1)
            near = far[np.arange(len(part)), best] <= 2 * reach
            out[part[near]] = z[order][best[near]]
    return out
