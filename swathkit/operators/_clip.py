"""The part of one polygon inside others, by horizontal slabs: between the heights of all corners and crossings no two edges cross,
so the edges of a slab in order of x tell where the inside begins and ends, whatever holes, dents and shared edges there are."""

from __future__ import annotations

import math
from collections import defaultdict

Ring = list[tuple[float, float]]


def _edges(rings: list[Ring], owner: int) -> list[tuple]:
    """Edges that aren't level, the lower end first: (x0, y0, x1, y1, owner)."""
    out = []
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
            if ay != by:
                out.append((ax, ay, bx, by, owner) if ay < by else (bx, by, ax, ay, owner))
    return out


def _x(e: tuple, y: float) -> float:
    if y == e[1]:
        return e[0]
    return e[2] if y == e[3] else e[0] + (e[2] - e[0]) * ((y - e[1]) / (e[3] - e[1]))


def _crossing_heights(edges: list[tuple]) -> set[float]:
    """Heights at which edges cross; only edges that overlap in y are compared."""
    out, active = set(), []
    for e in sorted(edges, key=lambda e: e[1]):
        active = [f for f in active if f[3] > e[1]]
        for f in active:
            low, high = max(e[1], f[1]), min(e[3], f[3])
            a, b = _x(e, low) - _x(f, low), _x(e, high) - _x(f, high)
            if a * b < 0:
                y = low + (high - low) * (a / (a - b))
                if low < y < high:
                    out.add(y)
        active.append(e)
    return out


class _Level:
    """The x of corners at one height; those nearer than a tolerance are one."""

    def __init__(self, xs: list[float], near: float):
        self.of, last = {}, None
        for x in sorted(set(xs)):
            last = x if last is None or x - last > near else last
            self.of[x] = last


def _slabs(edges: list[tuple], heights: list[float], clips: int, windowed: bool):
    """For each slab, the (left edge, right edge) between which the inside lies."""
    order = sorted(edges, key=lambda e: e[1])
    at, active = 0, []
    for low, high in zip(heights, heights[1:]):
        while at < len(order) and order[at][1] <= low:
            active.append(order[at])
            at += 1
        active = [e for e in active if e[3] >= high]
        middle = (low + high) / 2
        odd, begun, found = [False] * (clips + 2), None, []
        for e in sorted(active, key=lambda e: (_x(e, middle), e[4])):
            odd[e[4]] = not odd[e[4]]
            inside = odd[0] and any(odd[1 : clips + 1]) and (odd[-1] or not windowed)
            if inside and begun is None:
                begun = e
            elif not inside and begun is not None:
                found.append((begun, e))
                begun = None
        yield low, high, found


def intersection(subject: list[Ring], clips: list[list[Ring]], window: tuple[float, float, float, float] | None = None) -> list[tuple[Ring, list[Ring], float]]:
    """(outline, holes, area) of each piece of the subject (its outline, then holes) inside any of the clips and the window.

    Outlines run counter-clockwise, holes clockwise. Pieces without area are left out.
    """
    edges = _edges(subject, 0)
    for k, rings in enumerate(clips):
        edges += _edges(rings, k + 1)
    if window:
        x0, y0, x1, y1 = window
        edges += _edges([[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]], len(clips) + 1)
    size = max((abs(v) for e in edges for v in e[:4]), default=0.0)
    near = size * 1e-12
    heights: list[float] = []
    for y in sorted({e[1] for e in edges} | {e[3] for e in edges} | _crossing_heights(edges)):
        if not heights or y > heights[-1]:
            heights.append(y)
    below: dict[float, list] = defaultdict(list)  # what ends at a height, and what starts there
    above: dict[float, list] = defaultdict(list)
    for low, high, found in _slabs(edges, heights, len(clips), window is not None):
        for left, right in found:
            above[low].append((left, right))
            below[high].append((left, right))
    levels = {y: _Level([_x(e, y) for pair in (*below[y], *above[y]) for e in pair], near) for y in {*below, *above}}
    ends = lambda y, pair: tuple(levels[y].of[_x(e, y)] for e in pair)
    after: dict[tuple, list] = defaultdict(list)  # the outline, inside on the left
    tops = iter(heights[1:])
    for low, high in zip(heights, tops):
        for pair in above[low]:
            (l0, r0), (l1, r1) = ends(low, pair), ends(high, pair)
            if (l0, l1) != (r0, r1):
                after[l1, high].append((l0, low))
                after[r0, low].append((r1, high))
    for y in levels:
        cover: dict[float, list] = defaultdict(lambda: [0, 0])
        for side, pairs in enumerate((below[y], above[y])):
            for pair in pairs:
                a, b = ends(y, pair)
                if a < b:
                    cover[a][side] += 1
                    cover[b][side] -= 1
        under = over = 0
        xs = sorted(cover)
        for a, b in zip(xs, xs[1:]):
            under, over = under + cover[a][0], over + cover[a][1]
            if over and not under:
                after[a, y].append((b, y))
            elif under and not over:
                after[b, y].append((a, y))
    return _pieces(after)


def _pieces(after: dict[tuple, list]) -> list[tuple[Ring, list[Ring], float]]:
    outer, inner = [], []
    for start in sorted(after):
        while after[start]:
            ring, here, came = [start], after[start].pop(), start
            while here != start:
                ring.append(here)
                ways = after[here]
                # where outlines touch, the sharpest turn to the left keeps them apart
                turn = lambda to: (math.atan2(to[1] - here[1], to[0] - here[0]) - math.atan2(here[1] - came[1], here[0] - came[0]) + math.pi) % (2 * math.pi)  # noqa: B023, E731
                to = ways.pop(max(range(len(ways)), key=lambda k: turn(ways[k])) if len(ways) > 1 else 0)
                came, here = here, to
            ring = _straightened(ring)
            area = _area(ring)
            if area > 0:
                outer.append((ring, [], area))
            elif area < 0:
                inner.append((ring, area))
    outer.sort(key=lambda o: o[2])
    total = [o[2] for o in outer]
    for ring, area in inner:
        (ax, ay), (bx, by) = ring[0], ring[1]
        # just left of an edge of the hole lies the piece that it is a hole of
        step = 1e-6
        px, py = (ax + bx) / 2 - (by - ay) * step, (ay + by) / 2 + (bx - ax) * step
        k = next((k for k, o in enumerate(outer) if _holds(o[0], px, py)), None)
        if k is not None:
            outer[k][1].append(ring)
            total[k] += area
    return sorted((o[0], o[1], a) for o, a in zip(outer, total))


def _area(ring: Ring) -> float:
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]])) / 2


def _holds(ring: Ring, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _straightened(ring: Ring) -> Ring:
    """Without the corners at which a ring goes straight on."""
    out: Ring = []
    for k, (bx, by) in enumerate(ring):
        (ax, ay), (cx, cy) = out[-1] if out else ring[-1], ring[(k + 1) % len(ring)]
        cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if abs(cross) > 1e-12 * (abs(bx - ax) + abs(by - ay)) * (abs(cx - bx) + abs(cy - by)) or (bx - ax) * (cx - bx) + (by - ay) * (cy - by) < 0:
            out.append((bx, by))
    return out if len(out) > 2 else ring
