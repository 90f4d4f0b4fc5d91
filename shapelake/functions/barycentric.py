"""Barycentric coordinates of triangles and tetrahedra, cell measures and geometric predicates."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from shapelake.functions.vector import Mat, Vec


def in_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """Coordinates of the projection of p (2-D or 3-D) onto the triangle's plane; NULL if the triangle is degenerate."""
    u, v, w = b - a, c - a, p - a
    uu, uv, vv, wu, wv = u.dot(u), u.dot(v), v.dot(v), w.dot(u), w.dot(v)
    d = uu * vv - uv * uv
    t = F.when(d != 0, (vv * wu - uv * wv) / d)
    s = F.when(d != 0, (uu * wv - uv * wu) / d)
    return Vec((F.lit(1.0) - t - s, t, s))


def in_tetrahedron(p: Vec, a: Vec, b: Vec, c: Vec, d: Vec) -> Vec:
    whole = signed_volume(a, b, c, d)
    part = lambda *corners: F.when(whole != 0, signed_volume(*corners) / whole)
    return Vec((part(p, b, c, d), part(a, p, c, d), part(a, b, p, d), part(a, b, c, p)))


def signed_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return (b - a).dot((c - a).cross(d - a)) / 6


def tetrahedron_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return F.abs(signed_volume(a, b, c, d))


def in_cell(weights: Vec, snap: float = 1e-8) -> Column:
    """All weights at least 0, values within the snap of 0 taken as 0."""
    inside = F.lit(True)
    for w in weights.parts:
        inside = inside & (w >= -snap)
    return inside


def interpolate(weights: Vec, values: list[Column]) -> Column:
    total = weights[0] * values[0]
    for w, v in zip(weights.parts[1:], values[1:]):
        total = total + w * v
    return total


def heron_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Area from the side lengths; a negative radicand gives 0."""
    x, y, z = (b - a).norm(), (c - b).norm(), (a - c).norm()
    s = (x + y + z) / 2
    q = s * (s - x) * (s - y) * (s - z)
    return F.when(q <= 0, 0.0).otherwise(F.sqrt(q))


def normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return (b - a).cross(c - a).normalized()


def circumcenter(a: Vec, b: Vec, c: Vec, d: Vec) -> Vec:
    """Centre of the sphere through four points; NULL if they lie in a plane."""
    m = Mat(tuple((q - a).parts for q in (b, c, d)))
    rhs = Vec(tuple((q - a).norm2() / 2 for q in (b, c, d)))
    return a + m.inv().apply(rhs)


def segment_parameter(p: Vec, a: Vec, b: Vec) -> Column:
    """Where on the segment (0 at a, 1 at b) the point nearest to p lies; 0 for a segment without length."""
    ab = b - a
    n = ab.norm2()
    return F.when(n > 0, F.least(F.greatest((p - a).dot(ab) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def segment_distance2(p: Vec, a: Vec, b: Vec) -> Column:
    return (p - (a + (b - a) * segment_parameter(p, a, b))).norm2()


def line_distance2(p: Vec, a: Vec, direction: Vec) -> Column:
    """Squared distance to a line; a direction without length leaves the point a."""
    n = direction.norm2()
    t = F.when(n > 0, (p - a).dot(direction) / n).otherwise(0.0)
    return (p - (a + direction * t)).norm2()


def line_meets_sphere(origin: Vec, direction: Vec, centre: Vec, radius: Column) -> Column:
    return line_distance2(centre, origin, direction) <= radius * radius


def triangle_candidates(p: Vec, a: Vec, b: Vec, c: Vec) -> dict[str, Column]:
    """The two candidates for the nearest point of a triangle, to be made columns before closest_of reads them:
    flat, the projection with its weights (NULL for degenerate triangles), and edge, the nearest of the three edges."""
    w = in_triangle(p, a, b, c)
    edges = []
    for k, (x, y) in enumerate(((a, b), (b, c), (c, a))):
        t = segment_parameter(p, x, y)
        edges.append(F.struct((p - (x + (y - x) * t)).norm2().alias("d2"), F.lit(k).alias("edge"), t.alias("t")))
    return {"flat": F.struct(*w.columns("u", "v", "w")), "edge": F.least(*edges)}


def closest_of(flat: Column, edge: Column, p: Vec, a: Vec, b: Vec, c: Vec) -> dict[str, Column]:
    """Nearest point of a triangle: weights of the corners, squared distance, and case (point, line, triangle).

    Inside the triangle's prism it is the projection, else the nearest edge; degenerate triangles have edges only.
    """
    w = Vec.from_struct(flat, ("u", "v", "w"))
    inside = F.coalesce((w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0), F.lit(False))
    t, k = edge["t"], edge["edge"]
    on_edge = [F.when(k == i, 1 - t).when(k == (i + 2) % 3, t).otherwise(0.0) for i in range(3)]
    corner = [F.when(inside, w[i]).otherwise(on_edge[i]) for i in range(3)]
    d2 = F.when(inside, (p - (a * w[0] + b * w[1] + c * w[2])).norm2()).otherwise(edge["d2"])
    case = F.when(inside, "triangle").when((t == 0) | (t == 1), "point").otherwise("line")
    return {"u": corner[0], "v": corner[1], "w": corner[2], "d2": d2, "case": case}


def line_triangle(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec) -> dict[str, Column]:
    """Where a line (both ways) meets a triangle: parameter t and corner weights; NULL if it doesn't or is parallel."""
    e1, e2, s = b - a, c - a, origin - a
    h = direction.cross(e2)
    det = e1.dot(h)
    over = F.when(F.abs(det) > 1e-12, det)
    u, q = s.dot(h) / over, s.cross(e1)
    v, t = direction.dot(q) / over, e2.dot(q) / over
    hit = F.coalesce((u >= 0) & (v >= 0) & (u + v <= 1), F.lit(False))
    return {"hit": hit, "t": F.when(hit, t), "u": F.when(hit, 1 - u - v), "v": F.when(hit, u), "w": F.when(hit, v)}


def containment_spheres(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, radii) of the least spheres around each of n sets of m points (n, m, 3), m from 1 to 4.

    The least sphere is the circumsphere, within their plane or line, of some of the points that holds the others: of
    all such spheres, the smallest.
    """
    n, m, _ = corners.shape
    best_centre, best = np.zeros((n, 3)), np.full(n, np.inf)
    for size in range(1, m + 1):
        for chosen in itertools.combinations(range(m), size):
            a = corners[:, chosen[0]]
            edges = corners[:, list(chosen[1:])] - a[:, None]
            # the centre is a + edges^T w with the same distance to all: 2 E E^T w = |E|^2
            gram = edges @ edges.transpose(0, 2, 1)
            w = np.einsum("nij,nj->ni", np.linalg.pinv(2 * gram), np.einsum("nii->ni", gram)) if size > 1 else np.zeros((n, 0))
            centre = a + np.einsum("ni,nid->nd", w, edges)
            radius = np.linalg.norm(centre - a, axis=1)
            reach = np.linalg.norm(corners - centre[:, None], axis=2).max(axis=1)
            holds = (reach <= radius + 1e-9 * (1 + radius)) & (reach < best - 1e-12 * (1 + reach))
            best_centre[holds], best[holds] = centre[holds], reach[holds]
    return best_centre, best
