"""Predicates between planar shapes in WKT columns, and the join of shapes that meet.

Predicates are Arrow-batched.  A null on either side gives null.  In a batch,
equal shapes are parsed once and equal pairs judged once.  Pairs of small shapes
of one form (kind and lengths of paths) are stacked and judged together; of a
large shape, segments are held against all segments of the other at once, after
both are narrowed to the common box.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.operators.geo import _col, even_odd, parse_wkt, spread

#: Distance up to which shapes touch.
TOUCH = 1e-9
# Pairs of shapes of more vertices than this, multiplied, are judged one by one; so many numbers are held at once; longer texts aren't kept parsed.
_STACKED, _AT_ONCE, _KEPT = 4096, 1 << 20, 500
# Which kinds can hold which.
_HOLDS = {
    "Point": {"Point"},
    "LineString": {"Point"},
    "Polygon": {"Point", "LineString", "Polygon"},
    "MultiPoint": {"Point", "MultiPoint"},
    "MultiLineString": {"Point", "LineString", "MultiLineString"},
    "MultiPolygon": {"Point", "Polygon", "MultiPolygon"},
}


class Shape:
    """parts: points as (1, 2) arrays, lines as (n, 2) arrays, polygons as lists of rings."""

    def __init__(self, text: str) -> None:
        self.kind, found = parse_wkt(text)
        if self.kind == "MultiPoint":
            found = [c[0] if isinstance(c[0], list) else c for c in found]
        items = (found if self.kind.startswith("Multi") else [found]) if found else []
        flat = lambda c: np.array(c, float)[:, :2]
        one = self.kind.removeprefix("Multi")
        self.parts = [[flat(r) for r in c] if one == "Polygon" else flat(c) if one == "LineString" else flat([c]) for c in items]
        paths = [r for p in self.parts for r in p] if one == "Polygon" else self.parts
        # A point is a segment of no length.
        self.segments = np.concatenate([np.hstack([p[:-1], p[1:]]) if len(p) > 1 else np.hstack([p, p]) for p in paths] or [np.zeros((0, 4))])
        self.vertices = np.concatenate(paths) if paths else np.zeros((0, 2))
        self.polygons = self.parts if one == "Polygon" else []
        self.form = (self.kind, tuple(tuple(map(len, p)) if one == "Polygon" else len(p) for p in self.parts))

    def box(self) -> tuple[float, float, float, float] | None:
        return (*self.vertices.min(axis=0), *self.vertices.max(axis=0)) if len(self.vertices) else None


def _inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Which points lie in a polygon: in its shell and in no hole."""
    found = even_odd(points[:, 0], points[:, 1], rings[0])
    for hole in rings[1:]:
        found &= ~even_odd(points[:, 0], points[:, 1], hole)
    return found


def _to_segments(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distance of each point to each segment."""
    a, d = segments[None, :, :2], segments[None, :, 2:] - segments[None, :, :2]
    p = points[:, None]
    share = np.clip(((p - a) * d).sum(2) / np.maximum((d * d).sum(2), np.finfo(float).tiny), 0, 1)
    return np.hypot(*np.moveaxis(p - a - share[..., None] * d, 2, 0))


def _cross(segment: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a segment and each of others pass through each other."""
    side = lambda o, d, p: d[..., 0] * (p[..., 1] - o[..., 1]) - d[..., 1] * (p[..., 0] - o[..., 0])
    a, b, c, d = segment[..., :2], segment[..., 2:], others[..., :2], others[..., 2:]
    return (side(a, b - a, c) * side(a, b - a, d) < 0) & (side(c, d - c, a) * side(c, d - c, b) < 0)


def _near_box(segments: np.ndarray, box: tuple) -> np.ndarray:
    low, high = np.minimum(segments[:, :2], segments[:, 2:]), np.maximum(segments[:, :2], segments[:, 2:])
    return segments[((low <= np.array(box[2:]) + TOUCH) & (high >= np.array(box[:2]) - TOUCH)).all(axis=1)]


def intersects(a: Shape, b: Shape) -> bool:
    """Whether shapes share a point; an empty shape meets nothing."""
    if not len(a.vertices) or not len(b.vertices):
        return False
    if any(_inside(y.vertices, p).any() for x, y in ((a, b), (b, a)) for p in x.polygons):
        return True
    few, many = sorted((_near_box(a.segments, b.box()), _near_box(b.segments, a.box())), key=len)
    if not len(few):
        return False
    for s in few:
        ends = np.vstack([s[:2], s[2:]])
        if (_to_segments(ends, many) <= TOUCH).any() or _cross(s, many).any():
            return True
        if (_to_segments(np.vstack([many[:, :2], many[:, 2:]]), s[None]) <= TOUCH).any():
            return True
    return False


def _same_ring(a: np.ndarray, b: np.ndarray) -> bool:
    """Equal vertices from any start in either direction."""
    a, b = (r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in (a, b))
    return len(a) == len(b) and any(np.array_equal(a, np.roll(turned, -k, axis=0)) for turned in (b, b[::-1]) for k in range(len(b)))


def _same_part(kind: str, a, b) -> bool:
    if kind == "Polygon":
        return len(a) == len(b) and all(map(_same_ring, a, b))
    return np.array_equal(a, b) or np.array_equal(a, b[::-1])


def equals(a: Shape, b: Shape) -> bool:
    """Equal kinds and parts, whatever the order of parts, the start of rings and the direction of paths."""
    one = a.kind.removeprefix("Multi")
    if a.kind != b.kind or len(a.parts) != len(b.parts):
        return False
    return all(any(_same_part(one, p, q) for q in y.parts) for x, y in ((a, b), (b, a)) for p in x.parts)


def _holds(whole: str, outer, part: str, inner) -> bool:
    if whole == "Polygon":
        return bool(_inside(inner[0] if part == "Polygon" else inner, outer).all())
    if whole == "LineString" and part == "Point":
        return len(outer) > 1 and bool((_to_segments(inner, np.hstack([outer[:-1], outer[1:]])) <= TOUCH).any())
    return _same_part(whole, outer, inner)


def contains(a: Shape, b: Shape) -> bool:
    """Whether each part of b lies in one part of a, judged by its vertices; some pairs of kinds never do."""
    one, part = a.kind.removeprefix("Multi"), b.kind.removeprefix("Multi")
    return b.kind in _HOLDS[a.kind] and bool(b.parts) and all(any(_holds(one, p, part, q) for p in a.parts) for q in b.parts)


class _Stack:
    """Shapes of one form, with the pair as the first axis of each array."""

    def __init__(self, kind: str, form: tuple, vertices: np.ndarray, segments: np.ndarray) -> None:
        self.kind, self.form, self.vertices, self.segments = kind, form, vertices, segments
        self.one = kind.removeprefix("Multi")
        self.parts, at = [], 0
        for lengths in form:
            rings = []
            for n in lengths if self.one == "Polygon" else (lengths,):
                rings.append(vertices[:, at : at + n])
                at += n
            self.parts.append(rings if self.one == "Polygon" else rings[0])
        self.polygons = self.parts if self.one == "Polygon" else []

    def __getitem__(self, which: np.ndarray) -> _Stack:
        return _Stack(self.kind, self.form, self.vertices[which], self.segments[which])


def _stacked_inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """_inside for each pair."""

    def odd(ring: np.ndarray) -> np.ndarray:
        x, y = points[..., 0], points[..., 1]
        inside = np.zeros(x.shape, bool)
        for k in range(ring.shape[1]):
            (x1, y1), (x2, y2) = (ring[:, j, :, None].swapaxes(0, 1) for j in (k, (k + 1) % ring.shape[1]))
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return inside

    found = odd(rings[0])
    for hole in rings[1:]:
        found &= ~odd(hole)
    return found


def _stacked_to_segments(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """_to_segments for each pair."""
    a, d = segments[:, None, :, :2], segments[:, None, :, 2:] - segments[:, None, :, :2]
    p = points[:, :, None]
    share = np.clip(((p - a) * d).sum(3) / np.maximum((d * d).sum(3), np.finfo(float).tiny), 0, 1)
    return np.hypot(*np.moveaxis(p - a - share[..., None] * d, 3, 0))


def _stacked_near(segments: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """Which segments _near_box keeps of each pair."""
    low, high = np.minimum(segments[..., :2], segments[..., 2:]), np.maximum(segments[..., :2], segments[..., 2:])
    return ((low <= vertices.max(axis=1, keepdims=True) + TOUCH) & (high >= vertices.min(axis=1, keepdims=True) - TOUCH)).all(axis=2)


def _stacked_intersects(a: _Stack, b: _Stack) -> np.ndarray:
    found = np.zeros(len(a.vertices), bool)
    for x, y in ((a, b), (b, a)):
        for p in x.polygons:
            found |= _stacked_inside(y.vertices, p).any(axis=1)
    near = _stacked_near(a.segments, b.vertices)[:, :, None] & _stacked_near(b.segments, a.vertices)[:, None, :]
    rest = np.flatnonzero(~found & near.any(axis=(1, 2)))
    s, t, near = a.segments[rest], b.segments[rest], near[rest]
    met = _cross(s[:, :, None], t[:, None])
    for k in (0, 2):
        met |= _stacked_to_segments(s[..., k : k + 2], t) <= TOUCH
        met |= (_stacked_to_segments(t[..., k : k + 2], s) <= TOUCH).swapaxes(1, 2)
    found[rest] = (met & near).any(axis=(1, 2))
    return found


def _stacked_holds(whole: str, outer, part: str, inner) -> np.ndarray:
    if whole == "Polygon":
        return _stacked_inside(inner[0] if part == "Polygon" else inner, outer).all(axis=1)
    if whole == "LineString" and part == "Point":
        return (_stacked_to_segments(inner, np.concatenate([outer[:, :-1], outer[:, 1:]], axis=2)) <= TOUCH).any(axis=(1, 2))
    if outer.shape != inner.shape:
        return np.zeros(len(outer), bool)
    return (outer == inner).all(axis=(1, 2)) | (outer == inner[:, ::-1]).all(axis=(1, 2))


def _stacked_contains(a: _Stack, b: _Stack) -> np.ndarray:
    found = np.full(len(a.vertices), b.kind in _HOLDS[a.kind])
    if found.any():
        for q in b.parts:
            found &= np.any([_stacked_holds(a.one, p, b.one, q) for p in a.parts], axis=0)
    return found


@lru_cache(1 << 14)
def _kept(text: str) -> Shape:
    return Shape(text)


def _shape(text: str) -> Shape:
    """A parsed shape; small ones are kept from batch to batch."""
    return _kept(text) if len(text) <= _KEPT else Shape(text)


def judged(a: list[Shape], b: list[Shape], i: np.ndarray, j: np.ndarray, test: Callable[[Shape, Shape], bool], stacked: Callable[[_Stack, _Stack], np.ndarray] | None) -> np.ndarray:
    """test of the pairs (a[i], b[j]); stacked does the same for pairs of one form at once."""
    out = np.zeros(len(i), bool)

    def by_form(shapes: list[Shape]) -> tuple[np.ndarray, np.ndarray, list[_Stack], np.ndarray]:
        """The number of each shape's form, its place among those, each form's shapes and their vertices."""
        number, forms = np.zeros(len(shapes), int), {}
        place = np.zeros(len(shapes), int)
        for k, s in enumerate(shapes):
            same = forms.setdefault(s.form, (len(forms), []))
            number[k], place[k] = same[0], len(same[1])
            same[1].append(s)
        stacks = [_Stack(*f, np.stack([s.vertices for s in same]), np.stack([s.segments for s in same])) for f, (_, same) in forms.items()]
        return number, place, stacks, np.array([s.vertices.shape[1] for s in stacks], int)

    (fa, pa, sa, na), (fb, pb, sb, nb) = by_form(a), by_form(b)
    pair = fa[i] * len(sb) + fb[j]
    order = np.argsort(pair, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
        f, g = fa[i[same[0]]], fb[j[same[0]]]
        work = na[f] * nb[g]
        if stacked is None or not 0 < work <= _STACKED:
            out[same] = [test(a[x], b[y]) for x, y in zip(i[same], j[same])]
            continue
        for k in range(0, len(same), step := max(_AT_ONCE // work // 8, 1)):
            few = same[k : k + step]
            out[few] = stacked(sa[f][pa[i[few]]], sb[g][pb[j[few]]])
    return out


def _predicate(test: Callable[[Shape, Shape], bool], stacked: Callable[[_Stack, _Stack], np.ndarray] | None = None) -> Callable[..., Column]:
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        (i, x), (j, y) = pd.factorize(a), pd.factorize(b)
        known = (i >= 0) & (j >= 0)
        pairs, back = np.unique(i[known] * max(len(y), 1) + j[known], return_inverse=True)
        out = np.full(len(a), None, object)
        out[known] = judged([_shape(t) for t in x], [_shape(t) for t in y], *np.divmod(pairs, max(len(y), 1)), test, stacked)[back]
        return pd.Series(out, dtype="object")

    return lambda a, b: F.pandas_udf(judge, "boolean")(_col(a), _col(b))


st_intersects = _predicate(intersects, _stacked_intersects)
st_contains = _predicate(contains, _stacked_contains)
st_within = _predicate(lambda a, b: contains(b, a), lambda a, b: _stacked_contains(b, a))
st_equals = _predicate(equals)


def _boxes(wkt: pd.Series) -> pd.DataFrame:
    found = [None if t is None else Shape(t).box() for t in wkt]
    return pd.DataFrame([b or (None,) * 4 for b in found], columns=["x0", "y0", "x1", "y1"], dtype="float64")


def st_box(wkt) -> Column:
    """The box of each shape as (x0, y0, x1, y1); null fields for null and empty shapes."""
    return F.pandas_udf(_boxes, "x0 double, y0 double, x1 double, y1 double")(_col(wkt))


def shape_join(left: DataFrame, right: DataFrame, a: str, b: str, cell: float, test: Callable[..., Column] = st_intersects) -> DataFrame:
    """Pairs whose shapes a and b meet and pass test.

    Equal shapes meet the same shapes, so each is boxed, dealt and judged once,
    however many rows have it; the rows join the pairs of shapes that passed, by
    digest.  Shapes go to the grid cells that their boxes touch and join on equal
    cells.  A pair of boxes counts only in the cell where their common part
    begins, so no pair comes twice and none needs a distinct.  Shapes many cells
    wide are sent once for each cell: take cells about as large as a usual shape.
    """
    digest = lambda wkt: F.unhex(F.sha2(F.col(wkt), 256))

    def dealt(df: DataFrame, wkt: str, box: str) -> DataFrame:
        # An empty shape's span is null and goes to no cell; a filter on its box would move below distinct and box every row.
        boxed = df.select(wkt).where(F.col(wkt).isNotNull()).distinct().withColumn(box, st_box(wkt))
        # Boxes that touch within TOUCH may lie in neighbouring cells.
        span = lambda c: F.sequence(F.floor((F.col(f"{box}.{c}0") - TOUCH) / cell), F.floor((F.col(f"{box}.{c}1") + TOUCH) / cell))
        return boxed.withColumn("__x", F.explode(span("x"))).withColumn("__y", F.explode(span("y")))

    met = dealt(left, a, "__a").join(dealt(right, b, "__b"), ["__x", "__y"])
    for c in "xy":
        low = F.greatest(f"__a.{c}0", f"__b.{c}0") - TOUCH
        met = met.where((F.floor(low / cell) == F.col(f"__{c}")) & (low <= F.least(f"__a.{c}1", f"__b.{c}1") + TOUCH))
    # Many pairs come of few bytes, so candidates and rows are spread out before they are judged and multiplied.
    pairs = spread(met).where(test(F.col(a), F.col(b))).select(digest(a).alias("__p"), digest(b).alias("__q"))
    rows = left.withColumn("__p", digest(a)).join(pairs, "__p").drop("__p")
    return spread(rows, "__q").join(right.withColumn("__q", digest(b)), "__q").drop("__q")
