"""Polygon texts as arrays of points, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a column named twice in an expression of lambdas is computed twice."""
    return F.transform(F.array(value), use)[0]


def rings(text: Column) -> Column:
    """``array<array<struct<x, y>>>`` of the rings of a POLYGON or MULTIPOLYGON text."""
    inner = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(inner, lambda ring: F.transform(F.split(F.trim(ring), r"\s*,\s*"), _point))


def _point(text: Column) -> Column:
    return _let(F.split(F.trim(text), r"\s+"), lambda parts: F.struct(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y")))


def _from(ring: Column, origin: Column) -> Column:
    """The points seen from another one: far from the origin, products of whole coordinates would leave no digits for the area."""
    return F.transform(ring, lambda p: F.struct((p.x - origin.x).alias("x"), (p.y - origin.y).alias("y")))


def _edges(ring: Column) -> Column:
    """Each point with its cross product and sums with the next one around the ring."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct((a.x * b.y - b.x * a.y).alias("c"), (a.x + b.x).alias("sx"), (a.y + b.y).alias("sy")))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + value(item))


def centroid(text: Column) -> Column:
    """Area (absolute) and centroid of the ring with the most points; the mean point where the area vanishes."""
    return _of_rings(rings(text))


def measured(text: Column) -> Column:
    """``centroid`` with ``n_rings``, the number of rings: the text is taken apart once."""
    return _let(rings(text), lambda found: _let(_of_rings(found), lambda c: F.struct(F.size(found).alias("n_rings"), c.area.alias("area"), c.x.alias("x"), c.y.alias("y"))))


def _of_rings(found: Column) -> Column:
    by_size = F.array_sort(F.transform(found, lambda ring: F.struct((-F.size(ring)).alias("n"), ring.alias("ring"))))
    return _let(by_size[0]["ring"], lambda ring: _let(_let(_from(ring, ring[0]), _edges), lambda edges: _let(_sum(edges, lambda e: e.c), lambda twice: _centre(ring, edges, twice))))


def _centre(ring: Column, edges: Column, twice: Column) -> Column:
    flat = F.abs(twice) < 1e-12
    count = F.size(ring)
    x = F.when(flat, _sum(ring, lambda p: p.x) / count).otherwise(ring[0].x + _sum(edges, lambda e: e.sx * e.c) / (3 * twice))
    y = F.when(flat, _sum(ring, lambda p: p.y) / count).otherwise(ring[0].y + _sum(edges, lambda e: e.sy * e.c) / (3 * twice))
    return F.struct((F.abs(twice) / 2).alias("area"), x.alias("x"), y.alias("y"))
