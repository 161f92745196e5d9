"""Similarity of vectors as column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = {"cosine": "cosine", "l2": "l2", "euclidean": "l2", "dot": "dot", "dot_product": "dot"}


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def peak(a: Column) -> Column:
    return F.greatest(F.array_max(F.transform(a, lambda x: F.abs(x))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Inner product over the product of norms; 0 where that product is under 1e-12. Vectors too large to square are scaled first."""
    # One pass for the three sums: every lambda is called once per place.
    sums = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
        lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy")),
        lambda s: F.when((F.abs(s["xy"]) < float("inf")) & (F.sqrt(s["xx"]) * F.sqrt(s["yy"]) < float("inf")), F.when(F.sqrt(s["xx"]) * F.sqrt(s["yy"]) < 1e-12, F.lit(0.0)).otherwise(s["xy"] / (F.sqrt(s["xx"]) * F.sqrt(s["yy"])))),
    )
    pa, pb = F.greatest(peak(a), F.lit(1e-300)), F.greatest(peak(b), F.lit(1e-300))
    sa, sb = F.transform(a, lambda x: x / pa), F.transform(b, lambda x: x / pb)
    return F.coalesce(sums, inner(sa, sb) / (norm(sa) * norm(sb)))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: cosine, inner product, or the negative Euclidean distance; null unless both have the same length and the score is finite."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    value = {"cosine": cosine, "l2": lambda x, y: -distance(x, y), "dot": inner}[METRICS[metric]](a, b)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(finite, value))


def likeness(metric: str, a: Column, b: Column) -> Column:
    """The similarity that a threshold filter uses: cosine (0 if a norm is under 1e-10), 1 / (1 + distance), or the inner product; other names mean cosine."""
    if metric == "euclidean":
        value = 1.0 / (1.0 + distance(a, b))
    elif metric == "dot_product":
        value = inner(a, b)
    else:
        value = F.when((norm(a) < 1e-10) | (norm(b) < 1e-10), F.lit(0.0)).otherwise(inner(a, b) / (norm(a) * norm(b)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def sparse_score(metric: str, i: Column, x: Column, j: Column, y: Column) -> Column:
    """Of two sparse vectors (rising indices i, values x; j, y); cosine is 0 for a zero norm and kept within -1..1."""
    a, b = F.map_from_arrays(i, x), F.map_from_arrays(j, y)
    both = F.array_intersect(i, j)
    product = F.aggregate(both, F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))
    if METRICS.get(metric) == "dot":
        return product
    if METRICS.get(metric) == "l2":
        every = F.array_union(i, j)
        zero = F.lit(0.0)
        gap = lambda k: F.coalesce(F.try_element_at(a, k), zero) - F.coalesce(F.try_element_at(b, k), zero)
        return -F.sqrt(F.aggregate(every, F.lit(0.0), lambda s, k: s + gap(k) * gap(k)))
    if METRICS.get(metric) == "cosine":
        size = norm(x) * norm(y)
        return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / size)))
    raise ValueError(f"unknown metric {metric!r}")
