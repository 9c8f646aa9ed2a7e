"""Arithmetic on array columns; all in double precision, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if either is null or their lengths differ."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """L2 norm."""
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    """Cosine similarity with clamped norms, so that a zero vector gives 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def normalize(a: Column, eps: float = EPS) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(_double(a), lambda x: x / n)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(_double(a), lambda x: x * k)


def project_out(a: Column, v: Column) -> Column:
    """``a`` without its part along ``v``."""
    k = dot(a, v) / F.greatest(dot(v, v), F.lit(EPS * EPS))
    return F.zip_with(_double(a), _double(v), lambda x, y: x - k * y)


def literal(v: list[float]) -> Column:
    """A vector known on the driver, as a constant of the plan."""
    return F.array(*(F.lit(float(x)) for x in v))


def pool(states: Column, how: str) -> Column:
    """Mean, sum or last of an array of vectors of one length; null of an empty one."""
    last = F.try_element_at(states, F.lit(-1))
    if how == "last":
        return _double(last)
    if how not in ("mean", "sum"):
        raise ValueError(f"pooling must be mean, sum or last, not {how}")
    zero = F.transform(_double(last), lambda x: x * 0.0)
    total = F.aggregate(states, zero, lambda s, v: F.zip_with(s, _double(v), lambda x, y: x + y))
    return total if how == "sum" else F.transform(total, lambda x: x / F.size(states))
