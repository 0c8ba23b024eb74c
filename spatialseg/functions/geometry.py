"""Column helpers for geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
SEGMENT = ["cloud_id", "seg_id"]


def along(*keys: str):
    """The window that walks a polyline."""
    return Window.partitionBy(*(keys or SEGMENT)).orderBy("ord")


def squared(a: str, b: str) -> Column:
    """Squared distance of two points whose columns carry these prefixes."""
    return reduce(lambda s, c: s + c, [(F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in AXES])


def distance(a: str, b: str) -> Column:
    return F.sqrt(squared(a, b))


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, c: s + c, [p * q for p, q in zip(a, b, strict=True)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two vectors; null if one has no length."""
    cosine = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def step(k: int, w) -> list[Column]:
    """Vector from this point to the one ``k`` further on."""
    return [F.lead(c, k).over(w) - F.col(c) for c in AXES]
