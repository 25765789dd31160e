"""Vector columns (``array<double>`` or ``array<float>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_from_parts(product: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(product / (norm_a * norm_b))


def rounded(a: Column, digits: int) -> Column:
    return F.transform(F.coalesce(a, F.array().cast("array<double>")), lambda x: F.round(x.cast("double"), digits))


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
