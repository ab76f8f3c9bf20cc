"""Vector functions over array columns (section 2.3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:  # V9
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:  # V1; null where either norm is 0
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column, halved: bool = False) -> Column:  # V2: 1 - d, or 1 - d / 2 for a range from 0 to 1
    return 1 - (distance / 2 if halved else distance)


def normalized(v: Column) -> Column:  # V9
    n = norm(v)
    return F.transform(_d(v), lambda x: F.try_divide(x, n))


def binary_quantized(v: Column) -> Column:  # V9
    return F.transform(v, lambda x: x > 0)


def is_valid(v: Column, dimension: int) -> Column:  # V6
    return v.isNotNull() & (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def to_text(v: Column) -> Column:  # V7
    return F.to_json(v)


def from_text(s: Column) -> Column:  # V7
    return F.from_json(s, "array<float>")


def tokens_each(total: Column, n: Column) -> Column:  # V5
    return F.ceil(total / n)


def cost(tokens: Column, price_per_million: float) -> Column:  # V8
    return tokens / F.lit(1e6) * price_per_million
