"""Folds over arrays that give a list, in about linear time.

``aggregate`` copies its accumulator at each element, lists in it included, so a fold that appends to a
list takes the square of its length. Here the state is kept apart from what is given out, and the
array is folded stride by stride: within a stride only the stride's own output is copied, and the whole
output once for each stride. Strides have about the square root of the array's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

STRIDE = 32


def folded(items: Column, state: Column, step: Callable[[Column, Column, Column], Column], out: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """array<kind>: what `out` gives (an array) for each (state before, element, index), end to end; `step` is the state after. Keep the state small."""

    def inner(items: Column, stride: Column, b: Column, j: Column) -> Column:
        part = F.slice(items, j * stride + 1, stride)

        def put(a: Column, x: Column) -> Column:
            more = bound(out(a["state"], x, a["i"]), lambda m: F.when(F.size(m) > 0, F.concat(a["out"], m)).otherwise(a["out"]))
            return F.struct(step(a["state"], x, a["i"]).alias("state"), more.alias("out"), (a["i"] + 1).alias("i"))

        zero = F.struct(b["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"), (j * stride).cast("int").alias("i"))
        return F.aggregate(part, zero, put, lambda a: F.struct(a["state"].alias("state"), F.concat(b["out"], a["out"]).alias("out")))

    def outer(items: Column, stride: Column) -> Column:
        strides = F.sequence(F.lit(0), F.ceil(F.size(items) / stride).cast("int") - 1)
        zero = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        every = F.aggregate(strides, zero, lambda b, j: inner(items, stride, b, j), lambda b: b["out"])
        return F.when(F.size(items) > 0, every).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(items, lambda xs: bound(F.greatest(F.lit(STRIDE), F.ceil(F.sqrt(F.size(xs))).cast("int")), lambda stride: outer(xs, stride)))
