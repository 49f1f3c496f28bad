"""Folds over arrays by built-in functions, in time that grows with the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def walk(items: Column, start: Column, step, output: str, size: int = 256) -> Column:
    """An array of what a fold over an array puts out. step(state, item): the next state, and what it puts out, an array of type ``output`` (a DDL type) with any number of elements. Outputs are joined block by block, so the work grows with the items, not with their square."""
    none, many = F.array().cast(f"array<{output}>"), F.array().cast(f"array<array<{output}>>")

    def one(acc, item):
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def folded(items):
        def block(acc, at):
            inner = F.aggregate(F.slice(items, at * size + 1, F.lit(size)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return once(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / size).cast("int"), F.lit(0)))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), many.alias("out")), block)["out"])

    return once(items, folded)


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it is used: it goes through an array of one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
