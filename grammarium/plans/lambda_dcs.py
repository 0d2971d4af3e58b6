"""Lambda-DCS on a world of blocks, compiled to DataFrames over a World.

A form denotes a set of things, (id), or of numbers, (value). Properties are links or
numbers; ``(reverse p)`` goes against a link, ``!type`` is the extent of a kind. A
property may have several values: a filter keeps what has one that fits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terms import Unreadable, bracketed
from .worlds import World, best, some

NUMBER = re.compile(r"-?\d+(?:\.\d+)?$")
AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}
WRAPPERS = ("ensureNumericProperty", "ensureNumericEntity", "string", "number")


def joined(words: list) -> list:
    """A number and its unit are one word."""
    out: list = []
    for w in words:
        if out and isinstance(w, str) and isinstance(out[-1], str) and NUMBER.match(out[-1]) and w.startswith("en.") and w.count(".") == 1:
            continue
        out.append(w)
    return out


class Compiler:
    def __init__(self, world: World, numeric: tuple[str, ...]):
        """numeric: the properties whose values are numbers."""
        self.world, self.numeric = world, numeric

    def property(self, p) -> tuple[str, bool]:
        """(name, forward)."""
        if isinstance(p, list) and p[0] in WRAPPERS and len(p) == 2:
            return self.property(p[1])
        if isinstance(p, list) and p[0] == "reverse" and len(p) == 2:
            name, forward = self.property(p[1])
            return name, not forward
        if isinstance(p, str):
            return p, True
        raise Unreadable(str(p))

    def values(self, of: DataFrame, p) -> DataFrame:
        """(owner, value): the property's values of the things in `of`, numbers or ids."""
        name, forward = self.property(p)
        if name in self.numeric:
            return self.world.number(of, name).select(F.col("id").alias("owner"), "value")
        return self.world.image(of, name, forward).select(F.col("via").alias("owner"), F.col("id").alias("value"))

    def set(self, form) -> DataFrame:
        """(value): ids or numbers, each once."""
        return self.form(form).select("value").distinct()

    def things(self, form) -> DataFrame:
        return self.set(form).select(F.col("value").alias("id"))

    def form(self, form) -> DataFrame:
        if isinstance(form, str):
            spark = self.world.things.sparkSession
            return spark.range(1).select((F.lit(float(form)) if NUMBER.match(form) else F.lit(form)).alias("value"))
        head, *rest = joined(form)
        if not rest:
            return self.form(head)
        if isinstance(head, str) and NUMBER.match(head) or head in WRAPPERS:
            return self.form(head if isinstance(head, str) and NUMBER.match(head) else rest[0])
        match head, len(rest):
            case "listValue", 1:
                return self.set(rest[0])
            case "filter", 2:
                return self.things(rest[0]).join(self.world.links.filter((F.col("relation") == self.property(rest[1])[0])).select(F.col("a").alias("id")), "id", "left_semi").select(F.col("id").alias("value"))
            case "filter", 4:
                rows = self.values(self.things(rest[0]), rest[1])
                return some(rows, self.set(rest[3]), rest[2]).select(F.col("owner").alias("value")).distinct()
            case "superlative", 3:
                rows = self.values(self.things(rest[0]), rest[2]).withColumnRenamed("owner", "id")
                return best(rows, rest[1] == "max").select(F.col("id").alias("value"))
            case "countSuperlative", 3 | 4:
                return best(self.counts(rest[0], rest[2], rest[3:]), rest[1] == "max").select(F.col("id").alias("value"))
            case "countComparative", 4 | 5:
                n = self.counts(rest[0], rest[1], rest[4:])
                return some(n, self.set(rest[3]), rest[2]).select(F.col("id").alias("value"))
            case "_size", 1:
                return self.set(rest[0]).agg(F.count(F.lit(1)).cast("double").alias("value"))
            case "aggregate", 2:
                return self.set(rest[1]).agg(AGGREGATES[rest[0]]("value").cast("double").alias("value"))
            case "getProperty", 2:
                if rest[1] == "!type":
                    return self.world.kind(rest[0][1]).select(F.col("id").alias("value"))
                return self.values(self.things(rest[0]), rest[1]).select("value").distinct()
            case "concat", 2:
                return self.set(rest[0]).union(self.set(rest[1])).distinct()
        raise Unreadable(str(form))

    def counts(self, of, p, within: list) -> DataFrame:
        """(id, value): how many of the property's values each thing has, of those in `within` where it is given; things without one have 0."""
        owners = self.things(of)
        rows = self.values(owners, p)
        if within:
            rows = rows.join(self.set(within[0]), "value", "left_semi")
        n = rows.groupBy(F.col("owner").alias("id")).agg(F.count_distinct("value").cast("double").alias("n"))
        return owners.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0.0)).alias("value"))


def denotation(program: str, world: World, numeric: tuple[str, ...]) -> DataFrame:
    """(id, value) of a program, each once: ids of things or values of numbers."""
    found = Compiler(world, numeric).set(bracketed(program))
    number = dict(found.dtypes)["value"] == "double"
    none = lambda kind: F.lit(None).cast(kind)
    return found.select(none("string").alias("id"), "value") if number else found.select(F.col("value").alias("id"), none("double").alias("value"))
