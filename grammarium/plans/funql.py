"""FunQL, a functional query language on geography, compiled to DataFrames over a World.

A term denotes a set of things, (id), or numbers, (id, value). ``_1`` follows a link
and ``_2`` goes against it. Superlatives keep ties; of an empty set they are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terms import Term, Unreadable, function_term
from .worlds import World, best, some

#: Names of the language; fixed values.
KINDS = ("city", "state", "river", "place", "mountain", "lake", "country", "capital", "major")
POINTS = {"cityid": "city", "stateid": "state", "riverid": "river", "placeid": "place", "countryid": "country"}
LINKS = {
    "capital_1": ("capital", True), "capital_2": ("capital", False), "loc_1": ("loc", True), "loc_2": ("loc", False),
    "next_to_1": ("next_to", True), "next_to_2": ("next_to", False), "traverse_1": ("traverse", True), "traverse_2": ("traverse", False),
    "high_point_1": ("high_point", True), "high_point_2": ("high_point", False), "highest_point_2": ("high_point", False),
    "low_point_1": ("low_point", True), "low_point_2": ("low_point", False),
}
NUMBERS = {"area_1": "area", "density_1": "density", "elevation_1": "elevation", "population_1": "population", "len": "length", "size": "size"}
EXTREMES = {"largest": ("size", True), "smallest": ("size", False), "highest": ("elevation", True), "lowest": ("elevation", False), "longest": ("length", True), "shortest": ("length", False)}
COMPARED = {"longer": ("length", ">"), "higher_2": ("elevation", ">"), "lower_2": ("elevation", "<")}


class Compiler:
    def __init__(self, world: World):
        self.world = world

    def term(self, t: Term) -> DataFrame:
        """(id) or (id, value)."""
        for known in (self.whole, self.related, self.extreme, self.numeric, self.combined):
            if (found := known(t)) is not None:
                return found
        raise Unreadable(str(t))

    def things(self, t: Term) -> DataFrame:
        return self.term(t).select("id").distinct()

    def whole(self, t: Term) -> DataFrame | None:
        """Extents, points and kinds."""
        w = self.world
        if t.name in POINTS and t.args:
            found = w.things.filter((F.col("kind") == POINTS[t.name]) & (F.col("name") == t.args[0].name)).select("id").distinct()
            if len(t.args) > 1 and t.args[1].name != "_":
                state = w.things.filter((F.col("kind") == "state") & (F.col("name") == t.args[1].name)).select("id")
                found = found.join(w.image(state, "loc", False).select("id").distinct(), "id", "left_semi")
            return found
        if t.name in KINDS and len(t.args) == 1:
            extent = self.world.kind(t.name)
            return extent if t.args[0] == Term("all") else self.things(t.args[0]).join(extent, "id", "left_semi")
        return self.term(t.args[0]) if t.name == "answer" and len(t.args) == 1 else None

    def related(self, t: Term) -> DataFrame | None:
        """Images under a link, and things that compare with another's number."""
        if t.name in LINKS and len(t.args) == 1:
            return self.world.image(self.things(t.args[0]), *LINKS[t.name]).select("id").distinct()
        if t.name in COMPARED and len(t.args) == 1:
            attribute, op = COMPARED[t.name]
            rows = self.world.numbers.filter(F.col("attribute") == attribute).select("id", "value")
            return some(rows, self.world.number(self.things(t.args[0]), attribute), op).select("id").distinct()
        if t.name == "elevation_2" and len(t.args) == 1:
            at = float(t.args[0].name)
            return self.world.numbers.filter((F.col("attribute") == "elevation") & (F.col("value") == at)).select("id").distinct()
        return None

    def extreme(self, t: Term) -> DataFrame | None:
        if len(t.args) != 1:
            return None
        inner = t.args[0]
        if t.name in EXTREMES and not (t.name == "smallest" and self.is_number(inner)):
            attribute, largest = EXTREMES[t.name]
            return best(self.world.number(self.things(inner), attribute), largest)
        if t.name in ("largest_one", "smallest_one") and inner.name in NUMBERS and inner.args:
            return best(self.world.number(self.things(inner.args[0]), NUMBERS[inner.name]), t.name == "largest_one")
        if t.name in ("most", "fewest"):
            n = self.sources(inner).groupBy("id").agg(F.count_distinct("via").alias("value"))
            return best(n, t.name == "most")
        return None

    def sources(self, t: Term) -> DataFrame:
        """(id, via): the things that `t` denotes and what they were reached from by its outermost link."""
        if t.name in LINKS:
            return self.world.image(self.things(t.args[0]), *LINKS[t.name])
        if t.name in KINDS and t.args and t.args[0] != Term("all"):
            return self.sources(t.args[0]).join(self.world.kind(t.name), "id", "left_semi")
        if t.name == "intersection":
            return self.sources(t.args[0]).join(self.things(t.args[1]), "id", "left_semi")
        if t.name == "exclude":
            return self.sources(t.args[0]).join(self.things(t.args[1]), "id", "left_anti")
        raise Unreadable(f"{t} counts nothing")

    def is_number(self, t: Term) -> bool:
        return t.name in NUMBERS or t.name in ("count", "sum") or t.name == "smallest" and len(t.args) == 1 and self.is_number(t.args[0])

    def numeric(self, t: Term) -> DataFrame | None:
        """Numbers of things, and aggregates, whose id is null."""
        if len(t.args) != 1:
            return None
        alone: Callable = lambda df, value: df.agg(value.alias("value")).select(F.lit(None).cast("string").alias("id"), F.col("value").cast("double"))
        if t.name in NUMBERS:
            return self.world.number(self.things(t.args[0]), NUMBERS[t.name])
        if t.name == "count":
            return alone(self.things(t.args[0]), F.count(F.lit(1)))
        if t.name == "sum":
            return alone(self.term(t.args[0]), F.sum("value"))
        if t.name == "smallest":
            return alone(self.term(t.args[0]), F.min("value"))
        return None

    def combined(self, t: Term) -> DataFrame | None:
        if t.name in ("intersection", "exclude") and len(t.args) == 2:
            a, b = map(self.things, t.args)
            return a.join(b, "id", "left_semi" if t.name == "intersection" else "left_anti")
        return None


def denotation(program: str, world: World) -> DataFrame:
    """(id, value) of a program: ids of things without a value, or numbers, without an id where they are of no one thing."""
    found = Compiler(world).term(function_term(program))
    return found if "value" in found.columns else found.withColumn("value", F.lit(None).cast("double"))
