"""What programs are asked of: things of kinds, links between them, and their numbers, as three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import small_or_shuffled


@dataclass(frozen=True)
class World:
    """things(id, kind, name), links(relation, a, b) and numbers(id, attribute, value); a thing may be of several kinds."""

    things: DataFrame
    links: DataFrame
    numbers: DataFrame

    def kind(self, *names: str) -> DataFrame:
        return self.things.filter(F.col("kind").isin(*names)).select("id").distinct()

    def image(self, of: DataFrame, relation: str, forward: bool) -> DataFrame:
        """(id, via): what the things of `of`(id) are linked to, or, backward, what is linked to them."""
        start, end = ("a", "b") if forward else ("b", "a")
        links = self.links.filter(F.col("relation") == relation).select(F.col(start).alias("via"), F.col(end).alias("id"))
        return links.join(of.select(F.col("id").alias("via")).distinct(), "via").select("id", "via").distinct()

    def number(self, of: DataFrame, attribute: str) -> DataFrame:
        """(id, value) of the things that have the attribute."""
        return of.select("id").distinct().join(self.numbers.filter(F.col("attribute") == attribute).select("id", "value"), "id")


def best(scored: DataFrame, largest: bool) -> DataFrame:
    """(id) of the rows of scored(id, value) whose value is the largest or least; ties all stay."""
    end = scored.agg((F.max if largest else F.min)("value").alias("end"))
    return scored.join(F.broadcast(end), F.col("value") == F.col("end")).select("id").distinct()  # one row


def compared(left: Column, op: str, right: Column) -> Column:
    match op:
        case "=":
            return left == right
        case "!=":
            return left != right
        case ">":
            return left > right
        case "<":
            return left < right
        case ">=":
            return left >= right
        case "<=":
            return left <= right
    raise ValueError(op)


def some(rows: DataFrame, others: DataFrame, op: str) -> DataFrame:
    """Rows (…, value) that compare with at least one of others(value). Only the ends of `others` matter to an order, so nothing is crossed; equality is joined."""
    if op == "=":
        return rows.join(small_or_shuffled(others.select("value").distinct()), "value", "left_semi")
    ends = others.agg(F.min("value").alias("low"), F.max("value").alias("high"))  # one row
    there = rows.join(F.broadcast(ends), F.lit(True))
    if op == "!=":
        kept = (F.col("low") != F.col("high")) | (F.col("value") != F.col("low"))
    else:
        kept = compared(F.col("value"), op, F.col("low" if op in (">", ">=") else "high"))
    return there.filter(kept).drop("low", "high")
