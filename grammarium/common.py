"""Helpers that every operator shares: table access, text keys, size-checked broadcast, checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20

#: White space that the grammar format drops around names and alternatives.
BLANKS = " \t\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique(df: DataFrame, key: str) -> DataFrame:
    """Rows with one key are equal by contract and count once; a row whose key is null can't be named and is dropped."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])


def let(value: Column, body) -> Column:
    """Evaluates `value` once for all its uses in `body`."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of a-z and 0-9 after lower-casing; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def blank_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def grammar_lines(grammar: Column) -> Column:
    """array<struct<name, neg_pos, rhs>>: the lines with ``::=``; of several with one name only the last, ordered by name."""
    lines = F.transform(F.split(grammar, "\n", -1), lambda line, i: F.struct(blank_trim(line).alias("line"), i.alias("i")))
    ruled = F.filter(lines, lambda x: F.contains(x["line"], F.lit("::=")))
    parts = F.transform(
        ruled,
        lambda x: F.struct(
            blank_trim(F.substring_index(x["line"], "::=", 1)).alias("name"),
            (-x["i"]).alias("neg_pos"),
            F.substr(x["line"], F.instr(x["line"], "::=") + F.lit(3)).alias("rhs"),
        ),
    )
    return let(F.array_sort(parts), lambda a: F.filter(a, lambda x, i: (i == 0) | (x["name"] != F.get(a, i - F.lit(1))["name"])))


def grammar_alternatives(grammar: Column) -> Column:
    """array<struct<name, alt>>: alternatives as written, repeats kept; null grammar gives null."""
    alts = lambda rhs: F.filter(F.transform(F.split(rhs, r" \| ", -1), blank_trim), lambda a: a != "")
    return F.flatten(F.transform(grammar_lines(grammar), lambda r: F.transform(alts(r["rhs"]), lambda a: F.struct(r["name"].alias("name"), a.alias("alt")))))


def weight(df: DataFrame) -> Column:
    """Bytes of a row: those of texts, 8 for each number, and the same for the elements of arrays."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda n, x: n + of(x, kind.elementType)), F.lit(0).cast("bigint"))
        if isinstance(kind, T.StructType):
            return sum((of(value[f.name], f.dataType) for f in kind), F.lit(8).cast("bigint"))
        return F.lit(8).cast("bigint")

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8).cast("bigint"))


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks `df` for broadcast if it weighs at most `limit` bytes, else leaves the join to be shuffled."""
    held = df.agg(F.sum(weight(df))).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's spark.checkpoint.dir. Where none is set, a local session takes a temporary folder; a cluster's executors share none, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "grammarium-checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads rows evenly ahead of costly work per row. The number of partitions follows the bytes: small ones are joined, but not below the number of cores, and large ones are split."""
    return df.hint("rebalance", *keys)
