"""All pairs of similar sets: a size-aware overlap join.

Two sets of s and t members are alike if their share of common members is at least
ALIKE, which takes an overlap of c(s, t) members. Small sets list their subsets of
exactly c(s, t) members, for each size t a partner may have: two sets that list one
subset share that many members, so every meeting is a result. For larger sets the
subsets grow too many; they scan the inverted lists of their rarest members
instead, those of which one must be shared, and meet sets of any size there.
Both kinds of pairs are united and filtered by their final similarity.

Equal sets are joined once and stand for all rows that have them. Members and sets
are named by 64-bit hashes. Null grammars and grammars without rules have no
partners; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, grammar_alternatives, spread, table, unique

ALIKE = 0.8
#: The largest set that lists its subsets: its subsets for all partners' sizes number about 200.
SMALL = 14
BLOCK = 2_000


def needed(s: int, t: int, alike: float = ALIKE) -> int:
    """Members that sets of s and t members must share to be alike."""
    return ceil(alike * (s + t) / (1 + alike) - 1e-9)


def partners(s: int, alike: float = ALIKE) -> list[int]:
    """Sizes t <= SMALL that a set of s members may have as a partner."""
    return [t for t in range(1, SMALL + 1) if needed(s, t, alike) <= min(s, t)]


@lru_cache(maxsize=None)
def dropped(s: int, n: int) -> np.ndarray:
    """All choices of n of s places, one per row."""
    return np.array(list(combinations(range(s), n)), dtype=np.int64).reshape(comb(s, n), n)


def subset_keys(batches: Iterator[pd.DataFrame], alike: float) -> Iterator[pd.DataFrame]:
    """(set, size, role, key): the subsets that a small set lists, as the smaller (role 0) and as the larger one (role 1) of a pair."""
    salt = lambda s, t, x: (x ^ np.uint64((s * 1_000_003 + t) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
    for b in batches:
        ids, sizes, roles, keys = [], [], [], []
        for name, tokens in zip(b["set"], b["tokens"]):
            h = np.asarray(tokens, dtype=np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # so that sums of members don't cancel
                s, total = len(h), h.sum(dtype=np.uint64)
                for t in partners(s, alike):
                    c = needed(s, t, alike)
                    sums = total - h[dropped(s, s - c)].sum(axis=1, dtype=np.uint64)
                    for role in (0, 1) if s == t else (0,) if s < t else (1,):
                        keys.append(salt(min(s, t), max(s, t), sums))
                        ids.append(np.full(len(sums), name))
                        sizes.append(np.full(len(sums), s, np.int32))
                        roles.append(np.full(len(sums), role, np.int32))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        yield pd.DataFrame({"set": cat(ids, np.int64), "size": cat(sizes, np.int32), "role": cat(roles, np.int32), "key": cat(keys, np.int64)})


def small_pairs(sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(a, b) of sets(set, tokens), both small, that list a common subset."""
    keys = checkpointed(spread(sets.filter(F.size("tokens") <= SMALL), "set").mapInPandas(lambda b: subset_keys(b, alike), "set bigint, size int, role int, key bigint"))
    left = keys.filter("role = 0").select("key", F.col("set").alias("a"), F.col("size").alias("a_size"))
    right = keys.filter("role = 1").select("key", F.col("set").alias("b"), F.col("size").alias("b_size"))
    return left.join(right, "key").filter("a_size < b_size or (a_size = b_size and a < b)").select("a", "b")


def large_pairs(sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(a, b) of sets(set, tokens), b large and a no larger, that share one of their rarest members."""
    rows = sets.select("set", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    spread_of = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(spread_of, "token").groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    # a set must share one of its size - ceil(alike * size) + 1 rarest members with any partner
    listed = checkpointed(
        ranked.select("set", "size", F.explode(F.slice(F.col("ranked"), F.lit(1), (F.col("size") - F.ceil(F.col("size") * F.lit(alike) - 1e-9) + 1).cast("int"))).alias("r")).select("set", "size", "r.token")
    )
    large = listed.filter(F.col("size") > SMALL).select("token", F.col("set").alias("b"), F.col("size").alias("b_size"))
    any_ = listed.select("token", F.col("set").alias("a"), F.col("size").alias("a_size"))
    near = (F.col("a_size") >= F.col("b_size") * alike - 1e-9) & ((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b"))))
    return large.join(any_, "token").filter(near).select("a", "b")


def similar_sets(sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(a, b, share) of sets(set, tokens): all pairs of different sets that are alike."""
    pairs = small_pairs(sets, alike).union(large_pairs(sets, alike)).distinct()
    side = lambda n: sets.select(F.col("set").alias(n), F.col("tokens").alias(f"{n}_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    share = both / (F.size("a_tokens") + F.size("b_tokens") - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("share", share).filter(F.col("share") >= alike).select("a", "b", "share")


def grammar_sets(grammars: DataFrame) -> DataFrame:
    """(grammar_id, set, tokens) of grammars with a member."""
    tokens = F.array_sort(F.array_distinct(F.transform(grammar_alternatives(F.col("minimal_grammar")), lambda m: F.xxhash64(m["name"], m["alt"]))))
    named = grammars.select("grammar_id", tokens.alias("tokens")).filter(F.size("tokens") > 0)
    return named.select("grammar_id", F.xxhash64("tokens").alias("set"), "tokens")


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(grammar_sets(unique(table(spark, sf_dir, "predicted_grammars").select("grammar_id", "minimal_grammar"), "grammar_id")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir)
    sets = checkpointed(rows.groupBy("set").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    links = similar_sets(sets).select("a", "b").union(sets.filter("n > 1").select(F.col("set").alias("a"), F.col("set").alias("b")))
    # the rows of a set are cut into blocks, so that pairs of two large sets are spread over tasks
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = rows.join(sets.select("set", blocks.alias("blocks")), "set").select("set", F.pmod(F.xxhash64("grammar_id"), F.col("blocks")).cast("int").alias("block"), "grammar_id")
    tiles = lambda n: sets.select(F.col("set").alias(n), F.explode(F.sequence(F.lit(0), blocks - 1)).alias(f"{n}_block"))
    side = lambda n: members.select(F.col("set").alias(n), F.col("block").alias(f"{n}_block"), F.col("grammar_id").alias(f"{n}_id"))
    pairs = links.join(tiles("a"), "a").join(tiles("b"), "b").join(side("a"), ["a", "a_block"]).join(side("b"), ["b", "b_block"])
    return pairs.filter("a <> b or a_id < b_id").select(F.least("a_id", "b_id").alias("grammar_a"), F.greatest("a_id", "b_id").alias("grammar_b"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each grammar: its set, the rows that have the same set, and the other sets that are alike."""
    rows = load(spark, sf_dir)
    sets = checkpointed(rows.groupBy("set").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.min("grammar_id").alias("set_id")))
    found = checkpointed(similar_sets(sets.select("set", "tokens")))
    degree = found.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("links"))
    return rows.select("grammar_id", "set").join(sets.select("set", "set_id", "copies"), "set").join(degree, "set", "left").select("grammar_id", "set_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def similar_between(left: DataFrame, right: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(a, b, share) of two tables (set, tokens) without repeats: all pairs of a set of `left` and one of `right` that are alike, equal ones too. Both are joined as one table, of which pairs within a side are left out."""
    flag = lambda df, side: df.select("set", "tokens", F.lit(side == "l").alias("l"), F.lit(side == "r").alias("r"))
    sets = checkpointed(flag(left, "l").union(flag(right, "r")).groupBy("set").agg(F.first("tokens").alias("tokens"), F.bool_or("l").alias("l"), F.bool_or("r").alias("r")))
    sides = lambda n: sets.select(F.col("set").alias(n), F.col("l").alias(f"{n}_l"), F.col("r").alias(f"{n}_r"))
    found = similar_sets(sets.select("set", "tokens"), alike).join(sides("a"), "a").join(sides("b"), "b")
    across = found.filter("a_l and b_r").select("a", "b", "share").union(found.filter("b_l and a_r").select("b", "a", "share"))
    return across.union(sets.filter("l and r").select("set", "set", F.lit(1.0)))


def p5_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of predicted grammars and sets of the examples' grammars that are alike, each named by its least id, with the share."""
    mine = load(spark, sf_dir)
    rows = unique(table(spark, sf_dir, "examples").select(F.col("example_id").alias("grammar_id"), "minimal_grammar"), "grammar_id")
    other = checkpointed(grammar_sets(rows))
    one = lambda df: checkpointed(df.groupBy("set").agg(F.first("tokens").alias("tokens"), F.min("grammar_id").alias("id")))
    left, right = one(mine), one(other)
    pairs = similar_between(left.select("set", "tokens"), right.select("set", "tokens"))
    named = pairs.join(left.select(F.col("set").alias("a"), F.col("id").alias("grammar_id")), "a").join(right.select(F.col("set").alias("b"), F.col("id").alias("example_id")), "b")
    return named.select("grammar_id", "example_id", F.round("share", 6).alias("share"))


from .p3_terms import MEMBERS_SQL  # noqa: E402

SETS_SQL = (
    "WITH g AS (SELECT DISTINCT ON (grammar_id) grammar_id, minimal_grammar FROM predicted_grammars), "
    + MEMBERS_SQL.format(key="grammar_id", source="g")
    + """,
sets AS (SELECT id, list(DISTINCT name || E'\\n' || alt ORDER BY name || E'\\n' || alt) AS s FROM members GROUP BY id)
"""
)
SHARE_SQL = "len(list_intersect(x.s, y.s)) >= 0.8 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))"
QUERIES = {"p5_found": p5_found, "p5_links": p5_links, "p5_between": p5_between}
ORACLES = {
    "p5_between": SETS_SQL.replace("sets AS", "gs AS")
    + ", "
    + MEMBERS_SQL.format(key="example_id", source="(SELECT DISTINCT ON (example_id) example_id, minimal_grammar FROM examples)").replace("lines AS", "l2 AS").replace("FROM lines", "FROM l2").replace("ruled AS", "r2 AS").replace("FROM ruled", "FROM r2").replace("latest AS", "t2 AS").replace("FROM latest", "FROM t2").replace("members AS", "m2 AS")
    + """,
es AS (SELECT id, list(DISTINCT name || E'\\n' || alt ORDER BY name || E'\\n' || alt) AS s FROM m2 GROUP BY id),
x AS (SELECT min(id) AS id, s FROM gs GROUP BY s), y AS (SELECT min(id) AS id, s FROM es GROUP BY s)
SELECT x.id AS grammar_id, y.id AS example_id, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) AS share FROM x JOIN y ON """
    + SHARE_SQL,
    "p5_found": SETS_SQL + f"SELECT x.id AS grammar_a, y.id AS grammar_b FROM sets x JOIN sets y ON x.id < y.id AND {SHARE_SQL}",
    "p5_links": SETS_SQL
    + f""", c AS (SELECT s, min(id) AS set_id, count(*) AS copies FROM sets GROUP BY s),
l AS (SELECT x.set_id, count(*) AS links FROM c x JOIN c y ON x.set_id <> y.set_id AND {SHARE_SQL} GROUP BY x.set_id)
SELECT sets.id AS grammar_id, c.set_id, c.copies, coalesce(l.links, 0) AS links FROM sets JOIN c USING (s) LEFT JOIN l USING (set_id)""",
}
