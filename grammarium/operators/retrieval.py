"""Exact retrieval over vectors, merged grammars of neighbours, and messages built from them.

Queries are the valid and test rows whose vec_id is divisible by EVERY, against all
train rows of the same dataset. Vectors that are null, of another length or all zero
neither ask nor answer. Scores are inner products of the vectors scaled to length 1,
rounded to 6 digits; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import grammar_alternatives, small_or_shuffled, table, unique
from ..oracle import one_per, rules_sql
from .rules import examples, rules

K, EVERY, DIM, BLOCK = 8, 50, 64, 4_096


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = unique(table(spark, sf_dir, "query_vectors"), "vec_id")
    return v.filter((F.size("embedding") == DIM) & F.exists("embedding", lambda x: x != 0))


def blocks(df: DataFrame, name: str) -> DataFrame:
    """One row for each dataset and BLOCK vectors: ids and the vectors' bytes. The block is drawn by hash, so a large dataset is spread."""
    sized = df.join(df.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")), "dataset")
    placed = sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = np.stack([np.asarray(e, np.float64) for e in group["embedding"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({"dataset": [group["dataset"].iloc[0]], f"{name}_ids": [group["vec_id"].tolist()], f"{name}_raw": [x.tobytes()]})

    return placed.select("dataset", "block", "vec_id", "embedding").groupBy("dataset", "block").applyInPandas(pack, f"dataset string, {name}_ids array<bigint>, {name}_raw binary")


def top_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for q_ids, q_raw, t_ids, t_raw in zip(b["q_ids"], b["q_raw"], b["t_ids"], b["t_raw"]):
            t = np.frombuffer(t_raw).reshape(-1, DIM)
            ids = np.asarray(t_ids)  # ascending, so a stable sort breaks ties by id
            s = np.round(np.frombuffer(q_raw).reshape(-1, DIM) @ t.T, 6)
            top = np.argsort(-s, axis=1, kind="stable")[:, :K]
            yield pd.DataFrame({"vec_id": np.repeat(np.asarray(q_ids), top.shape[1]), "neighbour_id": ids[top].ravel(), "score": np.take_along_axis(s, top, axis=1).ravel()})


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, neighbour_id, score, rank): a stated set of queries against all train rows, block by block."""
    v = usable(spark, sf_dir)
    q = blocks(v.filter((F.col("split") != "train") & (F.col("vec_id") % EVERY == 0)), "q")
    t = blocks(v.filter("split = 'train'"), "t")
    # train blocks stay where they are while the queries are few
    found = t.join(small_or_shuffled(q), "dataset").select("q_ids", "q_raw", "t_ids", "t_raw").mapInPandas(top_of_blocks, "vec_id bigint, neighbour_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= K)


def knn_neighbours(spark, sf_dir):
    return knn(spark, sf_dir)


def neighbour_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_id, rank, example_id) with ids of examples."""
    v = usable(spark, sf_dir).select("vec_id", "example_id")
    n = knn(spark, sf_dir).join(v.withColumnRenamed("example_id", "test_id"), "vec_id")
    return n.join(v.select(F.col("vec_id").alias("neighbour_id"), "example_id"), "neighbour_id").select("test_id", "rank", "example_id")


def merged(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    n = neighbour_examples(spark, sf_dir)
    r = rules(examples(spark, sf_dir).select("example_id", "minimal_grammar"), "example_id")
    rows = n.join(r, "example_id").groupBy("test_id", "name", "alt").agg(F.min(F.struct("rank", "rule_pos", "alt_pos")).alias("at"), F.count_distinct("rank").alias("holders"))
    if every:
        rows = rows.join(n.groupBy("test_id").agg(F.count(F.lit(1)).alias("k")), "test_id").filter("holders = k")
    lines = rows.groupBy("test_id", "name").agg(F.array_sort(F.collect_list(F.struct("at", "alt"))).alias("a"))
    line = F.concat("name", F.lit(" ::= "), F.array_join(F.transform("a", lambda x: x["alt"]), " | "))
    placed = lines.select("test_id", F.struct(F.get("a", F.lit(0))["at"].alias("at"), line.alias("line")).alias("l"))
    return placed.groupBy("test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("grammar"))


def knn_union(spark, sf_dir):
    """Union of the neighbours' grammars; rules and alternatives in the order of first appearance, best neighbour first."""
    return merged(spark, sf_dir, False)


def knn_intersection(spark, sf_dir):
    """Rules and alternatives that all neighbours hold, in the order of the best one; no row where there are none."""
    return merged(spark, sf_dir, True)


def rule_recovery(spark, sf_dir):
    """Of the members of test rows, the share that one of the first k neighbours holds, for k = 1, 4, 8."""
    n = neighbour_examples(spark, sf_dir)
    arr = F.array_distinct(grammar_alternatives(F.col("minimal_grammar")))
    g = examples(spark, sf_dir).select("example_id", "dataset", F.explode(arr).alias("m"))
    want = n.select("test_id").distinct().join(g.withColumnRenamed("example_id", "test_id"), "test_id")
    have = n.join(g.select("example_id", "m"), "example_id").groupBy("test_id", "m").agg(F.min("rank").alias("first"))
    return want.join(have, ["test_id", "m"], "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("members"), *[F.avg((F.coalesce("first", F.lit(99)) <= k).cast("double")).alias(f"recall_{k}") for k in (1, 4, 8)])


def prompt_messages(spark, sf_dir):
    """Messages of a retrieval prompt: the neighbours' queries and grammars, best first, then the query."""
    n = neighbour_examples(spark, sf_dir)
    e = examples(spark, sf_dir).select("example_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("minimal_grammar", F.lit("")).alias("g"))
    shown = n.join(e, "example_id").groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("rank", "query", "g"))).alias("shots"))
    text = F.array_join(F.transform("shots", lambda s: F.concat(F.lit("Example "), s["rank"].cast("string"), F.lit("\nQuery: "), s["query"], F.lit("\nGrammar:\n"), s["g"])), "\n\n")
    asked = shown.join(e.select(F.col("example_id").alias("test_id"), F.col("query").alias("asked")), "test_id")
    return asked.select("test_id", F.sha2(F.concat(F.lit("Write the grammar.\n"), text, F.lit("\n\nQuery: "), F.col("asked")), 256).alias("prompt_key"), F.size("shots").alias("shots"))


N_SQL = (
    "WITH e AS " + one_per("examples", "example_id") + "," + rules_sql("e", "example_id")
    + f""", v AS (SELECT DISTINCT ON (vec_id) vec_id, example_id, dataset, split, embedding::DOUBLE[] AS x FROM query_vectors WHERE len(embedding) = {DIM} AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT q.vec_id, t.vec_id AS neighbour_id, q.example_id AS test_id, t.example_id, round(list_inner_product(q.x, t.x) / sqrt(list_inner_product(q.x, q.x)) / sqrt(list_inner_product(t.x, t.x)), 6) AS score FROM v q JOIN v t ON q.dataset = t.dataset AND q.split <> 'train' AND t.split = 'train' AND q.vec_id % {EVERY} = 0),
n AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id))::INT AS rank FROM s QUALIFY rank <= {K})
"""
)
MERGE_SQL = """, m AS (SELECT test_id, name, alt, min(row(rank, rule_pos, alt_pos)) AS place, count(DISTINCT rank) AS h FROM n JOIN alts ON id = example_id GROUP BY ALL),
k AS (SELECT test_id, count(*) AS k FROM n GROUP BY test_id),
l AS (SELECT test_id, name, min(place) AS lp, name || ' ::= ' || string_agg(alt, ' | ' ORDER BY place) AS line FROM m JOIN k USING (test_id) WHERE {} GROUP BY test_id, name)
SELECT test_id, string_agg(line, E'\\n' ORDER BY lp) AS grammar FROM l GROUP BY test_id"""
QUERIES = {f.__name__: f for f in (knn_neighbours, knn_union, knn_intersection, rule_recovery, prompt_messages)}
ORACLES = {
    "knn_neighbours": N_SQL + "SELECT vec_id, neighbour_id, score, rank FROM n",
    "knn_union": N_SQL + MERGE_SQL.format("true"),
    "knn_intersection": N_SQL + MERGE_SQL.format("h = k"),
    "rule_recovery": N_SQL + ", f AS (SELECT test_id, name, alt, min(rank) AS first FROM n JOIN members ON id = example_id GROUP BY ALL), w AS (SELECT DISTINCT test_id FROM n) SELECT dataset, count(*) AS members, " + ", ".join(f"avg((coalesce(first, 99) <= {k})::INT) AS recall_{k}" for k in (1, 4, 8)) + " FROM w JOIN members m ON m.id = test_id JOIN e ON example_id = test_id LEFT JOIN f USING (test_id, name, alt) GROUP BY dataset",
    "prompt_messages": N_SQL + ", t AS (SELECT test_id, string_agg('Example ' || rank || E'\\nQuery: ' || coalesce(query, '') || E'\\nGrammar:\\n' || coalesce(minimal_grammar, ''), E'\\n\\n' ORDER BY rank) AS text, count(*)::INT AS shots FROM n JOIN e USING (example_id) GROUP BY test_id) SELECT test_id, sha256(E'Write the grammar.\\n' || text || E'\\n\\nQuery: ' || coalesce(query, '')) AS prompt_key, shots FROM t JOIN e ON example_id = test_id",
}
