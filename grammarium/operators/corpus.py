"""Corpus statistics over rules: document frequency, novelty, split balance, recovery by neighbours.

A rule is the pair (name, alt). Denominators count all rows of a split, also those
without a grammar. Rows with one example_id count once; an empty split has frequency 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..oracle import one_per, rules_sql
from .rules import examples, members
from .sampling import by_digest

TOP, LEAST_TEST_DF, MOST_TRAIN_DF = 20, 0.05, 0.15
EPS = 1e-7


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, name, alt, train, test, n_train, n_test): rows that hold the rule, and all rows; valid rows are left out."""
    e = examples(spark, sf_dir).filter("split in ('train', 'test')").select("example_id", "dataset", "split", "minimal_grammar")
    n = e.groupBy("dataset").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    m = members(e.select(F.struct("dataset", "split").alias("k"), "minimal_grammar"), "k")
    c = m.groupBy("k.dataset", "name", "alt").agg(F.count_if(F.col("k.split") == "train").alias("train"), F.count_if(F.col("k.split") == "test").alias("test"))
    return c.join(n, "dataset")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lambda a: F.when(F.col(f"n_{a}") > 0, F.col(a) / F.col(f"n_{a}")).otherwise(0.0)
    c = split_counts(spark, sf_dir).withColumn("train_df", df("train")).withColumn("test_df", df("test"))
    ratio = F.col("test_df") / (F.col("train_df") + EPS)
    return c.select(
        "dataset", "name", "alt", "train", "test", "train_df", "test_df", (F.col("test_df") - F.col("train_df")).alias("gap"), ratio.alias("ratio"),
        F.when(F.col("test_df") > 0, F.col("test_df") * F.log(ratio)).otherwise(0.0).alias("novelty"),
        F.when((F.col("train") > 0) & (F.col("test") > 0), "shared").when(F.col("test") > 0, "test_only").otherwise("train_only").alias("kind"),
    )


def rule_composition(spark, sf_dir):
    """Frequencies, gap and novelty of each rule of each dataset in train and test rows."""
    return composition(spark, sf_dir).drop("ratio")


def rule_partition(spark, sf_dir):
    """Numbers of shared, test-only and train-only rules."""
    return composition(spark, sf_dir).groupBy("dataset").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("shared", "test_only", "train_only")])


def rare_in_train(spark, sf_dir):
    """The TOP shared rules of each dataset by novelty, rounded to 6 digits before they are ranked; ties by rule."""
    rows = composition(spark, sf_dir).filter("kind = 'shared'").select("dataset", "name", "alt", (F.round("novelty", 6) + 0.0).alias("novelty"))
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("novelty"), "name", "alt"))
    return rows.withColumn("place", rank).filter(F.col("place") <= TOP)


def test_only_rules(spark, sf_dir):
    """Rules that no train row holds, with their rank by the number of test rows."""
    rows = composition(spark, sf_dir).filter("kind = 'test_only'").select("dataset", "name", "alt", "test")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("test"), "name", "alt")))


def imbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition(spark, sf_dir).filter(((F.col("train_df") < MOST_TRAIN_DF) & (F.col("test_df") >= LEAST_TEST_DF)) | ((F.col("train") == 0) & (F.col("test") > 0))).select("dataset", "name", "alt")


def imbalanced_rules(spark, sf_dir):
    """Rules that are rare in train rows but frequent in test rows, or missing in train rows."""
    return imbalanced(spark, sf_dir)


def balance_split(spark, sf_dir):
    """New split of each row: valid and test rows with an imbalanced rule move to train, and as many train rows without one, in the order of their hash, fill up test, then valid. Too few of these are all used."""
    e = examples(spark, sf_dir).select("example_id", "dataset", "split", "minimal_grammar")
    bad = members(e.select(F.struct("example_id", "dataset").alias("k"), "minimal_grammar"), "k").select("k.example_id", F.col("k.dataset").alias("dataset"), "name", "alt")
    problem = bad.join(imbalanced(spark, sf_dir), ["dataset", "name", "alt"]).select("example_id").distinct().withColumn("problem", F.lit(True))
    rows = e.drop("minimal_grammar").join(problem, "example_id", "left").withColumn("problem", F.coalesce("problem", F.lit(False)))
    need = rows.groupBy("dataset").agg(F.count_if((F.col("split") == "test") & F.col("problem")).alias("for_test"), F.count_if((F.col("split") == "valid") & F.col("problem")).alias("for_valid"))
    clean = by_digest(rows.filter("split = 'train' and not problem").select("example_id", "dataset"), F.md5(F.col("example_id").cast("string"))).select("example_id", "k")
    moved = rows.join(need, "dataset").join(clean, "example_id", "left")
    new = F.when((F.col("split") != "train") & F.col("problem"), "train").when(F.col("k") <= F.col("for_test"), "test").when(F.col("k") <= F.col("for_test") + F.col("for_valid"), "valid").otherwise(F.col("split"))
    return moved.select("example_id", "dataset", "split", new.alias("new_split"))


def grammar_lengths(spark, sf_dir):
    """Least, largest, mean and median numbers of words of programs."""
    n = F.size(F.filter(F.split("program", r"\s+"), lambda x: x != ""))
    rows = examples(spark, sf_dir).filter("program is not null").select("dataset", n.alias("n"))
    return rows.groupBy("dataset").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.median("n").alias("median"))


def deduplicated_problems(spark, sf_dir):
    """One row per task_id, the last one (by grammar_id) wins."""
    from .rules import predicted

    rows = predicted(spark, sf_dir).filter("task_id is not null")
    return rows.groupBy("task_id").agg(F.max_by(F.struct("grammar_id", "run_id"), "grammar_id").alias("x"), F.count(F.lit(1)).alias("copies")).select("task_id", "x.grammar_id", "x.run_id", "copies")


C_SQL = (
    "WITH e AS " + one_per("examples", "example_id") + "," + rules_sql("e", "example_id")
    + f""", n AS (SELECT dataset, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM e WHERE split IN ('train', 'test') GROUP BY dataset),
c AS (SELECT dataset, name, alt, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM members JOIN e ON id = example_id WHERE split IN ('train', 'test') GROUP BY ALL),
d AS (SELECT dataset, name, alt, train, test, CASE WHEN n_train > 0 THEN train / n_train ELSE 0.0 END AS train_df, CASE WHEN n_test > 0 THEN test / n_test ELSE 0.0 END AS test_df FROM c JOIN n USING (dataset)),
f AS (SELECT *, test_df - train_df AS gap, CASE WHEN test_df > 0 THEN test_df * ln(test_df / (train_df + {EPS})) ELSE 0.0 END AS novelty, CASE WHEN train > 0 AND test > 0 THEN 'shared' WHEN test > 0 THEN 'test_only' ELSE 'train_only' END AS kind FROM d),
bad AS (SELECT dataset, name, alt FROM d WHERE (train_df < {MOST_TRAIN_DF} AND test_df >= {LEAST_TEST_DF}) OR (train = 0 AND test > 0))
"""
)
QUERIES = {f.__name__: f for f in (rule_composition, rule_partition, rare_in_train, test_only_rules, imbalanced_rules, balance_split, grammar_lengths, deduplicated_problems)}
ORACLES = {
    "rule_composition": C_SQL + "SELECT * FROM f",
    "rule_partition": C_SQL + "SELECT dataset, count(*) FILTER (kind = 'shared') AS shared, count(*) FILTER (kind = 'test_only') AS test_only, count(*) FILTER (kind = 'train_only') AS train_only FROM f GROUP BY dataset",
    "rare_in_train": C_SQL + f"SELECT dataset, name, alt, round(novelty, 6) + 0.0 AS novelty, (row_number() OVER (PARTITION BY dataset ORDER BY round(novelty, 6) + 0.0 DESC, name, alt))::INT AS place FROM f WHERE kind = 'shared' QUALIFY place <= {TOP}",
    "test_only_rules": C_SQL + "SELECT dataset, name, alt, test, (row_number() OVER (PARTITION BY dataset ORDER BY test DESC, name, alt))::INT AS place FROM f WHERE kind = 'test_only'",
    "imbalanced_rules": C_SQL + "SELECT * FROM bad",
    "balance_split": C_SQL + """, pr AS (SELECT DISTINCT m.id FROM members m JOIN e ON e.example_id = m.id JOIN bad USING (dataset, name, alt)),
r AS (SELECT example_id, dataset, split, pr.id IS NOT NULL AS problem FROM e LEFT JOIN pr ON pr.id = example_id),
w AS (SELECT dataset, count(*) FILTER (split = 'test' AND problem) AS t, count(*) FILTER (split = 'valid' AND problem) AS v FROM r GROUP BY dataset),
k AS (SELECT example_id, row_number() OVER (PARTITION BY dataset ORDER BY md5(example_id::VARCHAR), example_id) AS k FROM r WHERE split = 'train' AND NOT problem)
SELECT example_id, dataset, split, CASE WHEN split <> 'train' AND problem THEN 'train' WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'valid' ELSE split END AS new_split FROM r JOIN w USING (dataset) LEFT JOIN k USING (example_id)""",
    "grammar_lengths": r"""WITH e AS (SELECT DISTINCT ON (example_id) dataset, program FROM examples WHERE program IS NOT NULL), n AS (SELECT dataset, len(list_filter(regexp_split_to_array(program, '\s+'), lambda x: x <> '')) AS n FROM e)
SELECT dataset, min(n)::INT AS least, max(n)::INT AS most, avg(n) AS mean, median(n) AS median FROM n GROUP BY dataset""",
    "deduplicated_problems": "SELECT task_id, max(grammar_id) AS grammar_id, arg_max(run_id, grammar_id) AS run_id, count(*) AS copies FROM " + one_per("predicted_grammars", "grammar_id") + " WHERE task_id IS NOT NULL GROUP BY task_id",
}
