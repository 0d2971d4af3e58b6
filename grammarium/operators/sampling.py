"""Splits, samples, mixtures and controlled corruption; all follow a hash of the key, so a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import grammar_alternatives
from ..oracle import one_per, rules_sql
from .rules import examples, rules

VALID, TEST, SEED, DEMOS, RATIO, CORRUPT = 0.1, 0.1, 42, 4, 0.25, 0.2


def by_digest(rows: DataFrame, digest, part: str = "dataset", key: str = "example_id") -> DataFrame:
    """rows with k, the place of each in its part in the order of a digest in hex. Rows are counted by the digest's first four digits, the counts are cumulated, and only rows of one such bucket are ranked together, so no part passes one task."""
    d, bucket = "_digest", F.substring("_digest", 1, 4).alias("_bucket")
    placed = rows.withColumn(d, digest)
    sizes = placed.groupBy(part, bucket).agg(F.count(F.lit(1)).alias("_n"))  # 65 536 for each part at most
    before = F.sum("_n").over(Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_bucket", F.substring(d, 1, 4)).withColumn("k", F.row_number().over(Window.partitionBy(part, "_bucket").orderBy(d, key)))
    return ranked.join(starts, [part, "_bucket"]).withColumn("k", (F.col("k") + F.col("_before")).cast("int")).drop(d, "_bucket", "_before")


def seeded(key: str = "example_id", seed: int = SEED):
    """A seeded digest of the key; digests are the same in other engines."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def sized_split(spark, sf_dir):
    """A new split of each dataset with exact sizes: the whole part of n * TEST rows, then of n * VALID rows, the rest for training."""
    e = examples(spark, sf_dir).select("example_id", "dataset")
    n = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    rows = by_digest(e, seeded()).join(n, "dataset")
    t, v = F.floor(F.col("n") * TEST), F.floor(F.col("n") * VALID)
    return rows.select("example_id", "dataset", F.when(F.col("k") <= t, "test").when(F.col("k") <= t + v, "valid").otherwise("train").alias("split"))


def demonstrations(spark, sf_dir):
    """DEMOS train rows of each dataset, drawn without replacement."""
    e = examples(spark, sf_dir).filter("split = 'train'").select("example_id", "dataset")
    return by_digest(e, seeded()).filter(F.col("k") <= DEMOS)


def first_demonstrations(spark, sf_dir):
    """The first DEMOS train rows of each dataset by their place; ties by id."""
    e = examples(spark, sf_dir).filter("split = 'train'").select("example_id", "dataset", "pos")
    return e.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy("pos", "example_id"))).filter(F.col("k") <= DEMOS).select("example_id", "dataset", "k")


def mixed_prompts(spark, sf_dir):
    """Train rows of which a share of RATIO, rounded half to even, gets a prompt without grammar."""
    e = examples(spark, sf_dir).filter("split = 'train'").select("example_id", "dataset")
    n = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return by_digest(e, seeded()).join(n, "dataset").select("example_id", "dataset", (F.col("k") > F.bround(F.col("n") * RATIO)).alias("with_grammar"))


def doubled_prompts(spark, sf_dir):
    """Every train row twice, with and without grammar."""
    return examples(spark, sf_dir).filter("split = 'train'").select("example_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("with_grammar"))


def removed_alternatives(spark, sf_dir):
    """Corrupted grammars: one alternative, drawn by digest, is taken from each of a share of CORRUPT of the rows with a grammar."""
    r = rules(examples(spark, sf_dir).select("example_id", "minimal_grammar"), "example_id")
    chosen = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("example_id").cast("string"), F.lit("rows"))), 1, 4), 16, 10).cast("int") < int(CORRUPT * 65_536)
    order = F.row_number().over(Window.partitionBy("example_id").orderBy(F.md5(F.concat_ws("|", "name", "alt")), "rule_pos", "alt_pos"))
    return r.filter(chosen).withColumn("k", order).filter("k = 1").select("example_id", "name", "alt")


def added_alternatives(spark, sf_dir):
    """Corrupted grammars: to each chosen row one alternative of its dataset's pool is added, for a rule that it has and that it doesn't hold yet, the least by digest. The pool is joined by (dataset, rule), and of a rule's pool only the least alternatives can be drawn: one more than the largest number that any grammar holds."""
    e = examples(spark, sf_dir).select("example_id", "dataset", F.array_distinct(grammar_alternatives(F.col("minimal_grammar"))).alias("have"))
    chosen = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("example_id").cast("string"), F.lit("add"))), 1, 4), 16, 10).cast("int") < int(CORRUPT * 65_536)
    cells = e.select("example_id", "dataset", F.explode("have").alias("m")).select("example_id", "dataset", "m.name", "m.alt")
    most = cells.groupBy("example_id", "name").count().agg(F.max("count")).first()[0] or 0
    digest = F.md5(F.concat_ws("|", "name", "alt"))
    pool = cells.select("dataset", "name", "alt").distinct().withColumn("k", F.row_number().over(Window.partitionBy("dataset", "name").orderBy(digest, "alt"))).filter(F.col("k") <= most + 1)
    pools = pool.groupBy("dataset", "name").agg(F.array_sort(F.collect_list(F.struct(digest.alias("d"), "name", "alt"))).alias("pool"))
    wanted = e.filter(chosen).select("example_id", "dataset", "have", F.explode(F.array_distinct(F.transform("have", lambda m: m["name"]))).alias("name"))
    left = wanted.join(pools, ["dataset", "name"]).select("example_id", F.get(F.filter("pool", lambda p: ~F.array_contains("have", F.struct(p["name"].alias("name"), p["alt"].alias("alt")))), F.lit(0)).alias("p"))
    return left.filter("p is not null").groupBy("example_id").agg(F.min("p").alias("p")).select("example_id", "p.name", "p.alt")


E = "WITH e AS " + one_per("examples", "example_id")
PLACE = f"row_number() OVER (PARTITION BY dataset ORDER BY md5(example_id || '-{SEED}'), example_id)"
DRAWN = f"('0x' || substr(md5({{}} || '-{{}}'), 1, 4))::INT < {int(CORRUPT * 65536)}"
QUERIES = {f.__name__: f for f in (sized_split, demonstrations, first_demonstrations, mixed_prompts, doubled_prompts, removed_alternatives, added_alternatives)}
ORACLES = {
    "sized_split": E + f", r AS (SELECT example_id, dataset, {PLACE} AS k, count(*) OVER (PARTITION BY dataset) AS n FROM e) SELECT example_id, dataset, CASE WHEN k <= floor(n * {TEST}) THEN 'test' WHEN k <= floor(n * {TEST}) + floor(n * {VALID}) THEN 'valid' ELSE 'train' END AS split FROM r",
    "demonstrations": E + f" SELECT example_id, dataset, ({PLACE})::INT AS k FROM e WHERE split = 'train' QUALIFY k <= {DEMOS}",
    "first_demonstrations": E + f" SELECT example_id, dataset, (row_number() OVER (PARTITION BY dataset ORDER BY pos, example_id))::INT AS k FROM e WHERE split = 'train' QUALIFY k <= {DEMOS}",
    "mixed_prompts": E + f", r AS (SELECT example_id, dataset, {PLACE} AS k, count(*) OVER (PARTITION BY dataset) AS n FROM e WHERE split = 'train') SELECT example_id, dataset, k > round_even(n * {RATIO}, 0) AS with_grammar FROM r",
    "doubled_prompts": E + " SELECT example_id, unnest([true, false]) AS with_grammar FROM e WHERE split = 'train'",
    "removed_alternatives": E + "," + rules_sql("e", "example_id") + " SELECT id AS example_id, name, alt FROM alts WHERE " + DRAWN.format("id", "rows") + " QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5(name || '|' || alt), rule_pos, alt_pos) = 1",
    "added_alternatives": E + "," + rules_sql("e", "example_id") + ", pool AS (SELECT DISTINCT dataset, name, alt FROM members JOIN e ON example_id = id), w AS (SELECT DISTINCT id, dataset, name FROM members JOIN e ON example_id = id WHERE " + DRAWN.format("id", "add") + ") SELECT id AS example_id, name, alt FROM w JOIN pool USING (dataset, name) WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.id = w.id AND m.name = w.name AND m.alt = pool.alt) QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5(name || '|' || alt), name, alt) = 1",
}
