"""Rows brought together by keys or places, with what doesn't fit reported, and the figures made of them.

Of rows with one key the last, by id, counts where the text says so. Nulls never match.
Null scores count as 0 or false. An empty side gives no rows, or rows of the other side
where the query reports what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import grammar_alternatives, small_or_shuffled, table, unique
from ..functions import text as T
from ..oracle import one_per, rules_sql
from .corpus import LEAST_TEST_DF, MOST_TRAIN_DF, TOP, C_SQL, composition, rare_in_train
from .rules import MENTIONS, PAIRED, TERMINALS, examples, pairs_with_gold, predicted
from .sampling import SEED
from .scoring import component_scores, predictions

NUMERIC_CUTOFF, SHARE, FIRST_ROWS = 0.5, 0.1, 100
#: Rules whose results are also counted on their own.
WATCHED = ("string", "number")
MODES = ("program_only", "rag_cot_with_grammar")


def full_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that stand on one side only, left or right; none means that the sides fit."""
    ids = lambda df, side: df.select(key).distinct().filter(F.col(key).isNotNull()).withColumn(side, F.lit(True))
    both = ids(left, "l").join(ids(right, "r"), key, "full")
    return both.filter("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def specialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grammar_id, run_id, name, correct) for each generic rule of an example's grammar: whether the predicted rule has the same alternatives. Predicted, wanted and generic grammars are joined by example."""
    pairs = pairs_with_gold(spark, sf_dir)
    generic = F.filter("gold", lambda m: T.mentions_terminal(m["alt"], list(TERMINALS)))
    names = F.array_distinct(F.transform(generic, lambda m: m["name"]))
    rules = pairs.select("grammar_id", "run_id", "pred", "gold", F.explode(names).alias("name"))
    of = lambda side: F.array_sort(F.transform(F.filter(side, lambda m: m["name"] == F.col("name")), lambda m: m["alt"]))
    return rules.select("grammar_id", "run_id", "name", (of("pred") == of("gold")).alias("correct"))


def rule_equality(spark, sf_dir):
    return specialized(spark, sf_dir)


def specialization_accuracy(spark, sf_dir):
    """Per run: grammars with generic rules, the share with all of them right, totals and hits of the watched rules, and predictions left out because they are null."""
    rows = specialized(spark, sf_dir)
    per = rows.groupBy("run_id", "grammar_id").agg(F.bool_and("correct").alias("all_right"))
    n = per.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("all_right").cast("int")).alias("accuracy"))
    hit = lambda w, also: F.count_if((F.col("name") == w) & also)
    watched = rows.groupBy("run_id").agg(*[hit(w, F.lit(True)).alias(f"{w}_total") for w in WATCHED], *[hit(w, F.col("correct")).alias(f"{w}_correct") for w in WATCHED])
    skipped = predicted(spark, sf_dir).groupBy("run_id").agg(F.count_if(F.col("minimal_grammar").isNull()).alias("skipped"))
    return n.join(watched, "run_id").join(skipped, "run_id")


def diff_lists(spark, sf_dir):
    """Rules that a predicted grammar adds to and misses from the example's, sorted."""
    lines = lambda a, b: F.array_sort(F.transform(F.array_except(a, b), lambda m: F.concat(m["name"], F.lit(" ::= "), m["alt"])))
    return pairs_with_gold(spark, sf_dir).select("grammar_id", lines("pred", "gold").alias("added"), lines("gold", "pred").alias("missing"))


def pooled_alternatives(spark, sf_dir):
    """For each dataset and rule the sorted alternatives of all examples."""
    e = examples(spark, sf_dir).select("dataset", F.explode(grammar_alternatives(F.col("minimal_grammar"))).alias("m"))
    distinct = e.select("dataset", "m.name", "m.alt").distinct()
    return distinct.groupBy("dataset", "name").agg(F.array_sort(F.collect_list("alt")).alias("alternatives"))


def last_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, query, grammar_id, minimal_grammar): of the predicted grammars of a query the last."""
    rows = predicted(spark, sf_dir).filter("query is not null")
    return rows.groupBy("dataset", "query").agg(F.max_by(F.struct("grammar_id", "minimal_grammar"), "grammar_id").alias("x")).select("dataset", "query", "x.*")


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).filter("split <> 'train'")


def problem_grammars(spark, sf_dir):
    """Valid and test rows with the grammar predicted for their query: matched, excluded where it is null or empty, unmatched where there is none."""
    rows = held_out(spark, sf_dir).select("example_id", "dataset", "query").join(last_by_query(spark, sf_dir), ["dataset", "query"], "left")
    empty = F.col("minimal_grammar").isNull() | (F.col("minimal_grammar") == "")
    status = F.when(F.col("grammar_id").isNull(), "unmatched").when(empty, "excluded").otherwise("matched")
    return rows.select("example_id", F.col("grammar_id").cast("string").alias("grammar_id"), status.alias("status"))


def run_keys(spark, sf_dir):
    """Runs that only the manifests or only the predictions know."""
    return full_keys(table(spark, sf_dir, "batch_runs"), table(spark, sf_dir, "predictions"), "run_id")


def failures(spark, sf_dir):
    """Answers that didn't match, with their example's grammar."""
    e = examples(spark, sf_dir).select("example_id", "minimal_grammar")
    missed = predictions(spark, sf_dir).filter(~F.coalesce("exact_match", F.lit(False))).select("pred_id", "example_id")
    return missed.join(e, "example_id").select("pred_id", "example_id", "minimal_grammar")


def side(rows: DataFrame, mode: str) -> DataFrame:
    return rows.filter(F.col("mode") == mode)


def rescue_by_gold(spark, sf_dir):
    """Per dataset: plain answers joined with the last answer with retrieval to the same wanted program; repeats on the plain side stay. What a failed plain answer gains from the other."""
    rows = predictions(spark, sf_dir).filter("gold is not null").select("pred_id", "dataset", "gold", "mode", F.coalesce("exact_match", F.lit(False)).alias("ok"))
    other = side(rows, MODES[1]).groupBy("dataset", "gold").agg(F.max_by("ok", "pred_id").alias("other"))
    both = side(rows, MODES[0]).join(other, ["dataset", "gold"])
    return blended(both, F.col("ok").cast("double"), F.col("other").cast("double"), ~F.col("ok"))


def blended(both: DataFrame, base: Column, other: Column, failed: Column) -> DataFrame:
    """Means of the base score and of the score that takes the other's where it failed, rounded to 4 places, and how many changed."""
    mixed = F.when(failed, other).otherwise(base)
    rows = both.select("dataset", base.alias("b"), mixed.alias("m"))
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("b"), 4).alias("base"), F.round(F.avg("m"), 4).alias("blended"), F.count_if(F.col("b") != F.col("m")).alias("rescued"))


def rescue_numeric(spark, sf_dir):
    """The same by the best F1 of the components of netlists, for examples that both modes answered: below the cutoff the other mode's counts."""
    rows = component_scores(spark, sf_dir).join(predictions(spark, sf_dir).select("pred_id", "dataset", "example_id", "mode"), "pred_id")
    one = lambda mode, name: side(rows, mode).groupBy("dataset", "example_id").agg(F.max("f1").alias(name))
    both = one(MODES[0], "x").join(one(MODES[1], "y"), ["dataset", "example_id"])
    return blended(both, F.col("x"), F.col("y"), F.col("x") < NUMERIC_CUTOFF)


def component_summary(spark, sf_dir):
    """Mean precision, recall and F1 of netlists' components per run."""
    rows = component_scores(spark, sf_dir).join(predictions(spark, sf_dir).select("pred_id", "run_id"), "pred_id")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def sample_numbers(spark, sf_dir):
    """The number of each answer among those of its example and run, in the order of ids; an answer without either has none."""
    place = F.row_number().over(Window.partitionBy("run_id", "example_id").orderBy("pred_id")) - 1
    return predictions(spark, sf_dir).filter("run_id is not null and example_id is not null").select("pred_id", place.alias("completion_id"))


def unattempted(spark, sf_dir):
    """Valid and test rows without any answer."""
    return held_out(spark, sf_dir).select("example_id").join(predictions(spark, sf_dir).select("example_id"), "example_id", "left_anti")


def rule_ratios(spark, sf_dir):
    """Ratio of test to train frequency of each rule, with both."""
    return composition(spark, sf_dir).select("dataset", "name", "alt", "train_df", "test_df", "ratio")


def band_rules(spark, sf_dir):
    """Of the rules that are novel in test rows, cut to the first ones, those frequent there and rare in train rows."""
    rows = rare_in_train(spark, sf_dir).join(composition(spark, sf_dir).select("dataset", "name", "alt", "train_df", "test_df"), ["dataset", "name", "alt"])
    return rows.filter((F.round("test_df", 6) >= LEAST_TEST_DF) & (F.round("train_df", 6) < MOST_TRAIN_DF)).select("dataset", "name", "alt", "place")


def train_only_rules(spark, sf_dir):
    """Rules that no test row holds, with the number of train rows."""
    return composition(spark, sf_dir).filter("kind = 'train_only'").select("dataset", "name", "alt", "train")


def macro_frequency(spark, sf_dir):
    """Mean over a dataset's rules of their test frequency, each rounded to 4 places first."""
    rows = composition(spark, sf_dir).filter("test > 0").select("dataset", F.round("test_df", 4).alias("f"))
    return rows.groupBy("dataset").agg(F.avg("f").alias("macro"))


def first_rows(spark, sf_dir):
    """Rows of each dataset and split up to a place, 0 of which would mean all."""
    return examples(spark, sf_dir).filter(F.lit(FIRST_ROWS == 0) | (F.col("pos") < FIRST_ROWS)).select("example_id", "dataset", "split", "pos")


def proportional_sample(spark, sf_dir):
    """A share of all rows, their number rounded half to even, in the order of a seeded digest. Digests are counted by their first 16 bits, so only the rows of one of these buckets are ranked."""
    e = examples(spark, sf_dir).select("example_id", F.md5(F.concat_ws("-", F.col("example_id").cast("string"), F.lit(str(SEED)))).alias("d"))
    return least_by_digest(e, F.bround(F.count(F.lit(1)) * F.lit(SHARE)).cast("bigint")).select("example_id")


def least_by_digest(rows: DataFrame, want: Column) -> DataFrame:
    """Rows of rows(example_id, d) with the least digests; `want` is an aggregate of all rows."""
    cut = F.substring("d", 1, 4)
    sizes = rows.groupBy(cut.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # 65 536 at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = rows.agg(want.alias("want"))
    edges = sizes.select("bucket", "n", before.alias("before")).join(F.broadcast(total), F.lit(True))
    placed = rows.withColumn("bucket", cut).join(F.broadcast(edges), "bucket")
    whole = placed.filter("before + n <= want").select("example_id", "d")
    edge = placed.filter("before < want and before + n > want")
    ranked = edge.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("d", "example_id"))).filter(F.col("before") + F.col("k") <= F.col("want"))
    return whole.union(ranked.select("example_id", "d"))


def token_match(spark, sf_dir):
    """Whether a prediction holds the wanted program, both as tokens parted by blanks."""
    spaced = lambda c: F.array_join(T.list_tokens(F.coalesce(c, F.lit(""))), " ")
    rows = predictions(spark, sf_dir).filter("dataset = 'overnight' and gold is not null")
    return rows.select("pred_id", F.contains(spaced(F.col("prediction")), spaced(F.col("gold"))).alias("hit"))


def set_iou(spark, sf_dir):
    """Common over all different tokens of prediction and wanted program; 0 where both have none."""
    tokens = lambda c: F.array_distinct(T.list_tokens(c))
    rows = predictions(spark, sf_dir).filter("prediction is not null and gold is not null").select("pred_id", tokens(F.col("gold")).alias("g"), tokens(F.col("prediction")).alias("p"))
    both, all_ = F.size(F.array_intersect("g", "p")), F.size(F.array_union("g", "p"))
    return rows.select("pred_id", F.when(all_ > 0, both / all_).otherwise(0.0).alias("iou"))


#: Which aggregate goes with which score of a row, by dataset; fixed values of reports.
METRICS = (("geoquery", "accuracy", "exact_match"), ("overnight", "accuracy", "exact_match"), ("pddl_blocksworld", "accuracy", "exact_match"), ("smiles", "accuracy", "exact_match"), ("spice", "component_f1", "f1"), ("mg_verilog", "pass_at_k", "exact_match"))


def metric_registry(spark, sf_dir):
    """The metrics of the datasets that examples has."""
    known = spark.createDataFrame(METRICS, "dataset string, metric string, field string")
    return F.broadcast(known).join(examples(spark, sf_dir).select("dataset").distinct(), "dataset")


def tidy_accuracy(spark, sf_dir):
    """Rows of a bar chart: model and mode, mean accuracy and its normal 95 % interval, cut to 0 and 1."""
    runs = unique(table(spark, sf_dir, "batch_runs").select("run_id", "model"), "run_id")
    rows = predictions(spark, sf_dir).select("run_id", "mode", F.coalesce("exact_match", F.lit(False)).cast("double").alias("ok")).join(small_or_shuffled(runs), "run_id")
    mean = rows.groupBy(F.col("model").alias("series"), F.col("mode").alias("x")).agg(F.avg("ok").alias("y"), F.count(F.lit(1)).alias("n"))
    half = 1.96 * F.sqrt(F.col("y") * (1 - F.col("y")) / F.col("n"))
    ends = F.greatest(F.lit(0.0), F.col("y") - half), F.least(F.lit(1.0), F.col("y") + half)
    return mean.select(F.lit("accuracy").alias("chart"), "series", "x", F.round("y", 6).alias("y"), F.round(ends[0], 6).alias("lo"), F.round(ends[1], 6).alias("hi"))


def stacked_gain(spark, sf_dir):
    """Rows of a stacked chart: what plain answers reach, and what retrieval adds to it."""
    rows = rescue_by_gold(spark, sf_dir)
    parts = F.array(F.struct(F.lit("base").alias("series"), F.col("base").alias("y")), F.struct(F.lit("gain").alias("series"), F.round(F.col("blended") - F.col("base"), 4).alias("y")))
    return rows.select(F.col("dataset").alias("x"), F.explode(parts).alias("p")).select("x", "p.series", "p.y")


P = "WITH p AS " + one_per("predictions", "pred_id")
E = "WITH e AS " + one_per("examples", "example_id")
GEN = f""", gen AS (SELECT DISTINCT id, name FROM alts WHERE {MENTIONS}),
sp AS (SELECT pr.grammar_id, pr.run_id, gen.name,
 coalesce((SELECT list(DISTINCT pm.alt ORDER BY pm.alt) FROM pm WHERE pm.grammar_id = pr.grammar_id AND pm.name = gen.name), []) = coalesce((SELECT list(DISTINCT gm.alt ORDER BY gm.alt) FROM gm WHERE gm.grammar_id = pr.grammar_id AND gm.name = gen.name), []) AS correct
 FROM pairs pr JOIN gen ON gen.id = pr.example_id)
"""
LIST = r"regexp_extract_all(coalesce({}, ''), '[a-zA-Z0-9_.]+|[^\s]')"
BLEND = "SELECT dataset, count(*) AS n, round(avg(b), 4) AS base, round(avg(m), 4) AS blended, count(*) FILTER (b <> m) AS rescued FROM x GROUP BY dataset"
GOLDEN = P + """, s AS (SELECT pred_id, dataset, gold, mode, coalesce(exact_match, false) AS ok FROM p WHERE gold IS NOT NULL),
o AS (SELECT dataset, gold, arg_max(ok, pred_id) AS other FROM s WHERE mode = 'rag_cot_with_grammar' GROUP BY ALL),
x AS (SELECT dataset, ok::INT::DOUBLE AS b, CASE WHEN ok THEN 1.0 ELSE other::INT::DOUBLE END AS m FROM s JOIN o USING (dataset, gold) WHERE mode = 'program_only')
"""
LAST = E + ", g AS (SELECT dataset, query, max(grammar_id) AS grammar_id, arg_max(row(minimal_grammar), grammar_id) AS x FROM " + one_per("predicted_grammars", "grammar_id") + " WHERE query IS NOT NULL GROUP BY ALL)"
QUERIES = {
    f.__name__: f
    for f in (
        rule_equality, specialization_accuracy, diff_lists, pooled_alternatives, problem_grammars, run_keys, failures, rescue_by_gold, rescue_numeric, component_summary, sample_numbers, unattempted,
        rule_ratios, band_rules, train_only_rules, macro_frequency, first_rows, proportional_sample, token_match, set_iou, metric_registry, tidy_accuracy, stacked_gain,
    )
}


def _component_sql() -> str:
    from .scoring import ORACLES as S

    return S["component_scores"]


ORACLES = {
    "rule_equality": PAIRED + GEN + "SELECT * FROM sp",
    "specialization_accuracy": PAIRED + GEN + """, per AS (SELECT run_id, grammar_id, bool_and(correct) AS a FROM sp GROUP BY ALL), n AS (SELECT run_id, count(*) AS n, avg(a::INT) AS accuracy FROM per GROUP BY run_id),
w AS (SELECT run_id, count(*) FILTER (name = 'string') AS string_total, count(*) FILTER (name = 'number') AS number_total, count(*) FILTER (name = 'string' AND correct) AS string_correct, count(*) FILTER (name = 'number' AND correct) AS number_correct FROM sp GROUP BY run_id),
sk AS (SELECT run_id, count(*) FILTER (minimal_grammar IS NULL) AS skipped FROM p GROUP BY run_id) SELECT * FROM n JOIN w USING (run_id) JOIN sk USING (run_id)""",
    "diff_lists": PAIRED + """SELECT grammar_id, coalesce(list(name || ' ::= ' || alt ORDER BY name || ' ::= ' || alt) FILTER (p AND NOT g), []::VARCHAR[]) AS added, coalesce(list(name || ' ::= ' || alt ORDER BY name || ' ::= ' || alt) FILTER (g AND NOT p), []::VARCHAR[]) AS missing FROM pairs LEFT JOIN u USING (grammar_id) GROUP BY grammar_id""",
    "pooled_alternatives": E + "," + rules_sql("e", "example_id") + " SELECT dataset, name, list(DISTINCT alt ORDER BY alt) AS alternatives FROM members JOIN e ON id = example_id GROUP BY ALL",
    "problem_grammars": LAST + " SELECT example_id, grammar_id::VARCHAR AS grammar_id, CASE WHEN grammar_id IS NULL THEN 'unmatched' WHEN coalesce(x[1], '') = '' THEN 'excluded' ELSE 'matched' END AS status FROM e LEFT JOIN g USING (dataset, query) WHERE split <> 'train'",
    "run_keys": "SELECT coalesce(b.run_id, p.run_id) AS run_id, CASE WHEN b.run_id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT run_id FROM batch_runs WHERE run_id IS NOT NULL) b FULL JOIN (SELECT DISTINCT run_id FROM predictions WHERE run_id IS NOT NULL) p ON b.run_id = p.run_id WHERE b.run_id IS NULL OR p.run_id IS NULL",
    "failures": P + ", e AS " + one_per("examples", "example_id") + " SELECT pred_id, example_id, e.minimal_grammar FROM p JOIN e USING (example_id) WHERE NOT coalesce(exact_match, false)",
    "rescue_by_gold": GOLDEN + BLEND,
    "rescue_numeric": "WITH cs AS (" + _component_sql() + "), r AS (SELECT dataset, example_id, max(f1) FILTER (mode = 'program_only') AS b, max(f1) FILTER (mode = 'rag_cot_with_grammar') AS y FROM cs JOIN " + one_per("predictions", "pred_id") + f" q USING (pred_id) GROUP BY ALL), x AS (SELECT dataset, b, CASE WHEN b < {NUMERIC_CUTOFF} THEN y ELSE b END AS m FROM r WHERE b IS NOT NULL AND y IS NOT NULL) " + BLEND,
    "component_summary": "WITH cs AS (" + _component_sql() + ") SELECT run_id, count(*) AS n, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM cs JOIN " + one_per("predictions", "pred_id") + " q USING (pred_id) GROUP BY run_id",
    "sample_numbers": P + " SELECT pred_id, (row_number() OVER (PARTITION BY run_id, example_id ORDER BY pred_id) - 1)::INT AS completion_id FROM p WHERE run_id IS NOT NULL AND example_id IS NOT NULL",
    "unattempted": E + " SELECT example_id FROM e WHERE split <> 'train' AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.example_id = e.example_id)",
    "rule_ratios": C_SQL + "SELECT dataset, name, alt, train_df, test_df, test_df / (train_df + 1e-7) AS ratio FROM d",
    "band_rules": C_SQL + f", r AS (SELECT dataset, name, alt, train_df, test_df, (row_number() OVER (PARTITION BY dataset ORDER BY round(novelty, 6) + 0.0 DESC, name, alt))::INT AS place FROM f WHERE kind = 'shared' QUALIFY place <= {TOP}) SELECT dataset, name, alt, place FROM r WHERE round(test_df, 6) >= {LEAST_TEST_DF} AND round(train_df, 6) < {MOST_TRAIN_DF}",
    "train_only_rules": C_SQL + "SELECT dataset, name, alt, train FROM f WHERE kind = 'train_only'",
    "macro_frequency": C_SQL + "SELECT dataset, avg(round(test_df, 4)) AS macro FROM f WHERE test > 0 GROUP BY dataset",
    "first_rows": E + f" SELECT example_id, dataset, split, pos FROM e WHERE pos < {FIRST_ROWS}",
    "proportional_sample": E + f" SELECT example_id FROM e QUALIFY row_number() OVER (ORDER BY md5(example_id || '-{SEED}'), example_id) <= round_even((SELECT count(*) FROM e) * {SHARE}, 0)",
    "token_match": P + " SELECT pred_id, contains(array_to_string(" + LIST.format("prediction") + ", ' '), array_to_string(" + LIST.format("gold") + ", ' ')) AS hit FROM p WHERE dataset = 'overnight' AND gold IS NOT NULL",
    "set_iou": P + ", t AS (SELECT pred_id, list_distinct(" + LIST.format("gold") + ") AS g, list_distinct(" + LIST.format("prediction") + ") AS q FROM p WHERE prediction IS NOT NULL AND gold IS NOT NULL), n AS (SELECT pred_id, len(list_intersect(g, q)) AS b, len(g) + len(q) AS s FROM t) SELECT pred_id, CASE WHEN s > b THEN b / (s - b) ELSE 0.0 END AS iou FROM n",
    "metric_registry": "SELECT m.* FROM (VALUES " + ", ".join(f"{m}" for m in METRICS) + ") m(dataset, metric, field) WHERE dataset IN (SELECT dataset FROM examples)",
    "tidy_accuracy": P + ", r AS " + one_per("batch_runs", "run_id") + """, a AS (SELECT model AS series, p.mode AS x, avg(coalesce(exact_match, false)::INT) AS y, count(*) AS n FROM p JOIN r USING (run_id) GROUP BY ALL),
h AS (SELECT *, 1.96 * sqrt(y * (1 - y) / n) AS h FROM a)
SELECT 'accuracy' AS chart, series, x, round(y, 6) AS y, round(greatest(0.0, y - h), 6) AS lo, round(least(1.0, y + h), 6) AS hi FROM h""",
    "stacked_gain": GOLDEN + ", z AS (" + BLEND + ") SELECT dataset AS x, unnest(['base', 'gain']) AS series, unnest([base, round(blended - base, 4)]) AS y FROM z",
}
