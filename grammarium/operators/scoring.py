"""Scores of predictions: matches, BLEU, component sets, pass@k, rescue gains, bootstrap intervals.

Null predictions count as empty text, null golds never match; rows with one pred_id count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import small_or_shuffled, table, unique
from ..functions import text as T
from ..oracle import one_per

PASS_KS = (1, 3, 5)
RESAMPLES, SEED = 1000, 42


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "predictions"), "pred_id")


def answer(raw=None):
    """The program of a raw answer: the grammar block is dropped in the modes that ask for one."""
    raw = F.col("prediction") if raw is None else raw
    return T.program_of_output(raw, F.col("mode").isin("grammar", "rag_cot_with_grammar"))


def gold_in_prediction(spark, sf_dir):
    """Whether the raw answer holds the wanted program as it is written; an empty one always does."""
    return predictions(spark, sf_dir).select("pred_id", F.coalesce(F.contains(F.coalesce("prediction", F.lit("")), F.col("gold")), F.lit(False)).alias("hit"))


def accuracy(spark, sf_dir):
    """Share of answers that hold the wanted program, per run; a null gold isn't counted."""
    rows = predictions(spark, sf_dir).filter("gold is not null").select("run_id", F.contains(F.coalesce("prediction", F.lit("")), F.col("gold")).cast("int").alias("hit"))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))


def extracted_programs(spark, sf_dir):
    return predictions(spark, sf_dir).select("pred_id", answer().alias("program"), T.first_line(F.col("prediction")).alias("first_line"))


def netlists(spark, sf_dir):
    return predictions(spark, sf_dir).filter("dataset = 'spice' and prediction is not null").select("pred_id", T.netlist(F.col("prediction")).alias("netlist"))


def completions(spark, sf_dir):
    return predictions(spark, sf_dir).filter("dataset = 'mg_verilog' and prediction is not null").select("pred_id", T.completion(F.col("prediction")).alias("completion"))


def plans(spark, sf_dir):
    return predictions(spark, sf_dir).filter("dataset = 'pddl_blocksworld' and prediction is not null").select("pred_id", T.plan_steps(F.col("prediction")).alias("steps"))


def component_scores(spark, sf_dir):
    """Precision, recall and F1 of the component letters of netlists; both empty gives 1, one empty 0."""
    rows = predictions(spark, sf_dir).filter("dataset = 'spice' and prediction is not null and gold is not null")
    g, p = T.component_types(F.col("gold")), T.component_types(T.netlist(F.col("prediction")))
    s = rows.select("pred_id", F.size(g).alias("g"), F.size(p).alias("p"), F.size(F.array_intersect(g, p)).alias("h"))
    none = (F.col("g") == 0) & (F.col("p") == 0)
    share = lambda a, b: F.when(none, 1.0).when(b == 0, 0.0).otherwise(a / b)
    return s.select("pred_id", share(F.col("h"), F.col("p")).alias("precision"), share(F.col("h"), F.col("g")).alias("recall"), F.when(none, 1.0).otherwise(2.0 * F.col("h") / (F.col("g") + F.col("p"))).alias("f1"))


def program_bleu(spark, sf_dir):
    """BLEU-4 of the answer's program against gold, over the tokens of functional programs."""
    rows = predictions(spark, sf_dir).filter("dataset in ('geoquery', 'overnight') and prediction is not null and gold is not null")
    return rows.select("pred_id", T.bleu(T.list_tokens(F.col("gold")), T.list_tokens(T.first_line(answer()))).alias("bleu"))


def pass_at_k(spark, sf_dir):
    """Mean pass@k over examples of each run; null where an example has fewer than k samples."""
    rows = predictions(spark, sf_dir).select("run_id", "example_id", F.coalesce("exact_match", F.lit(False)).alias("ok"))
    per = rows.groupBy("run_id", "example_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("c"))
    return per.groupBy("run_id").agg(*[F.when(F.min("n") >= k, F.avg(T.pass_at_k(F.col("n"), F.col("c"), k))).alias(f"pass_{k}") for k in PASS_KS], F.count(F.lit(1)).alias("tasks"))


def samples_per_task(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("c"), F.coalesce(F.bool_or("exact_match"), F.lit(False)).alias("any_passed"))


def format_compliance(spark, sf_dir):
    """Share of answers of grammar modes that separate grammar and program by a line ``Program:`` or a closed grammar block."""
    rows = predictions(spark, sf_dir).filter("mode in ('grammar', 'rag_cot_with_grammar')")
    ok = F.contains("prediction", F.lit("\nProgram:\n")) | F.contains("prediction", F.lit("</grammar>"))
    return rows.groupBy("run_id").agg(F.avg(F.coalesce(ok, F.lit(False)).cast("int")).alias("compliant"))


def rescue(spark, sf_dir):
    """What an example gains if it falls back on answers with retrieval where the plain mode fails, per dataset."""
    rows = predictions(spark, sf_dir).select("dataset", "example_id", "mode", F.coalesce("exact_match", F.lit(False)).alias("ok"))
    side = lambda mode: rows.filter(F.col("mode") == mode).groupBy("dataset", "example_id").agg(F.bool_or("ok").alias(mode))
    both = side("program_only").join(side("rag_cot_with_grammar"), ["dataset", "example_id"])
    b, r = F.col("program_only"), F.col("rag_cot_with_grammar")
    return both.groupBy("dataset").agg(F.avg(b.cast("double")).alias("base"), F.avg((b | r).cast("double")).alias("blended"), F.count_if(~b & r).alias("rescued"), F.count(F.lit(1)).alias("n"))


def report_matrix(spark, sf_dir):
    """Accuracy by model and mode, a column for each mode; null where there are no rows."""
    runs = unique(table(spark, sf_dir, "batch_runs").select("run_id", "model"), "run_id")
    rows = predictions(spark, sf_dir).select("run_id", "mode", F.coalesce("exact_match", F.lit(False)).cast("double").alias("ok")).join(small_or_shuffled(runs), "run_id")
    return rows.groupBy("model").pivot("mode", ["cot", "grammar", "program_only", "rag_cot_with_grammar"]).agg(F.avg("ok"))


def bootstrap_interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float, float, float]:
    """(mean, low, high, std) of the means of resamples, 95 %; NaN is left out and nothing at all gives zeros."""
    v = values[~np.isnan(values)]
    if not len(v):
        return 0.0, 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(resamples)])
    return float(v.mean()), float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5)), float(means.std())


def bootstrap(spark, sf_dir):
    """Mean accuracy of each mode with its interval. A resample of 0/1 scores is a binomial draw, so only counts are needed, however many rows there are."""
    counts = predictions(spark, sf_dir).filter("exact_match is not null").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("c"))

    def draw(batches):
        for b in batches:
            out = []
            for mode, n, c in zip(b["mode"], b["n"], b["c"]):
                means = np.random.default_rng(SEED).binomial(n, c / n, RESAMPLES) / n
                out.append((mode, c / n, *np.percentile(means, (2.5, 97.5)), means.std()))
            yield pd.DataFrame(out, columns=["mode", "mean", "ci_low", "ci_high", "std"])

    return counts.mapInPandas(draw, "mode string, mean double, ci_low double, ci_high double, std double")


P = "WITH p AS " + one_per("predictions", "pred_id")
W = r"[\s\x1c-\x1f]"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NET = "CASE WHEN len(list_filter(x, lambda l: lower(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) = '.end')) > 0 THEN array_to_string(x[1:list_position(list_transform(x, lambda l: lower(regexp_replace(l, '^\\s+|\\s+$', '', 'g'))), '.end')], E'\\n') ELSE prediction END"
TYPES = "list_filter(list_distinct(list_transform(string_split({}, E'\\n'), lambda l: upper(regexp_replace(l, '^\\s+', '')[1:1]))), lambda c: c <> '' AND contains('" + T.COMPONENTS + "', c))"
QUERIES = {f.__name__: f for f in (gold_in_prediction, accuracy, extracted_programs, netlists, completions, plans, component_scores, program_bleu, pass_at_k, samples_per_task, format_compliance, rescue, report_matrix, bootstrap)}
PASS = "CASE WHEN min(n) >= {k} THEN avg(CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - {k}::DOUBLE / i)) END) END AS pass_{k}"
SIDES = r"^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$"
ORACLES = {
    "extracted_programs": P + f""" SELECT pred_id, regexp_replace(CASE WHEN mode IN ('grammar', 'rag_cot_with_grammar') THEN coalesce(string_split(prediction, 'Program:')[-1], '') ELSE coalesce(prediction, '') END, '{SIDES}', '', 'g') AS program,
CASE WHEN prediction IS NOT NULL THEN coalesce(list_filter(list_transform(string_split(prediction, E'\\n'), lambda l: regexp_replace(l, '{SIDES}', '', 'g')), lambda l: l <> '')[1], '') END AS first_line FROM p""",
    "gold_in_prediction": P + " SELECT pred_id, coalesce(contains(coalesce(prediction, ''), gold), false) AS hit FROM p",
    "accuracy": P + " SELECT run_id, count(*) AS n, avg(contains(coalesce(prediction, ''), gold)::INT) AS accuracy FROM p WHERE gold IS NOT NULL GROUP BY run_id",
    "netlists": P + f", q AS (SELECT pred_id, prediction, string_split(prediction, E'\\n') AS x FROM p WHERE dataset = 'spice' AND prediction IS NOT NULL) SELECT pred_id, {NET} AS netlist FROM q",
    "completions": P + r" , q AS (SELECT pred_id, CASE WHEN regexp_matches(prediction, '\bendmodule\b') THEN regexp_extract(prediction, '(?s)^(.*?\bendmodule\b)', 1) ELSE prediction || E'\nendmodule' END AS c FROM p WHERE dataset = 'mg_verilog' AND prediction IS NOT NULL) SELECT pred_id, CASE WHEN starts_with(c, E'\n') THEN c ELSE E'\n' || c END AS completion FROM q",
    "plans": P + " SELECT pred_id, list_filter(list_transform(string_split(prediction, E'\\n'), lambda l: " + STRIP.format("l") + "), lambda l: starts_with(l, '(')) AS steps FROM p WHERE dataset = 'pddl_blocksworld' AND prediction IS NOT NULL",
    "component_scores": P + f""", q AS (SELECT pred_id, gold, {NET} AS t FROM (SELECT *, string_split(prediction, E'\\n') AS x FROM p WHERE dataset = 'spice' AND prediction IS NOT NULL AND gold IS NOT NULL)),
s AS (SELECT pred_id, {TYPES.format('gold')} AS g, {TYPES.format('t')} AS q FROM q), n AS (SELECT pred_id, len(g) AS g, len(q) AS p, len(list_intersect(g, q)) AS h FROM s)
SELECT pred_id, CASE WHEN g = 0 AND p = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE h / p END AS precision, CASE WHEN g = 0 AND p = 0 THEN 1.0 WHEN g = 0 THEN 0.0 ELSE h / g END AS recall, CASE WHEN g = 0 AND p = 0 THEN 1.0 ELSE 2.0 * h / (g + p) END AS f1 FROM n""",
    "pass_at_k": P + ", t AS (SELECT run_id, example_id, count(*) AS n, count(*) FILTER (exact_match) AS c FROM p GROUP BY ALL) SELECT run_id, " + ", ".join(PASS.format(k=k) for k in PASS_KS) + ", count(*) AS tasks FROM t GROUP BY run_id",
    "samples_per_task": P + " SELECT example_id, count(*) AS n, count(*) FILTER (exact_match) AS c, coalesce(bool_or(exact_match), false) AS any_passed FROM p GROUP BY example_id",
    "format_compliance": P + " SELECT run_id, avg(coalesce(contains(prediction, E'\\nProgram:\\n') OR contains(prediction, '</grammar>'), false)::INT) AS compliant FROM p WHERE mode IN ('grammar', 'rag_cot_with_grammar') GROUP BY run_id",
    "rescue": P + ", s AS (SELECT dataset, example_id, bool_or(coalesce(exact_match, false)) FILTER (mode = 'program_only') AS b, bool_or(coalesce(exact_match, false)) FILTER (mode = 'rag_cot_with_grammar') AS r FROM p GROUP BY ALL) SELECT dataset, avg(b::INT) AS base, avg((b OR r)::INT) AS blended, count(*) FILTER (NOT b AND r) AS rescued, count(*) AS n FROM s WHERE b IS NOT NULL AND r IS NOT NULL GROUP BY dataset",
    "report_matrix": P + ", r AS " + one_per("batch_runs", "run_id") + " SELECT model, " + ", ".join(f"avg(coalesce(exact_match, false)::INT) FILTER (p.mode = '{m}') AS {m}" for m in ("cot", "grammar", "program_only", "rag_cot_with_grammar")) + " FROM p JOIN r USING (run_id) GROUP BY model",
}
