"""Grammars as relations: parsing, rendering, pruning, differences, health, label vectors.

Null grammars have no rules; lines without ``::=`` are skipped; of several lines with
one name the last counts. Rows with one key count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import grammar_alternatives, grammar_lines, table, unique
from ..functions import text as T
from ..oracle import one_per, rules_sql


def rules(df: DataFrame, key: str, grammar: str = "minimal_grammar") -> DataFrame:
    """(key, rule_pos, name, alt_pos, alt) of every alternative; places start at 0 and keep the order of lines."""
    lines = df.select(key, F.explode(grammar_lines(F.col(grammar))).alias("r"))
    alts = lines.select(key, (-F.col("r.neg_pos")).alias("rule_pos"), F.col("r.name").alias("name"), F.posexplode(F.split("r.rhs", r" \| ", -1)).alias("alt_pos", "alt"))
    return alts.withColumn("alt", F.btrim("alt", F.lit(" \t\r"))).filter("alt <> ''")


def members(df: DataFrame, key: str, grammar: str = "minimal_grammar") -> DataFrame:
    """Distinct (key, name, alt); distinct within a row, so nothing is shuffled."""
    return df.select(key, F.explode(F.array_distinct(grammar_alternatives(F.col(grammar)))).alias("m")).select(key, "m.name", "m.alt")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "examples"), "example_id")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "predicted_grammars"), "grammar_id")


def rule_table(spark, sf_dir):
    return rules(examples(spark, sf_dir).select("example_id", "minimal_grammar"), "example_id")


def rendered_grammars(spark, sf_dir):
    return examples(spark, sf_dir).select("example_id", T.render(F.col("minimal_grammar")).alias("rendered"))


#: Rules that scaffold a grammar and terminals that stand for any value; parameters with these defaults.
SCAFFOLD = ("query", "answer_type", "plan")
TERMINALS = ("CITYNAME", "STATENAME", "PLACENAME", "RIVERNAME", "NUMBER", "IDENTIFIER", "OBJECT_NAME")


def filter_rules(rows: DataFrame, exclude=SCAFFOLD, terminals=TERMINALS) -> DataFrame:
    """Drops rules by name and alternatives that name an excluded terminal outside literals; rules left empty vanish."""
    return rows.filter(~F.col("name").isin(*exclude) & ~T.mentions_terminal(F.col("alt"), list(terminals)))


def filtered_rules(spark, sf_dir):
    return filter_rules(rules(examples(spark, sf_dir).select("example_id", "minimal_grammar"), "example_id"))


def generic_rules(spark, sf_dir):
    """All alternatives of rules with at least one generic one."""
    rows = rules(examples(spark, sf_dir).select("example_id", "minimal_grammar"), "example_id")
    generic = F.max(T.mentions_terminal(F.col("alt"), list(TERMINALS))).over(Window.partitionBy("example_id", "name"))
    return rows.withColumn("generic", generic).filter("generic").drop("generic")


def pairs_with_gold(spark, sf_dir):
    """Predicted grammars with an example: both members' arrays. A null prediction is kept apart as skipped."""
    arr = lambda c: F.array_distinct(grammar_alternatives(F.col(c)))
    gold = examples(spark, sf_dir).select("example_id", F.coalesce(arr("minimal_grammar"), F.array().cast("array<struct<name:string,alt:string>>")).alias("gold"))
    return predicted(spark, sf_dir).filter("example_id is not null and minimal_grammar is not null").select("grammar_id", "run_id", "example_id", arr("minimal_grammar").alias("pred")).join(gold, "example_id")


def grammar_diff(spark, sf_dir):
    """Members that a predicted grammar adds to and misses from the example's, and the class of the row."""
    return pairs_with_gold(spark, sf_dir).select("grammar_id", *diff_columns())


def diff_columns():
    added, missing = F.size(F.array_except("pred", "gold")), F.size(F.array_except("gold", "pred"))
    kind = F.when((added == 0) & (missing == 0), "exact").when(missing == 0, "only_added").when(added == 0, "only_missing").otherwise("both")
    return added.alias("added"), missing.alias("missing"), ((added <= 1) & (missing <= 1)).alias("relaxed"), kind.alias("kind")


def grammar_diff_summary(spark, sf_dir):
    """Shares of the classes and mean sizes per run; a run without a usable row has no row."""
    rows = pairs_with_gold(spark, sf_dir).select("run_id", *diff_columns())
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("kind") == "exact").alias("exact"), share(F.col("relaxed")).alias("relaxed"), share(F.col("kind") == "only_added").alias("only_added"),
        share(F.col("kind") == "only_missing").alias("only_missing"), share(F.col("kind") == "both").alias("both"), F.avg("added").alias("mean_added"), F.avg("missing").alias("mean_missing"),
    )


def grammar_health(spark, sf_dir):
    """Rules that are referred to but not defined, and defined but (one step) not referred to, of each predicted grammar."""
    lines = grammar_lines(F.col("minimal_grammar"))
    rows = predicted(spark, sf_dir).select("grammar_id", F.coalesce(lines, F.array().cast("array<struct<name:string,neg_pos:int,rhs:string>>")).alias("l"), F.coalesce(grammar_alternatives(F.col("minimal_grammar")), F.array().cast("array<struct<name:string,alt:string>>")).alias("a"))
    defined = F.transform("l", lambda r: r["name"])
    referred = F.array_distinct(F.flatten(F.transform("a", lambda m: T.references(m["alt"]))))
    start = F.transform(F.slice(F.array_sort(F.transform("l", lambda r: F.struct((-r["neg_pos"]).alias("p"), r["name"].alias("name")))), 1, 1), lambda r: r["name"])
    return rows.select("grammar_id", F.array_sort(F.array_except(referred, defined)).alias("incomplete"), F.array_sort(F.array_except(F.array_except(defined, referred), start)).alias("unreachable"))


def grammar_health_summary(spark, sf_dir):
    rows = grammar_health(spark, sf_dir).join(predicted(spark, sf_dir).select("grammar_id", "run_id"), "grammar_id")
    i, u = F.size("incomplete") > 0, F.size("unreachable") > 0
    kind = F.when(i & u, "both").when(i, "incomplete").when(u, "unreachable").otherwise("neither")
    return rows.groupBy("run_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("grammars"))


def alternative_pool(spark, sf_dir):
    """For each dataset and rule the distinct alternatives of all examples, sorted."""
    e = examples(spark, sf_dir).select("example_id", "dataset", "minimal_grammar")
    pool = e.select("dataset", F.explode(grammar_alternatives(F.col("minimal_grammar"))).alias("m")).select("dataset", "m.name", "m.alt").distinct()
    return pool.groupBy("dataset", "name").agg(F.count(F.lit(1)).alias("alternatives"), F.min("alt").alias("first_alt"), F.max("alt").alias("last_alt"))


def unused_alternatives(spark, sf_dir):
    """Alternatives that train rows define and no valid or test row uses, compared in normal form."""
    e = examples(spark, sf_dir).select("dataset", "split", F.explode(grammar_alternatives(F.col("minimal_grammar"))).alias("m"))
    rows = e.select("dataset", (F.col("split") == "train").alias("train"), F.col("m.name").alias("name"), T.normal_alternative(F.col("m.alt")).alias("alt"))
    return rows.groupBy("dataset", "name", "alt").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("o")).filter("t and not o").select("dataset", "name", "alt")


def label_counts(spark, sf_dir):
    """Label index of the train rules: dense ids by (name, alt) within a dataset, with the rows that carry each."""
    m = members(examples(spark, sf_dir).filter("split = 'train'").select(F.struct("example_id", "dataset").alias("k"), "minimal_grammar"), "k")
    n = m.groupBy("k.dataset", "name", "alt").agg(F.count(F.lit(1)).alias("positives"))
    return n.withColumn("label", F.row_number().over(Window.partitionBy("dataset").orderBy("name", "alt")) - 1)


def label_f1(spark, sf_dir):
    """Micro F1 and exact match of predicted members against gold ones, per run."""
    rows = pairs_with_gold(spark, sf_dir).select("run_id", F.size(F.array_intersect("pred", "gold")).alias("tp"), F.size("pred").alias("p"), F.size("gold").alias("g"))
    t = rows.groupBy("run_id").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("g").alias("g"), F.avg(((F.col("tp") == F.col("p")) & (F.col("tp") == F.col("g"))).cast("double")).alias("exact"))
    return t.select("run_id", F.when(F.col("p") + F.col("g") > 0, 2.0 * F.col("tp") / (F.col("p") + F.col("g"))).otherwise(0.0).alias("micro_f1"), "exact")


def label_macro_f1(spark, sf_dir):
    """Macro F1 over the labels (name, alt) of each dataset."""
    pairs = pairs_with_gold(spark, sf_dir).join(predicted(spark, sf_dir).select("grammar_id", "dataset"), "grammar_id")
    both = pairs.select("dataset", F.explode(F.array_union("pred", "gold")).alias("m"), "pred", "gold").select("dataset", "m.name", "m.alt", F.array_contains("pred", F.col("m")).alias("p"), F.array_contains("gold", F.col("m")).alias("g"))
    per = both.groupBy("dataset", "name", "alt").agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if("p").alias("p"), F.count_if("g").alias("g"))
    return per.groupBy("dataset").agg(F.avg(2.0 * F.col("tp") / (F.col("p") + F.col("g"))).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


E_RULES = "WITH e AS " + one_per("examples", "example_id") + "," + rules_sql("e", "example_id")
TERM_RE = r"\b(" + "|".join(TERMINALS) + r")\b"
MENTIONS = f"""regexp_matches(regexp_replace(alt, '"[^"]*"', '', 'g'), '{TERM_RE}')"""
PAIRED = (
    "WITH p AS " + one_per("predicted_grammars", "grammar_id") + ", " + rules_sql("p", "grammar_id").replace("lines AS", "p_lines AS").replace("FROM lines", "FROM p_lines").replace("ruled AS", "p_ruled AS").replace("FROM ruled", "FROM p_ruled").replace("latest AS", "p_latest AS").replace("FROM latest", "FROM p_latest").replace("alts AS", "p_alts AS").replace("FROM alts", "FROM p_alts").replace("members AS", "p_members AS")
    + ", e AS " + one_per("examples", "example_id") + "," + rules_sql("e", "example_id")
    + """, pairs AS (SELECT grammar_id, run_id, p.dataset, p.example_id FROM p JOIN e USING (example_id) WHERE p.minimal_grammar IS NOT NULL),
pm AS (SELECT grammar_id, name, alt FROM pairs JOIN p_members ON id = grammar_id), gm AS (SELECT grammar_id, name, alt FROM pairs JOIN members ON id = example_id),
u AS (SELECT grammar_id, name, alt, bool_or(p) AS p, bool_or(g) AS g FROM (SELECT *, true AS p, false AS g FROM pm UNION ALL SELECT *, false, true FROM gm) GROUP BY ALL),
d AS (SELECT grammar_id, any_value(run_id) AS run_id, any_value(dataset) AS dataset, count(*) FILTER (p AND NOT g)::INT AS added, count(*) FILTER (g AND NOT p)::INT AS missing, count(*) FILTER (p AND g)::INT AS tp, count(*) FILTER (p)::INT AS np, count(*) FILTER (g)::INT AS ng FROM pairs LEFT JOIN u USING (grammar_id) GROUP BY grammar_id),
k AS (SELECT *, added <= 1 AND missing <= 1 AS relaxed, CASE WHEN added = 0 AND missing = 0 THEN 'exact' WHEN missing = 0 THEN 'only_added' WHEN added = 0 THEN 'only_missing' ELSE 'both' END AS kind FROM d)
"""
)
HEALTH = (
    "WITH p AS " + one_per("predicted_grammars", "grammar_id") + "," + rules_sql("p", "grammar_id")
    + r""", refs AS (SELECT DISTINCT id, r FROM (SELECT id, unnest(regexp_split_to_array(alt, '\s+')) AS r FROM alts) WHERE regexp_full_match(r, '[a-z_][a-z0-9_]*')),
starts AS (SELECT id, arg_min(name, rule_pos) AS s FROM latest GROUP BY id),
inc AS (SELECT id, list(r ORDER BY r) AS x FROM refs WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = refs.id AND l.name = refs.r) GROUP BY id),
unr AS (SELECT l.id, list(l.name ORDER BY l.name) AS x FROM latest l JOIN starts s USING (id) WHERE l.name <> s.s AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.id = l.id AND r.r = l.name) GROUP BY l.id),
h AS (SELECT grammar_id, run_id, coalesce(inc.x, []::VARCHAR[]) AS incomplete, coalesce(unr.x, []::VARCHAR[]) AS unreachable FROM p LEFT JOIN inc ON inc.id = grammar_id LEFT JOIN unr ON unr.id = grammar_id)
"""
)
AVG = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"
QUERIES = {f.__name__: f for f in (rule_table, rendered_grammars, filtered_rules, generic_rules, grammar_diff, grammar_diff_summary, grammar_health, grammar_health_summary, alternative_pool, unused_alternatives, label_counts, label_f1, label_macro_f1)}
ORACLES = {
    "rule_table": E_RULES + "SELECT id AS example_id, (rule_pos - 1)::INT AS rule_pos, name, (alt_pos - 1)::INT AS alt_pos, alt FROM alts",
    "rendered_grammars": E_RULES + ", a AS (SELECT id, rule_pos, name, coalesce(string_agg(alt, ' | ' ORDER BY alt_pos), '') AS r FROM latest LEFT JOIN alts USING (id, name, rule_pos) GROUP BY ALL) SELECT example_id, CASE WHEN e.minimal_grammar IS NOT NULL THEN coalesce(string_agg(name || ' ::= ' || r, E'\\n' ORDER BY rule_pos), '') END AS rendered FROM e LEFT JOIN a ON id = example_id GROUP BY example_id, e.minimal_grammar",
    "filtered_rules": E_RULES + f"SELECT id AS example_id, (rule_pos - 1)::INT AS rule_pos, name, (alt_pos - 1)::INT AS alt_pos, alt FROM alts WHERE name NOT IN {SCAFFOLD} AND NOT {MENTIONS}",
    "generic_rules": E_RULES + f"SELECT id AS example_id, (rule_pos - 1)::INT AS rule_pos, name, (alt_pos - 1)::INT AS alt_pos, alt FROM alts QUALIFY bool_or({MENTIONS}) OVER (PARTITION BY id, name)",
    "grammar_diff": PAIRED + "SELECT grammar_id, added, missing, relaxed, kind FROM k",
    "grammar_diff_summary": PAIRED + f"SELECT run_id, count(*) AS n, {AVG.format("kind = 'exact'")} AS exact, {AVG.format('relaxed')} AS relaxed, {AVG.format("kind = 'only_added'")} AS only_added, {AVG.format("kind = 'only_missing'")} AS only_missing, {AVG.format("kind = 'both'")} AS both, avg(added) AS mean_added, avg(missing) AS mean_missing FROM k GROUP BY run_id",
    "grammar_health": HEALTH + "SELECT grammar_id, incomplete, unreachable FROM h",
    "grammar_health_summary": HEALTH + "SELECT run_id, CASE WHEN len(incomplete) > 0 AND len(unreachable) > 0 THEN 'both' WHEN len(incomplete) > 0 THEN 'incomplete' WHEN len(unreachable) > 0 THEN 'unreachable' ELSE 'neither' END AS kind, count(*) AS grammars FROM h GROUP BY ALL",
    "alternative_pool": E_RULES + "SELECT dataset, name, count(DISTINCT alt) AS alternatives, min(alt) AS first_alt, max(alt) AS last_alt FROM members JOIN e ON example_id = id GROUP BY ALL",
    "unused_alternatives": E_RULES + r""", n AS (SELECT dataset, split = 'train' AS train, name, array_to_string(regexp_extract_all(alt, '"(?:[^"\\]|\\.)*"|[^\s"]+'), ' ') AS alt FROM alts JOIN e ON example_id = id) SELECT dataset, name, alt FROM n GROUP BY ALL HAVING bool_or(train) AND NOT bool_or(NOT train)""",
    "label_counts": E_RULES + ", n AS (SELECT dataset, name, alt, count(*) AS positives FROM members JOIN e ON example_id = id WHERE split = 'train' GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY name, alt) - 1)::INT AS label FROM n",
    "label_f1": PAIRED + f"SELECT run_id, CASE WHEN sum(np + ng) > 0 THEN 2.0 * sum(tp) / sum(np + ng) ELSE 0.0 END AS micro_f1, {AVG.format('tp = np AND tp = ng')} AS exact FROM d GROUP BY run_id",
    "label_macro_f1": PAIRED + ", l AS (SELECT dataset, name, alt, 2.0 * count(*) FILTER (p AND g) / (count(*) FILTER (p) + count(*) FILTER (g)) AS f FROM u JOIN pairs USING (grammar_id) GROUP BY ALL) SELECT dataset, avg(f) AS macro_f1, count(*) AS labels FROM l GROUP BY dataset",
}
