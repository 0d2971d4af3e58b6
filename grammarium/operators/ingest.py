"""From sources to examples: programs are parsed and get their minimal grammars; what fails is kept with the reason.

A row fails if its query or program is empty, if its program is degenerate or if the
grammar doesn't read it. Splits follow a digest of the key. Rows with one key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, spread
from ..functions import text as T
from ..functions.parsing import Grammar, render
from ..oracle import one_per
from .rules import examples

#: The plans of one planning domain as a grammar; a fixed format.
PLANS = """plan ::= plan action | action
action ::= "(pick-up" object ")" | "(put-down" object ")" | "(stack" object object ")" | "(unstack" object object ")"
object ::= OBJECT_NAME
OBJECT_NAME ::= /[a-z][a-z0-9_]*/"""
#: Rules at which programs start, by dataset.
STARTS = {"geoquery": "query", "overnight": "list_value", "pddl_blocksworld": "plan"}


def parsed(rows: DataFrame, grammar: str | None, start: Column, skip: tuple[str, ...] = ()) -> DataFrame:
    """rows(key, program, grammar) -> (key, minimal): by one grammar for all, a bounded text, or by each row's own; null where it isn't read."""
    key = rows.columns[0]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = Grammar.read(grammar) if grammar is not None else None
        for b in batches:
            out = []
            for program, own, begin in zip(b["program"], b["grammar"], b["start"]):
                rules = (whole or Grammar.read(own or "")).minimal(program or "", begin, frozenset(skip)) if begin else None
                out.append(None if rules is None else render(rules))
            yield pd.DataFrame({key: b[key], "minimal": out})

    needed = rows.select(key, "program", "grammar", start.alias("start"))
    return spread(needed, key).mapInPandas(run, f"{key} {kind}, minimal string")


def ingest(rows: DataFrame, grammar: str, start: str, cleaned: Column | None = None, netlist: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, query, program, minimal_grammar, reason) of rows(key, query, program); reason is null for what can be taken."""
    key = rows.columns[0]
    ready = checkpointed(rows.select(key, "query", (cleaned if cleaned is not None else F.col("program")).alias("program")))
    why = T.rejection(F.col("query"), F.col("program"), F.lit(netlist))
    found = parsed(ready.select(key, "program", F.lit(None).cast("string").alias("grammar")), grammar, F.lit(start), skip)
    both = ready.join(found, key)
    reason = F.coalesce(why, F.when(F.col("minimal").isNull(), "not readable"))
    return both.select(key, "query", "program", F.when(reason.isNull(), F.col("minimal")).alias("minimal_grammar"), reason.alias("reason"))


def write_corpus(rows: DataFrame, folder: str) -> tuple[int, int]:
    """Writes what was taken and what failed, programs cut to 500 characters, to two folders; gives (taken, all)."""
    kept = checkpointed(rows)
    kept.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{folder}/rows")
    kept.filter("reason is not null").withColumn("program", F.substring("program", 1, 500)).write.mode("overwrite").parquet(f"{folder}/failures")
    n = kept.agg(F.count_if(F.col("reason").isNull()), F.count(F.lit(1))).first()
    return n[0], n[1]


def plans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).filter("dataset = 'pddl_blocksworld'").select("example_id", "query", "program")
    return ingest(rows, PLANS, "plan")


def ingested_plans(spark, sf_dir):
    """Planning examples as they would be ingested: why a row fails, or the number of rules and alternatives that its plan needs."""
    rows = plans_of(spark, sf_dir)
    lines = F.split("minimal_grammar", "\n")
    alternatives = F.aggregate(lines, F.lit(0), lambda n, x: n + F.size(F.split(x, r" \| ")))
    return rows.select("example_id", "reason", F.coalesce(alternatives, F.lit(0)).alias("alternatives"))


def plan_rules(spark, sf_dir):
    """The rules of each readable plan, one alternative a row."""
    rows = plans_of(spark, sf_dir).filter("reason is null").select("example_id", F.explode(F.split("minimal_grammar", "\n")).alias("line"))
    named = rows.select("example_id", F.substring_index("line", " ::= ", 1).alias("name"), F.substring_index("line", " ::= ", -1).alias("rhs"))
    return named.select("example_id", "name", F.explode(F.split("rhs", r" \| ")).alias("alt"))


def reparsed_grammars(spark, sf_dir):
    """Programs read by their own stored grammars: whether they are, and the minimal grammar found anew."""
    rows = examples(spark, sf_dir).filter(F.col("dataset").isin(*STARTS) & F.col("program").isNotNull() & F.col("minimal_grammar").isNotNull())
    starts = F.coalesce(*[F.when(F.col("dataset") == d, F.lit(s)) for d, s in STARTS.items()])
    found = parsed(rows.select("example_id", "program", F.col("minimal_grammar").alias("grammar"), "dataset"), None, starts)
    return found.select("example_id", F.col("minimal").isNotNull().alias("valid"), "minimal")


LINE = r"^\((pick-up|put-down) [a-z][a-z0-9_]*\)$|^\((stack|unstack) [a-z][a-z0-9_]* [a-z][a-z0-9_]*\)$"
PLAN_SQL = "WITH e AS " + one_per("examples", "example_id") + rf""", p AS (SELECT example_id, CASE WHEN trim(coalesce(query, ''), E' \n\t\r') = '' THEN 'empty query' WHEN trim(coalesce(program, ''), E' \n\t\r') = '' THEN 'empty program' END AS why,
 list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(program, ''), '\s*\)', ')', 'g'), '\n|(?:\)\s*)'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS steps FROM e WHERE dataset = 'pddl_blocksworld'),
s AS (SELECT example_id, why, list_transform(steps, lambda x: regexp_replace(x, '\s+', ' ', 'g') || ')') AS steps, (SELECT 1) AS one FROM p),
r AS (SELECT example_id, steps, coalesce(why, CASE WHEN len(steps) = 0 OR len(list_filter(steps, lambda x: NOT regexp_matches(x, '{LINE}'))) > 0 THEN 'not readable' END) AS reason FROM s),
m AS (SELECT example_id, 'plan' AS name, 'action' AS alt FROM r WHERE reason IS NULL UNION ALL SELECT example_id, 'plan', 'plan action' FROM r WHERE reason IS NULL AND len(steps) > 1
 UNION ALL SELECT DISTINCT example_id, 'action', CASE regexp_extract(x, '^\(([a-z-]+)', 1) WHEN 'pick-up' THEN '"(pick-up" object ")"' WHEN 'put-down' THEN '"(put-down" object ")"' WHEN 'stack' THEN '"(stack" object object ")"' ELSE '"(unstack" object object ")"' END FROM (SELECT example_id, unnest(steps) AS x FROM r WHERE reason IS NULL)
 UNION ALL SELECT example_id, 'object', 'OBJECT_NAME' FROM r WHERE reason IS NULL UNION ALL SELECT DISTINCT example_id, 'OBJECT_NAME', '"' || unnest(regexp_extract_all(x[2:], '[ ]([a-z][a-z0-9_]*)', 1)) || '"' FROM (SELECT example_id, unnest(steps) AS x FROM r WHERE reason IS NULL))
"""
QUERIES = {f.__name__: f for f in (ingested_plans, plan_rules, reparsed_grammars)}
ORACLES = {
    "plan_rules": PLAN_SQL + "SELECT * FROM m",
    "ingested_plans": PLAN_SQL + "SELECT example_id, reason, (SELECT count(*) FROM m WHERE m.example_id = r.example_id)::INT AS alternatives FROM r",
}
