"""Rules as labels: an index, grammars as arrays of labels and back, and corrupted grammars.

Labels are the train rules of a dataset, numbered densely by name and alternative;
unknown alternatives have none. Null grammars give empty arrays and texts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import small_or_shuffled, spread
from ..functions.parsing import Grammar, render
from ..oracle import one_per, rules_sql
from .ingest import PLANS
from .rules import examples, label_counts, members

#: Rules that are never taken from a grammar, and changes to each one; fixed values.
PROTECTED, CHANGES, SEED = ("string", "number"), 2, 42


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(spark, sf_dir).select("dataset", "name", "alt", "label")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, name, alt, label) of the members that are labels."""
    m = members(examples(spark, sf_dir).select(F.struct("example_id", "dataset").alias("k"), "minimal_grammar"), "k")
    rows = m.select("k.example_id", F.col("k.dataset").alias("dataset"), "name", "alt")
    return rows.join(small_or_shuffled(label_index(spark, sf_dir)), ["dataset", "name", "alt"])


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, labels): the sorted labels of each example's grammar."""
    found = label_rows(spark, sf_dir).groupBy("example_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    none = F.array().cast("array<int>")
    return examples(spark, sf_dir).select("example_id").join(found, "example_id", "left").select("example_id", F.coalesce("labels", none).alias("labels"))


def encoded_labels(spark, sf_dir):
    """The same with the labels as a text."""
    return coded(spark, sf_dir).select("example_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def decoded_labels(spark, sf_dir):
    """Grammars made anew from the labels of valid and test rows, rules and alternatives in the order of the labels."""
    rows = coded(spark, sf_dir).join(examples(spark, sf_dir).filter("split <> 'train'").select("example_id", "dataset"), "example_id")
    rows = rows.select("example_id", "dataset", F.explode("labels").alias("label")).join(small_or_shuffled(label_index(spark, sf_dir)), ["dataset", "label"])
    lines = rows.groupBy("example_id", "name").agg(F.array_sort(F.collect_list(F.struct("label", "alt"))).alias("a"))
    line = F.concat("name", F.lit(" ::= "), F.array_join(F.transform("a", lambda x: x["alt"]), " | "))
    texts = lines.select("example_id", F.struct("name", line.alias("line")).alias("l")).groupBy("example_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("grammar"))
    return texts


def corrupt(rules: dict[str, list[str]], full: dict[str, list[str]], kinds: list[str], rng: random.Random) -> list[str]:
    """Changes `rules` in place by operations in their order, none of them to a rule that was touched; gives those that could be made. ``add`` takes an alternative of the full grammar that isn't there, ``remove`` takes one away, and the rule with its last."""
    touched: set[str] = set()
    made = []
    for kind in kinds:
        if kind == "add":
            options = [(n, a) for n, alts in full.items() if n not in touched for a in alts if a not in rules.get(n, [])]
        else:
            options = [(n, a) for n, alts in rules.items() if n not in touched and n not in PROTECTED for a in alts]
        if not options:
            continue
        name, alt = rng.choice(options)
        touched.add(name)
        if kind == "add":
            rules.setdefault(name, []).append(alt)
        else:
            rules[name].remove(alt)
            if not rules[name]:
                del rules[name]
        made.append(kind)
    return made


def operations(low: int, high: int, rng: random.Random, kinds: tuple[str, ...] = ("add", "remove")) -> list[str]:
    """A number of operations from `low` up to but without `high`, or just `low` where both are equal, drawn and sorted."""
    if low < 0 or high < low:
        raise ValueError("a range of operations must rise from 0 or more")
    n = low if low == high else rng.randrange(low, high)
    return sorted(rng.choice(kinds) for _ in range(n))


def corrupted(rows: DataFrame, full: str, low: int = CHANGES, high: int = CHANGES, seed: int = SEED) -> DataFrame:
    """(key, grammar, added, removed) of rows(key, minimal_grammar); each row draws by the seed and its key."""
    key = rows.columns[0]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = plain_rules(full)
        for b in batches:
            out = []
            for k, text in zip(b[key], b["minimal_grammar"]):
                rng = random.Random(f"{seed}-{k}")
                rules = plain_rules(text or "")
                made = corrupt(rules, known, operations(low, high, rng), rng)
                out.append((k, render(rules), made.count("add"), made.count("remove")))
            yield pd.DataFrame(out, columns=[key, "grammar", "added", "removed"])

    return spread(rows, key).mapInPandas(run, f"{key} {kind}, grammar string, added int, removed int")


def plain_rules(text: str) -> dict[str, list[str]]:
    """Rules with their alternatives as written; of several lines with one name the last counts."""
    g = Grammar.read(text)
    rules = {n: [a for a, _ in alts] for n, alts in g.rules.items()}
    return rules | {n: [f'"{w}"' for known in by.values() for w in sorted(known)] for n, by in g.words.items()}


def corrupted_grammars(spark, sf_dir):
    """Grammars of planning examples with CHANGES random changes each."""
    rows = examples(spark, sf_dir).filter("dataset = 'pddl_blocksworld' and minimal_grammar is not null").select("example_id", "minimal_grammar")
    return corrupted(rows, PLANS)


def corruption_counts(spark, sf_dir):
    """How often each operation was made, and in how many rows."""
    rows = corrupted_grammars(spark, sf_dir)
    each = F.explode(F.array(F.struct(F.lit("add").alias("op"), F.col("added").alias("n")), F.struct(F.lit("remove").alias("op"), F.col("removed").alias("n"))))
    return rows.select(each.alias("x")).groupBy("x.op").agg(F.sum("x.n").alias("applied"), F.count_if(F.col("x.n") > 0).alias("in_rows"))


E = "WITH e AS " + one_per("examples", "example_id") + "," + rules_sql("e", "example_id")
INDEX = ", li AS (SELECT dataset, name, alt, (row_number() OVER (PARTITION BY dataset ORDER BY name, alt) - 1)::INT AS label FROM (SELECT DISTINCT dataset, name, alt FROM members JOIN e ON example_id = id WHERE split = 'train')), lr AS (SELECT example_id, split, name, alt, label FROM members JOIN e ON example_id = id JOIN li USING (dataset, name, alt))"
QUERIES = {f.__name__: f for f in (encoded_labels, decoded_labels, corrupted_grammars, corruption_counts)}
ORACLES = {
    "encoded_labels": E + INDEX + " SELECT example_id, coalesce((SELECT string_agg(label::VARCHAR, ',' ORDER BY label) FROM lr WHERE lr.example_id = e.example_id), '') AS labels FROM e",
    "decoded_labels": E + INDEX + ", l AS (SELECT example_id, name, name || ' ::= ' || string_agg(alt, ' | ' ORDER BY label) AS line FROM lr WHERE split <> 'train' GROUP BY example_id, name) SELECT example_id, string_agg(line, E'\\n' ORDER BY name) AS grammar FROM l GROUP BY example_id",
}
