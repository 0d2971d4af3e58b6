"""Text functions over whole tables: cleaned, cut and tokenised programs, answers and alternatives.

Null texts give null, or no row where a query makes rows of parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import grammar_alternatives, table, unique
from ..functions import text as T
from ..oracle import one_per, rules_sql
from .rules import examples
from .scoring import predictions


def answers(spark, sf_dir, *datasets):
    rows = predictions(spark, sf_dir).filter("prediction is not null")
    return rows.filter(F.col("dataset").isin(*datasets)) if datasets else rows


def plain_alternatives(spark, sf_dir):
    """Each alternative of the examples in plain form."""
    e = examples(spark, sf_dir).select(F.explode(grammar_alternatives(F.col("minimal_grammar"))).alias("m")).select("m.alt").distinct()
    return e.select("alt", T.plain_alternative(F.col("alt")).alias("plain"))


def comment_parts(spark, sf_dir):
    """Leading comment lines of each document, and the rest."""
    d = unique(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").filter("text is not null")
    return d.select("doc_id", T.comment_and_rest(F.col("text")).alias("p")).select("doc_id", "p.*")


def module_headers(spark, sf_dir):
    e = examples(spark, sf_dir).filter("dataset = 'mg_verilog'")
    return e.select("example_id", T.module_header([F.col("module_header")], F.col("program")).alias("header"))


def program_texts(spark, sf_dir):
    """Programs as they are parsed: with their module header ahead where there is one."""
    text = F.when(F.coalesce("module_header", F.lit("")) != "", F.concat_ws("\n", "module_header", "program")).otherwise(F.col("program"))
    return examples(spark, sf_dir).filter("program is not null").select("example_id", text.alias("text"))


def rejections(spark, sf_dir):
    """Rows that can't be taken into a corpus, with the reason."""
    why = T.rejection(F.col("query"), F.col("program"), F.col("dataset") == "spice")
    return examples(spark, sf_dir).select("example_id", "dataset", why.alias("reason")).filter("reason is not null")


def netlist_graph(spark, sf_dir):
    """Components of the wanted netlists and the nets they join, each once."""
    rows = predictions(spark, sf_dir).filter("dataset = 'spice' and gold is not null")
    return rows.select("pred_id", F.explode(T.netlist_edges(T.strip(F.col("gold")))).alias("e")).select("pred_id", "e.*")


def clean_netlists(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("dataset = 'spice' and prediction is not null")
    return rows.select("pred_id", T.clean_netlist(F.col("prediction")).alias("netlist"))


def fenced_code(spark, sf_dir):
    """The first fenced block of each answer or all of it, and the last block or null."""
    return answers(spark, sf_dir).select("pred_id", T.fenced(F.col("prediction")).alias("first"), T.last_fenced(F.col("prediction")).alias("last"))


def grammars_of_outputs(spark, sf_dir):
    """What stands in the first grammar block of each answer, or all of it."""
    return answers(spark, sf_dir).select("pred_id", T.grammar_of_output(F.col("prediction")).alias("grammar"))


def molecule_words(spark, sf_dir):
    """Molecules of answers, their first line, as tokens parted by blanks."""
    return answers(spark, sf_dir, "smiles").select("pred_id", F.array_join(T.molecule_tokens(T.first_line(F.col("prediction"))), " ").alias("tokens"))


def call_words(spark, sf_dir):
    """Programs of the two functional languages, as tokens of either kind."""
    rows = predictions(spark, sf_dir).filter("dataset in ('geoquery', 'overnight') and gold is not null")
    return rows.select("pred_id", F.array_join(T.call_tokens(F.col("gold")), " ").alias("calls"), F.array_join(T.list_tokens(F.col("gold")), " ").alias("items"))


def compact_programs(spark, sf_dir):
    rows = examples(spark, sf_dir).filter("dataset = 'geoquery' and program is not null")
    return rows.select("example_id", T.compact_constants(F.col("program")).alias("program"))


def task_names(spark, sf_dir):
    runs = unique(table(spark, sf_dir, "batch_runs").select("run_id", "task_name", "model"), "run_id")
    return runs.select("run_id", T.task_name(F.concat_ws("/", "model", "task_name")).alias("name"))


def request_ids(spark, sf_dir):
    """Ids of requests by the place of the example."""
    return examples(spark, sf_dir).filter("pos is not null").select("example_id", F.concat(F.lit("req-"), F.col("pos").cast("string")).alias("request_id"))


def nested_metrics(spark, sf_dir):
    """A number inside a JSON text by its path, per type of event; null counts as 0."""
    value = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


WHITE = r"[\s\x1c-\x1f\x{85}\x{a0}]"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{WHITE}+|{WHITE}+$', '', 'g')"


P = "WITH p AS " + one_per("predictions", "pred_id")
E = "WITH e AS " + one_per("examples", "example_id")
PLAIN = r"""regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(alt, '"[^"]*"|\w+'), lambda t: replace(t, '"', '')), ' '), '(\W)\s+(\W)', '\1\2', 'g'), '(\W)\s+(\W)', '\1\2', 'g')"""
QUERIES = {
    f.__name__: f
    for f in (
        plain_alternatives, comment_parts, module_headers, program_texts, rejections, netlist_graph, clean_netlists, fenced_code, grammars_of_outputs, molecule_words, call_words, compact_programs,
        task_names, request_ids, nested_metrics,
    )
}
FIRST = "coalesce(list_filter(list_transform(string_split(prediction, E'\\n'), lambda x: " + _strip("x") + "), lambda x: x <> '')[1], '')"
FENCE = r"(?s)```[A-Za-z]*[ \t]*\n(.*?)```"
ORACLES = {
    "plain_alternatives": E + "," + rules_sql("e", "example_id") + f" SELECT DISTINCT alt, {PLAIN} AS plain FROM alts",
    "comment_parts": "WITH d AS " + one_per("documents", "doc_id") + ", l AS (SELECT doc_id, string_split(text, E'\\n') AS x FROM d WHERE text IS NOT NULL), n AS (SELECT doc_id, x, coalesce(list_position(list_transform(x, lambda y: NOT starts_with(" + _strip("y") + ", '//')), true), len(x) + 1) - 1 AS n FROM l) SELECT doc_id, " + _strip("array_to_string(list_transform(x[1:n], lambda y: " + _strip("regexp_replace(y, '^[/ ]+', '')") + "), ' ')") + " AS description, " + _strip("array_to_string(x[n + 1:], E'\\n')") + " AS rest FROM n",
    "module_headers": E + " SELECT example_id, coalesce(nullif(module_header, ''), CASE WHEN starts_with(" + _strip("program") + ", 'module') THEN split_part(" + _strip("program") + ", ';', 1) || ';' END, '') AS header FROM e WHERE dataset = 'mg_verilog'",
    "program_texts": E + " SELECT example_id, CASE WHEN coalesce(module_header, '') <> '' THEN module_header || E'\\n' || program ELSE program END AS text FROM e WHERE program IS NOT NULL",
    "rejections": E + ", r AS (SELECT example_id, dataset, CASE WHEN coalesce(" + _strip("query") + ", '') = '' THEN 'empty query' WHEN coalesce(" + _strip("program") + ", '') = '' THEN 'empty program' WHEN dataset = 'spice' AND len(list_filter(string_split(program, E'\\n'), lambda x: " + _strip("x") + " <> '' AND lower(" + _strip("x") + ") <> '.end')) <= 1 THEN 'degenerate program' END AS reason FROM e) SELECT * FROM r WHERE reason IS NOT NULL",
    "netlist_graph": P + ", l AS (SELECT pred_id, string_split_regex(" + _strip("line") + r""", '\s+') AS f FROM (SELECT pred_id, unnest(string_split(""" + _strip("gold") + r""", E'\n')) AS line FROM p WHERE dataset = 'spice' AND gold IS NOT NULL)),
c AS (SELECT pred_id, f, upper(f[1][1:1]) AS kind, f[2:] AS r FROM l WHERE f[1] <> '' AND contains('""" + T.COMPONENTS + """', upper(f[1][1:1]))),
b AS (SELECT *, r[1:coalesce(list_position(list_transform(r, lambda x: contains(x, '=')), true), len(r) + 1) - 1] AS before FROM c),
n AS (SELECT pred_id, lower(f[1]) AS component, kind, unnest(CASE WHEN kind = 'X' THEN CASE WHEN len(before) > 1 THEN before[1:len(before) - 1] ELSE before END ELSE r[1:CASE kind """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.NETS.items()) + " ELSE 2 END] END) AS net FROM b) SELECT DISTINCT pred_id, component, kind, lower(net) AS net FROM n",
    "fenced_code": P + " SELECT pred_id, " + _strip(f"CASE WHEN regexp_matches(prediction, '{FENCE}') THEN regexp_extract(prediction, '{FENCE}', 1) ELSE prediction END") + f" AS first, regexp_extract_all(prediction, '{FENCE}', 1)[-1] AS last FROM p WHERE prediction IS NOT NULL",
    "grammars_of_outputs": P + " SELECT pred_id, " + _strip("CASE WHEN regexp_matches(prediction, '(?s)<grammar>(.*?)</grammar>') THEN regexp_extract(prediction, '(?s)<grammar>(.*?)</grammar>', 1) ELSE prediction END") + " AS grammar FROM p WHERE prediction IS NOT NULL",
    "molecule_words": P + r" SELECT pred_id, array_to_string(regexp_extract_all(" + FIRST + r", 'Br|Cl|%\d{2}|@@|[A-Z][a-z]?|[a-z]|[^A-Za-z]'), ' ') AS tokens FROM p WHERE dataset = 'smiles' AND prediction IS NOT NULL",
    "call_words": P + r" SELECT pred_id, array_to_string(list_filter(string_split_regex(regexp_replace(gold, '([(),])', ' \1 ', 'g'), '\s+'), lambda x: x <> ''), ' ') AS calls, array_to_string(regexp_extract_all(gold, '[a-zA-Z0-9_.]+|[^\s]'), ' ') AS items FROM p WHERE dataset IN ('geoquery', 'overnight') AND gold IS NOT NULL",
    "compact_programs": E + r" SELECT example_id, replace(replace(regexp_replace(regexp_replace(program, ''' (\w+) (\w+) ''', '''\1#\2''', 'g'), ''' (\w+) (\w+) (\w+) ''', '''\1#\2#\3''', 'g'), ' ', ''), '#', ' ') AS program FROM e WHERE dataset = 'geoquery' AND program IS NOT NULL",
    "task_names": "SELECT run_id, translate(concat_ws('/', model, task_name), '/.', '__') AS name FROM " + one_per("batch_runs", "run_id"),
    "request_ids": E + " SELECT example_id, 'req-' || pos AS request_id FROM e WHERE pos IS NOT NULL",
    "nested_metrics": "SELECT event_type, count(*) AS n, avg(coalesce(json_extract_string(props, '$.k')::DOUBLE, 0.0)) AS mean FROM events GROUP BY event_type",
}
