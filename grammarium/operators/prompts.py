"""Prompts over the tables, rendered as text so that they can be compared.

Demonstrations are the first train rows of a dataset or a row's neighbours. Null texts
read as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import grammar_alternatives, small_or_shuffled
from ..functions import prompts as M
from ..functions import text as T
from ..oracle import one_per, rules_sql
from .retrieval import N_SQL, neighbour_examples
from .rules import MENTIONS, PAIRED, TERMINALS, examples, pairs_with_gold
from .sampling import DEMOS, first_demonstrations
from .scoring import predictions

#: (name, task, with_grammar) of the supervised rows that are made.
SUPERVISED = (("program", "program", True), ("plain", "program", False), ("grammar", "grammar", True), ("grammar_program", "grammar_program", True))
FIRST_MODES = ("zero_shot", "baseline", "grammar_first")
SHOWN = ("query", "module_header", "minimal_grammar", "program")


def supervised_rows(spark, sf_dir):
    """Prompt and completion of each train row for each task."""
    e = examples(spark, sf_dir).filter("split = 'train'")
    col = lambda n: F.col(n)
    rows = [F.struct(F.lit(name).alias("task"), M.rendered(M.task_messages(col("query"), col("minimal_grammar"), col("module_header"), task, g)).alias("prompt"), M.completion(col("minimal_grammar"), col("program"), F.lit(None).cast("string"), task).alias("completion")) for name, task, g in SUPERVISED]
    return e.select("example_id", F.explode(F.array(*rows)).alias("r")).select("example_id", "r.*")


def demonstrated_prompts(spark, sf_dir):
    """Prompts of valid and test rows in the modes that take the first train rows of the dataset, the same for all."""
    e = examples(spark, sf_dir)
    first = first_demonstrations(spark, sf_dir).join(e.select("example_id", *SHOWN), "example_id")
    demo = F.struct("k", *SHOWN, F.lit(None).cast("string").alias("grammar_cot"))
    demos = first.groupBy("dataset").agg(F.array_sort(F.collect_list(demo)).alias("demos"))  # DEMOS for each dataset
    rows = e.filter("split <> 'train'").join(small_or_shuffled(demos), "dataset")
    made = [F.struct(F.lit(m).alias("mode"), M.rendered(M.mode_messages(F.col("query"), F.col("module_header"), F.lit(None), F.col("demos"), M.MODES[m])).alias("prompt")) for m in FIRST_MODES]
    return rows.select("example_id", F.explode(F.array(*made)).alias("p")).select("example_id", "p.*")


def shown_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_id, demos): the neighbours of a row, best first."""
    e = examples(spark, sf_dir).select("example_id", *SHOWN, F.lit(None).cast("string").alias("grammar_cot"))
    n = neighbour_examples(spark, sf_dir).join(e, "example_id")
    return n.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("rank", *SHOWN, "grammar_cot"))).alias("demos"))


def retrieval_prompts(spark, sf_dir):
    """Prompts with numbered neighbours, and as a conversation, for the rows that ask."""
    asks = examples(spark, sf_dir).select(F.col("example_id").alias("test_id"), "query", "module_header")
    rows = shown_neighbours(spark, sf_dir).join(asks, "test_id")
    talk = M.mode_messages(F.col("query"), F.col("module_header"), F.lit(None), F.col("demos"), M.MODES["grammar_knn"])
    return rows.select("test_id", M.retrieved_user(F.col("query"), F.col("demos")).alias("user_text"), M.rendered(talk).alias("conversation"))


def explain_prompts(spark, sf_dir):
    """Prompts that ask for the reasoning behind the grammar of each train row, and the composed answer that its rows would get from an empty one."""
    e = examples(spark, sf_dir).filter("split = 'train'")
    asks = M.explain_messages(F.col("query"), F.col("module_header"), F.col("program"), F.col("minimal_grammar"))
    return e.select("example_id", M.rendered(asks).alias("prompt"), M.reasoning_with_grammar(F.lit(""), F.col("minimal_grammar")).alias("composed"))


def own_grammar_prompts(spark, sf_dir):
    """Prompts of answers that show the grammar predicted with reasoning, without demonstrations."""
    rows = predictions(spark, sf_dir).filter("mode = 'rag_cot_with_grammar'")
    none = F.array().cast("array<struct<query:string,module_header:string,minimal_grammar:string,grammar_cot:string,program:string>>")
    talk = M.mode_messages(F.col("query"), F.lit(None).cast("string"), F.col("grammar_cot"), none, M.MODES["rag_cot_with_grammar"])
    return rows.select("pred_id", M.rendered(talk).alias("prompt"))


def specialized_grammars(spark, sf_dir):
    """Grammars of examples whose generic rules are replaced by the predicted ones of the same name; rules that only the prediction has are left out. Lines by name."""
    pairs = pairs_with_gold(spark, sf_dir)
    alts = lambda side, name: F.array_sort(F.transform(F.filter(side, lambda m: m["name"] == name), lambda m: m["alt"]))
    names = F.array_sort(F.array_distinct(F.transform("gold", lambda m: m["name"])))
    generic = lambda a: F.exists(a, lambda x: T.mentions_terminal(x, list(TERMINALS)))

    def line(name):
        gold, own = alts(F.col("gold"), name), alts(F.col("pred"), name)
        kept = F.when(generic(gold) & (F.size(own) > 0), own).otherwise(gold)
        return F.concat(name, F.lit(" ::= "), F.array_join(kept, " | "))

    return pairs.select("grammar_id", F.array_join(F.transform(names, line), "\n").alias("grammar"))


def specialize_prompts(spark, sf_dir):
    """Prompts that ask to specialise a grammar, for valid and test rows with a generic rule."""
    e = examples(spark, sf_dir).filter("split <> 'train'").withColumn("a", F.coalesce(grammar_alternatives(F.col("minimal_grammar")), F.array().cast("array<struct<name:string,alt:string>>")))
    rows = e.filter(F.exists("a", lambda m: T.mentions_terminal(m["alt"], list(TERMINALS))))
    user = F.concat(M.asked(F.col("query")), F.lit("\n\nGrammar:\n"), M.text(F.col("minimal_grammar")))
    return rows.select("example_id", M.rendered(F.array(M.message("system", F.lit(M.SYSTEM["specialize"])), M.message("user", user))).alias("prompt"))


E = "WITH e AS " + one_per("examples", "example_id")
ASKED = "'Query: ' || coalesce({0}query, '') || CASE WHEN coalesce({0}module_header, '') <> '' THEN E'\\n\\nModule header:\\n' || {0}module_header ELSE '' END"
BLOCK = "E'<grammar>\\n' || coalesce({}, '') || E'\\n</grammar>'"


def _task_sql(name: str, task: str, with_grammar: bool) -> str:
    own = task != "program"
    system = M.SYSTEM[task if own else "with_grammar" if with_grammar else "plain"]
    grammar = " || E'\\n\\nGrammar:\\n' || coalesce(minimal_grammar, '')" if with_grammar and not own else ""
    done = {"grammar_program": "coalesce(minimal_grammar, '') || E'\\n\\nProgram:\\n' || coalesce(program, '')", "grammar": "minimal_grammar"}.get(task, "program")
    return f"SELECT example_id, '{name}' AS task, E'[system]\\n{system}\\n[user]\\n' || {ASKED.format('')}{grammar} AS prompt, {done} AS completion FROM e WHERE split = 'train'"


def _mode_sql(mode: str) -> str:
    m = M.MODES[mode]
    answer = (BLOCK.format("d.minimal_grammar") + " || E'\\n\\nProgram:\\n' || " if m.demo_grammar else "") + "coalesce(d.program, '')"
    demos = "''" if m.selection == "none" else f"(SELECT string_agg(E'\\n[user]\\n' || {ASKED.format('d.')} || E'\\n[assistant]\\n' || {answer}, '' ORDER BY k) FROM d WHERE d.dataset = e.dataset)"
    return f"SELECT example_id, '{mode}' AS mode, E'[system]\\n{m.system}' || {demos} || E'\\n[user]\\n' || {ASKED.format('e.')} AS prompt FROM e WHERE split <> 'train' AND dataset IN (SELECT dataset FROM d)"


QUERIES = {f.__name__: f for f in (supervised_rows, demonstrated_prompts, retrieval_prompts, explain_prompts, own_grammar_prompts, specialized_grammars, specialize_prompts)}
FIRST_SQL = E + f", d AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos, example_id) AS k FROM e WHERE split = 'train' QUALIFY k <= {DEMOS}) "
KNN = M.MODES["grammar_knn"]
ORACLES = {
    "supervised_rows": E + " " + " UNION ALL ".join(_task_sql(*s) for s in SUPERVISED),
    "demonstrated_prompts": FIRST_SQL + " UNION ALL ".join(map(_mode_sql, FIRST_MODES)),
    "retrieval_prompts": N_SQL + f""", t AS (SELECT n.test_id, string_agg('--- Example ' || rank || E' ---\\nQuery: ' || coalesce(d.query, '') || E'\\nGrammar:\\n' || coalesce(d.minimal_grammar, '') || E'\\nProgram:\\n' || coalesce(d.program, '') || E'\\n', E'\\n' ORDER BY rank) AS u,
string_agg(E'\\n[user]\\n' || {ASKED.format('d.')} || E'\\n[assistant]\\n' || {BLOCK.format('d.minimal_grammar')} || E'\\n\\nProgram:\\n' || coalesce(d.program, ''), '' ORDER BY rank) AS c FROM n JOIN e d ON d.example_id = n.example_id GROUP BY n.test_id)
SELECT test_id, E'Similar examples:\\n\\n' || u || E'\\n--- Your Task ---\\nQuery: ' || coalesce(e.query, '') AS user_text, E'[system]\\n{KNN.system}' || c || E'\\n[user]\\n' || {ASKED.format('e.')} AS conversation FROM t JOIN e ON e.example_id = test_id""",
    "explain_prompts": E + f" SELECT example_id, E'[system]\\n{M.SYSTEM['explain']}\\n[user]\\n' || {ASKED.format('')} || E'\\n\\nGold program:\\n' || coalesce(program, '') || E'\\n\\nMinimal grammar:\\n' || coalesce(minimal_grammar, '') AS prompt, E'\\n\\n' || {BLOCK.format('minimal_grammar')} AS composed FROM e WHERE split = 'train'",
    "own_grammar_prompts": "WITH p AS " + one_per("predictions", "pred_id") + f" SELECT pred_id, E'[system]\\n{M.MODES['rag_cot_with_grammar'].system}\\n[user]\\nQuery: ' || coalesce(query, '') || E'\\n\\nPredicted grammar:\\n' || coalesce(grammar_cot, '') AS prompt FROM p WHERE mode = 'rag_cot_with_grammar'",
    "specialized_grammars": PAIRED + f""", gr AS (SELECT m.id, name, list(m.alt ORDER BY m.alt) AS a, bool_or({MENTIONS}) AS g FROM members m GROUP BY m.id, name), pr AS (SELECT grammar_id, name, list(alt ORDER BY alt) AS a FROM pm GROUP BY ALL),
l AS (SELECT pairs.grammar_id, gr.name, gr.name || ' ::= ' || array_to_string(CASE WHEN gr.g AND pr.a IS NOT NULL THEN pr.a ELSE gr.a END, ' | ') AS line FROM pairs JOIN gr ON gr.id = pairs.example_id LEFT JOIN pr ON pr.grammar_id = pairs.grammar_id AND pr.name = gr.name)
SELECT pairs.grammar_id, coalesce((SELECT string_agg(line, E'\\n' ORDER BY name) FROM l WHERE l.grammar_id = pairs.grammar_id), '') AS grammar FROM pairs""",
    "specialize_prompts": E + "," + rules_sql("e", "example_id") + f" SELECT example_id, E'[system]\\n{M.SYSTEM['specialize']}\\n[user]\\nQuery: ' || coalesce(query, '') || E'\\n\\nGrammar:\\n' || coalesce(minimal_grammar, '') AS prompt FROM e WHERE split <> 'train' AND EXISTS (SELECT 1 FROM alts WHERE id = example_id AND {MENTIONS})",
}
