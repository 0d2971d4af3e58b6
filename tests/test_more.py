"""Parser, planner, text functions, prompts, query languages, sources and label operators on small cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from grammarium.functions import planner, prompts
from grammarium.functions import text as T
from grammarium.functions.parsing import Grammar, flat_lists, list_rules, render
from grammarium.operators import dataflow, ingest, labels, sampling
from grammarium.plans import funql, lambda_dcs
from grammarium.plans.terms import Unreadable, bracketed, function_term
from grammarium.plans.worlds import World
from grammarium.sources import files


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], kinds).select(column.alias("v")).first()["v"]


CALC = 'e ::= e "+" t | t\nt ::= "(" e ")" | NUM\nNUM ::= /[0-9]+/'


def test_parser_minimal_grammar():
    g = Grammar.read(CALC)
    assert g.minimal("(1 + 22)+1", "e") == {"e": ['e "+" t', "t"], "t": ['"(" e ")"', "NUM"], "NUM": ['"1"', '"22"']}
    assert g.parse("1+", "e") is None and g.parse("", "e") is None and g.minimal("7", "none") is None
    assert g.minimal("7", "e", frozenset({"e"})) == {"t": ["NUM"], "NUM": ['"7"']}
    assert len(g.parse("1+" * 300 + "1", "e")) > 900


def test_parser_words_and_lists():
    g = Grammar.read('s ::= s A | A\nA ::= "ab" | "a" | "b"')
    assert g.minimal("aab", "s") == {"s": ["s A", "A"], "A": ['"a"', '"ab"']}
    rules = {"plan": ["plan action", "action"], "xs": ['xs "," x', "x"], "x": ['"1"']}
    assert list_rules(rules) == {"plan": ("action", ""), "xs": ("x", '","')}
    assert flat_lists(rules)["plan"] == ["action", "plan action"]
    assert render({"a": ["b", "c"]}) == "a ::= b | c"


def test_ingest(spark, tmp_path):
    rows = [(1, "go", "(pick-up a)"), (2, "", "(pick-up a)"), (3, "go", None), (4, "go", "(fly a)")]
    df = ingest.ingest(spark.createDataFrame(rows, "id bigint, query string, program string"), ingest.PLANS, "plan")
    assert {r.id: r.reason for r in df.collect()} == {1: None, 2: "empty query", 3: "empty program", 4: "not readable"}
    assert ingest.write_corpus(df, str(tmp_path)) == (1, 4)
    assert spark.read.parquet(str(tmp_path / "failures")).count() == 3
    assert ingest.ingest(df.select("id", "query", "program").limit(0), ingest.PLANS, "plan").count() == 0


def test_clean_netlist(spark):
    raw = "my title\n* note\n\nR1 a b 1k ; tail\nC1 a <x> 2 * more\n+ ic=0\n.Foo bar\n.tran 1\nzz no\n.subckt s a\nB1 {x\n"
    want = "my title\nR1 a b 1k\nC1 a PLACEHOLDER 2 ic=0\nFoo bar\n.tran 1\nB1 {x}\n.end"
    assert one(spark, T.clean_netlist(F.col("t")), t=raw) == want
    assert one(spark, T.clean_netlist(F.col("t")), t="x\n.subckt s\n.ends\n.END") == "x\n.subckt s\n.ends\n.END"
    assert one(spark, T.clean_netlist(F.col("t")), t="") == ".end" and one(spark, T.clean_netlist(F.lit(None).cast("string"))) is None


def test_text_parts(spark):
    got = one(spark, T.instruction_parts(F.col("t")), t="<s><<SYS>>x<</SYS>> Adds two. Module header:\nmodule a(b);\n [/INST] z")
    assert (got.description, got.header) == ("Adds two.", "module a(b);")
    assert one(spark, T.instruction_parts(F.col("t")), t=" plain ").description == "plain"
    assert one(spark, T.module_header([F.col("a"), F.col("b")], F.col("c")), a="", b=None, c="module m(x); y") == "module m(x);"
    got = one(spark, T.comment_and_rest(F.col("t")), t="// a\n//  b\nmodule x;\n// c")
    assert (got.description, got.rest) == ("a b", "module x;\n// c")
    assert one(spark, T.plain_alternative(F.col("t")), t='"answer(" x ")" "," y') == "answer( x ), y"
    expanded = one(spark, T.expanded_alternatives(F.col("t"), {"DAY": ['"mon"', '"tue"'], "N": ["1"]}), t='on DAY "DAY" N')
    assert expanded == ['on "mon" "DAY" 1', 'on "tue" "DAY" 1']
    assert one(spark, T.compact_constants(F.col("t")), t="answer ( city ( ' new york ' ) )") == "answer(city('new york'))"
    assert one(spark, T.task_name(F.col("t")), t="out/a.b.json") == "out_a_b_json"


@pytest.mark.parametrize("out, err, want", [("Mismatches: 0 in 12 samples", "", "passed"), ("Mismatches: 3 in 12 samples", "", "failed: 3 out of 12 samples."), ("x", "a syntax error", "failed: syntax error."), ("Mismatches: 0 in 1 samples", "warn", "failed: compile error."), ("x", "", "failed: info string not matched."), (None, None, "timed out")])
def test_outcome(spark, out, err, want):
    assert one(spark, T.outcome(F.col("o"), F.col("e")), o=out, e=err) == want


def test_netlist_edges(spark):
    got = one(spark, T.netlist_edges(F.col("t")), t="R1 A 0 1k\nXu a b amp w=1\nQ1 c b e mod\nKx l1 l2")
    assert [(e.component, e.kind, e.net) for e in got] == [("r1", "R", "a"), ("r1", "R", "0"), ("xu", "X", "a"), ("xu", "X", "b"), ("q1", "Q", "c"), ("q1", "Q", "b"), ("q1", "Q", "e")]


def test_prompts(spark):
    demos = "array<struct<query:string,module_header:string,minimal_grammar:string,grammar_cot:string,program:string>>"
    df = spark.sql(f"SELECT 'q' AS q, cast(NULL AS string) AS h, 'G' AS g, cast(array(struct('a', '', 'x ::= y', 'why', 'P')) AS {demos}) AS d")
    roles = {m: [r["role"] for r in df.select(prompts.mode_messages(F.col("q"), F.col("h"), F.col("g"), F.col("d"), prompts.MODES[m]).alias("m")).first().m] for m in prompts.MODES}
    assert roles["zero_shot"] == ["system", "user"] and all(v == ["system", "user", "assistant", "user"] for k, v in roles.items() if k != "zero_shot")
    last = df.select(prompts.mode_messages(F.col("q"), F.col("h"), F.col("g"), F.col("d"), prompts.MODES["rag_cot_with_grammar"]).alias("m")).first().m
    assert last[1]["content"].endswith("Predicted grammar:\nwhy") and last[2]["content"] == "P" and last[3]["content"].endswith("Predicted grammar:\nG")
    cot = df.select(prompts.task_messages(F.col("q"), F.col("g"), F.lit("mod"), "program").alias("m")).first().m[1]["content"]
    assert cot == "Query: q\n\nModule header:\nmod\n\nGrammar:\nG"
    assert "Reasoning and Grammar:\nwhy" in df.select(prompts.retrieved_user(F.col("q"), F.col("d"), "cot").alias("t")).first().t
    templates = {"default": "{full_grammar}!", "default_cot": "c {full_grammar}", "geo": "g {full_grammar}", "bad": "x"}
    assert prompts.system_prompt(templates, "geo", "G") == "g G" and prompts.system_prompt(templates, "geo", "G", "cot") == "c G"
    with pytest.raises(ValueError):
        prompts.system_prompt(templates, "bad", "G")


def test_terms():
    t = function_term("answer(city(cityid('new york', _)))")
    assert str(t) == "answer(city(cityid('new york',_)))"
    assert bracketed("(filter (a b) = c)") == ["filter", ["a", "b"], "=", "c"]
    for bad in ("answer(", "a)b", "(a", ""):
        with pytest.raises(Unreadable):
            function_term(bad)
    for bad in ("(a", "a)b", "(a) (b)", ""):
        with pytest.raises(Unreadable):
            bracketed(bad)


@pytest.fixture(scope="module")
def world(spark):
    things = spark.createDataFrame([("s:a", "state", "a"), ("s:b", "state", "b"), ("c:x", "city", "x"), ("c:y", "city", "y")], "id string, kind string, name string")
    links = spark.createDataFrame([("loc", "c:x", "s:a"), ("loc", "c:y", "s:a"), ("next_to", "s:a", "s:b")], "relation string, a string, b string")
    numbers = spark.createDataFrame([("c:x", "population", 5.0), ("c:y", "population", 5.0), ("s:a", "size", 3.0)], "id string, attribute string, value double")
    return World(things, links, numbers)


@pytest.mark.parametrize(
    "program, want",
    [("answer(largest_one(population_1(city(all))))", {"c:x", "c:y"}), ("answer(most(state(loc_1(city(all)))))", {"s:a"}), ("answer(next_to_2(stateid('b')))", {"s:a"}), ("answer(longest(river(all)))", set()), ("answer(exclude(state(all), next_to_1(state(all))))", {"s:a"})],
)
def test_funql(world, program, want):
    assert {r.id for r in funql.denotation(program, world).collect()} == want


def test_funql_faults(world):
    for bad in ("answer(nothing(city(all)))", "answer(most(city(all)))"):
        with pytest.raises(Unreadable):
            funql.denotation(bad, world)
    with pytest.raises(Unreadable):
        lambda_dcs.denotation("(unknown x)", world, ())


def test_plans_of_all_domains():
    for domain, make in planner.GENERATORS.items():
        for seed in range(6):
            text = make(3 + seed % 3, seed)
            if text is None:
                continue
            task = planner.read(text, planner.DOMAINS[domain])
            found = planner.search(task, (), 3_000)
            assert found.solved and found.plan_length > 0 and not found.cut
    assert planner.read("nothing", planner.DOMAINS["depot"]) is None
    assert planner.random_blocks(4, 1) == planner.random_blocks(4, 1)


def test_seeded_search():
    text = "(define (problem p) (:objects a b c) (:init (handempty) (clear a) (on a b) (ontable b) (clear c) (ontable c)) (:goal (and (on b c))))"
    task = planner.read(text, planner.DOMAINS["blocksworld"])
    seeds = [("unstack", "a", "b"), ("put-down", "a"), ("pick-up", "b"), ("stack", "b", "c")]
    found = planner.search(task, seeds)
    assert (found.solved, found.plan_length, found.seed_valid, found.seed_total, found.expanded) == (True, 4, 4, 4, 1)
    assert planner.search(task, [("fly", "a")]).seed_valid == 0 and planner.search(task, (), 1).cut
    wall = planner.read("(define (:objects a) (:init (clear a)) (:goal (on a z)))", planner.DOMAINS["satellite"])
    assert not planner.search(wall).solved


def test_corrupt():
    rules = {"a": ["x"], "string": ["s"], "b": ["y", "z"]}
    full = {"a": ["x", "w"], "c": ["v"]}
    made = labels.corrupt(rules, full, ["remove", "remove", "remove"], random.Random(1))
    assert made == ["remove", "remove"] and "a" not in rules and "string" in rules and len(rules["b"]) == 1
    assert labels.corrupt({"a": ["x", "w"], "c": ["v"]}, full, ["add"], random.Random(1)) == []
    assert labels.operations(2, 2, random.Random(0)) == sorted(labels.operations(2, 2, random.Random(0)))
    with pytest.raises(ValueError):
        labels.operations(3, 1, random.Random(0))


def test_answers_are_tried_again(spark):
    rows = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "key string, prompt string")
    cached = spark.createDataFrame([("0", "known")], "key string, response string")

    def ask(prompts):
        if "p3" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    got = {r.key: r.response for r in dataflow.answered(rows, cached, ask, attempts=2, delay=0).collect()}
    assert got == {"0": "known", "1": "P1", "2": "P2", "3": None, "4": "P4", "5": "P5"}


def test_ranks_by_digest(spark):
    df = spark.range(500).select(F.col("id").alias("example_id"), (F.col("id") % 2).cast("string").alias("dataset"))
    got = sampling.by_digest(df, sampling.seeded()).collect()
    for part in ("0", "1"):
        import hashlib

        order = sorted((r for r in got if r.dataset == part), key=lambda r: (hashlib.md5(f"{r.example_id}-{sampling.SEED}".encode()).hexdigest(), r.example_id))
        assert [r.k for r in order] == list(range(1, 251))


def test_results_and_caches(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "geo.json").write_text(json.dumps({"accuracy": 0.5, "deep": {"f1": 0.25}, "results": [{"gold": "a"}, {"gold": "b"}]}))
    assert [r.gold for r in files.read_results(spark, str(tmp_path / "m" / "geo.json")).orderBy("pos").collect()] == ["a", "b"]
    assert files.read_report(spark, str(tmp_path), "deep.f1").collect() == [("m", "geo", 0.25)]
    (tmp_path / "d.jsonl").write_text('{"task_id": "t", "detail_description": "long"}\n')
    assert files.read_descriptions(spark, str(tmp_path / "d.jsonl")).first() == ("t", "long", None)
    metrics, rows = spark.createDataFrame([(0.5,)], "accuracy double"), spark.createDataFrame([("a",)], "gold string")
    files.write_results(metrics, rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "metrics")).first().accuracy == 0.5
    for _ in range(2):
        files.append_cache(spark.createDataFrame([("k", "r"), ("k", "r")], "key string, response string"), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    keys = files.embedding_keys(spark.createDataFrame([("a",), ("a",), (None,)], "query string"), "m").collect()
    assert keys[0].vector_key == keys[1].vector_key != keys[2].vector_key and re.match("m-", keys[2].vector_key)


def test_only_one_query_names_every_row():
    """No registered core query cuts its tables by a modulo."""
    import pathlib

    root = pathlib.Path(dataflow.__file__).parent
    assert not [p for p in root.glob("*.py") if "pred_id % 2" in p.read_text()]
