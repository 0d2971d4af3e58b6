from grammarium.functions.grammar_files import minimal_text, prune, read_rules, to_gbnf
from grammarium.operators import planning as P
from grammarium.operators import scoring  # noqa: F401

TASK = "(define (problem p) (:domain blocksworld) (:objects a b c) (:init (handempty) (clear a) (on a b) (ontable b) (clear c) (ontable c)) (:goal (and (on b c))))"


def test_search_and_prefix():
    start, goal = P.problem(TASK)
    plan = P.steps_of("(unstack a b)\n(put-down a)\nnote\n(pick-up b)\n(stack b c)")
    path = P.follow(start, plan)
    assert len(path) == 5 and goal <= path[-1]
    assert len(P.follow(start, P.steps_of("(pick-up b)"))) == 1
    solved, expanded, _ = P.search(start, goal)
    assert solved and expanded > 0
    assert P.search(start, goal, path[1:])[1] == 0
    assert P.problem("nothing") is None and P.steps_of(None) == []


def test_search_goes_on_to_the_limit_of_the_reference():
    start = P.facts("(clear b4) (clear b5) (clear b6) (clear b7) (handempty) (on b0 b2) (on b2 b1) (on b5 b0) (on b7 b3) (ontable b1) (ontable b3) (ontable b4) (ontable b6)")
    goal = P.facts("(on b0 b1) (on b1 b7) (on b7 b2)")
    assert P.search(start, goal, limit=2_000)[:2] == (False, 2_000)
    solved, expanded, _ = P.search(start, goal)
    assert solved and 2_000 < expanded < 100_000 == P.NODES


def test_plan_evaluation(spark, tmp_path):
    rows = [(1, "blocksworld", TASK, "(unstack a b)\n(put-down a)\n(pick-up b)\n(stack b c)"), (2, "blocksworld", None, None), (3, "blocksworld", TASK, None)]
    spark.createDataFrame(rows, "example_id bigint, domain string, problem_pddl string, program string").write.parquet(str(tmp_path / "examples.parquet"))
    got = {r.example_id: r for r in P.plan_evaluation(spark, str(tmp_path)).collect()}
    assert got[1].reaches_goal and got[1].valid_steps == 4 and got[2].steps is None and got[3].steps == 0 and got[3].solved
    assert P.planning_summary(spark, str(tmp_path)).first().success == 1.0


def test_grammar_files():
    text = '// head\n?s: a "|" b -> x\n  | (a | b) c\nT.2: /[a|b]/\n%ignore " "'
    rules = read_rules(text)
    assert rules == {"s": ['a "|" b', "(a | b) c"], "T": ["/[a|b]/"]}
    assert minimal_text(rules).startswith('s ::= a "|" b | (a | b) c')
    assert to_gbnf({"s": ['"x" T', ""]}, "s").split("\n")[:2] == ["root ::= s", 's ::= "x" ws t | ""']
    assert "(a | b) c" not in prune(text, {("s", "(a | b) c")}) and "%ignore" in prune(text, set())
