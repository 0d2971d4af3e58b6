"""Plans for the blocks world: valid prefixes of given plans, and seeded greedy best-first search.

A step that can't be applied ends the prefix. A null or unreadable problem gives a row
of nulls; a null plan has no steps. Search stops after NODES expanded states, the reference's limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import spread
from ..functions import planner
from .rules import examples

NODES = 100_000
#: Problems of each domain that are generated.
WANTED = 20
FACT = re.compile(r"\(([^()]+)\)")

State = frozenset[tuple[str, ...]]


def facts(text: str) -> State:
    return frozenset(tuple(f.split()) for f in FACT.findall(text))


def problem(text: str) -> tuple[State, State] | None:
    """(initial facts, goal facts) of a problem in PDDL."""
    init, goal = text.find("(:init"), text.find("(:goal")
    if init < 0 or goal < init:
        return None
    return facts(text[init + 6 : goal]), facts(text[goal + 6 :])


def effects(step: tuple[str, ...]) -> tuple[State, State, State] | None:
    """(needed, removed, added) facts of a step; null for an unknown one."""
    match step:
        case ("pick-up", x):
            need = {("clear", x), ("ontable", x), ("handempty",)}
            return frozenset(need), frozenset(need), frozenset({("holding", x)})
        case ("put-down", x):
            return frozenset({("holding", x)}), frozenset({("holding", x)}), frozenset({("clear", x), ("ontable", x), ("handempty",)})
        case ("stack", x, y):
            need = {("holding", x), ("clear", y)}
            return frozenset(need), frozenset(need), frozenset({("clear", x), ("on", x, y), ("handempty",)})
        case ("unstack", x, y):
            need = {("on", x, y), ("clear", x), ("handempty",)}
            return frozenset(need), frozenset(need), frozenset({("holding", x), ("clear", y)})
    return None


def apply(state: State, step: tuple[str, ...]) -> State | None:
    e = effects(step)
    return (state - e[1]) | e[2] if e and e[0] <= state else None


def steps_of(text: str | None) -> list[tuple[str, ...]]:
    return [tuple(line.strip()[1:].rstrip(")").split()) for line in (text or "").split("\n") if line.strip().startswith("(")]


def follow(state: State, steps: list[tuple[str, ...]]) -> list[State]:
    """States along the steps that apply, the first one included."""
    path = [state]
    for s in steps:
        if (state := apply(state, s)) is None:
            break
        path.append(state)
    return path


def moves(state: State) -> list[tuple[str, ...]]:
    """Steps that apply, in the order of their names."""
    held = [f[1] for f in state if f[0] == "holding"]
    clear = sorted(f[1] for f in state if f[0] == "clear")
    if held:
        return [("put-down", held[0]), *(("stack", held[0], y) for y in clear)]
    on = {f[1]: f[2] for f in state if f[0] == "on"}
    table = {f[1] for f in state if f[0] == "ontable"}
    return [("unstack", x, on[x]) if x in on else ("pick-up", x) for x in clear if ("handempty",) in state and (x in on or x in table)]


def search(start: State, goal: State, seeds: list[State] = (), limit: int = NODES) -> tuple[bool, int, int]:
    """(solved, expanded, created): greedy by the number of goal facts that are missing; seeds enter the queue before the search."""
    missing = lambda s: len(goal - s)
    seen, queue, made, expanded = set(), [], 0, 0
    for s in (start, *seeds):
        if s not in seen:
            seen.add(s)
            heapq.heappush(queue, (missing(s), made, s))
            made += 1
    while queue and expanded < limit:
        left, _, state = heapq.heappop(queue)
        if not left:
            return True, expanded, made
        expanded += 1
        for m in moves(state):
            if (new := apply(state, m)) is not None and new not in seen:
                seen.add(new)
                heapq.heappush(queue, (missing(new), made, new))
                made += 1
    return False, expanded, made


def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, plan in zip(b["problem_pddl"], b["program"]):
            task = problem(text) if text else None
            if task is None:
                rows.append((None,) * 7)
                continue
            steps = steps_of(plan)
            path = follow(task[0], steps)
            solved, expanded, made = search(*task, path[1:])
            rows.append((len(steps), len(path) - 1, len(path) - 1 == len(steps) and task[1] <= path[-1], solved, expanded, made, search(*task)[1]))
        yield pd.concat([b[["example_id", "domain"]].reset_index(drop=True), pd.DataFrame(rows, columns=["steps", "valid_steps", "reaches_goal", "solved", "expanded", "created", "expanded_unseeded"], dtype=object)], axis=1)


def plan_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per planning example: steps, valid steps, whether the plan reaches the goal, and the searches with and without it."""
    rows = spread(examples(spark, sf_dir).filter("domain is not null").select("example_id", "domain", "problem_pddl", "program"))
    return rows.mapInPandas(evaluate, "example_id bigint, domain string, steps int, valid_steps int, reaches_goal boolean, solved boolean, expanded int, created int, expanded_unseeded int")


def planning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, mean and median of nodes, and mean share of valid steps, of each domain."""
    return plan_evaluation(spark, sf_dir).groupBy("domain").agg(
        F.avg(F.col("solved").cast("double")).alias("success"), F.avg("expanded").alias("mean_expanded"), F.median("expanded").alias("median_expanded"), F.avg("created").alias("mean_created"), F.avg(F.when(F.col("steps") > 0, F.col("valid_steps") / F.col("steps"))).alias("valid_share")
    )


def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, domain, text, plan in zip(b["example_id"], b["domain"], b["problem_pddl"], b["program"]):
            actions = planner.DOMAINS.get(domain)
            task = planner.read(text, actions) if actions and text else None
            if task is None:
                rows.append((key, domain, "unreadable" if actions else "unsupported", None, None, None, None, None))
                continue
            f = planner.search(task, steps_of(plan), NODES)
            rows.append((key, domain, "solved" if f.solved else "cut" if f.cut else "exhausted", f.plan_length, f.expanded, f.created, f.seed_valid, f.seed_total))
        yield pd.DataFrame(rows, columns=["example_id", "domain", "status", "plan_length", "expanded", "created", "seed_valid", "seed_total"], dtype=object)


SEARCHED = "example_id bigint, domain string, status string, plan_length int, expanded int, created int, seed_valid int, seed_total int"


def plan_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches led by relaxed plans, seeded with the given one, in any of the domains: solved, exhausted, cut at NODES, unreadable, or unsupported for another domain."""
    rows = spread(examples(spark, sf_dir).filter("domain is not null").select("example_id", "domain", "problem_pddl", "program"), "example_id")
    return rows.mapInPandas(searched, SEARCHED)


def generated_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each domain the WANTED problems of the least seeds that can be solved, out of a fixed range of them; degenerate ones are left out. Doesn't read any table."""
    seeds = spark.range(2 * WANTED * len(planner.GENERATORS)).select((F.col("id") % (2 * WANTED)).alias("seed"), F.element_at(F.array(*map(F.lit, planner.GENERATORS)), (F.floor(F.col("id") / (2 * WANTED)) + 1).cast("int")).alias("domain"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(d, s, planner.GENERATORS[d](3 + s % 3, s)) for d, s in zip(b["domain"], b["seed"])]
            rows = [(d, s, t, planner.search(planner.read(t, planner.DOMAINS[d]), (), 2_000)) for d, s, t in made if t]
            yield pd.DataFrame([(d, s, t, f.plan_length) for d, s, t, f in rows if f.solved], columns=["domain", "seed", "problem_pddl", "plan_length"])

    solved = seeds.mapInPandas(make, "domain string, seed bigint, problem_pddl string, plan_length int")
    return solved.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("seed"))).filter(F.col("place") <= WANTED)


QUERIES = {"plan_evaluation": plan_evaluation, "planning_summary": planning_summary, "plan_searches": plan_searches, "generated_problems": generated_problems}
ORACLES: dict[str, str] = {}
