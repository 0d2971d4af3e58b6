"""Planning in any domain of typed actions: grounding, relaxed plans as a heuristic, seeded greedy search, random problems."""

from __future__ import annotations

import heapq
import random
import re
from dataclasses import dataclass
from itertools import product

Fact = tuple[str, ...]
State = frozenset[Fact]
BRACKETED = re.compile(r"\(([^()]+)\)")


@dataclass(frozen=True)
class Action:
    """Parameters as (name, type), an empty type for any; facts that must hold, that cease and that begin, over the parameters."""

    name: str
    parameters: tuple[tuple[str, str], ...]
    needs: tuple[Fact, ...]
    removes: tuple[Fact, ...]
    adds: tuple[Fact, ...]


def action(head: str, needs: str, removes: str, adds: str) -> Action:
    """From ``name x:type y`` and facts parted by commas."""
    name, *parameters = head.split()
    facts = lambda text: tuple(tuple(f.split()) for f in text.split(",") if f.strip())
    return Action(name, tuple((p.partition(":")[0], p.partition(":")[2]) for p in parameters), facts(needs), facts(removes), facts(adds))


#: The standard domains, and which types stand under others; fixed values.
DOMAINS = {
    "blocksworld": (
        action("pick-up x", "clear x, ontable x, handempty", "clear x, ontable x, handempty", "holding x"),
        action("put-down x", "holding x", "holding x", "clear x, ontable x, handempty"),
        action("stack x y", "holding x, clear y", "holding x, clear y", "clear x, on x y, handempty"),
        action("unstack x y", "on x y, clear x, handempty", "on x y, clear x, handempty", "holding x, clear y"),
    ),
    "depot": (
        action("drive x:truck f:place t:place", "at x f", "at x f", "at x t"),
        action("lift h:hoist c:crate s:surface p:place", "at h p, available h, at c p, on c s, clear c", "at c p, clear c, available h, on c s", "lifting h c, clear s"),
        action("drop h:hoist c:crate s:surface p:place", "at h p, at s p, clear s, lifting h c", "lifting h c, clear s", "at c p, clear c, available h, on c s"),
        action("load h:hoist c:crate t:truck p:place", "at h p, at t p, lifting h c", "lifting h c", "in c t, available h"),
        action("unload h:hoist c:crate t:truck p:place", "at h p, at t p, in c t, available h", "in c t, available h", "lifting h c"),
    ),
    "satellite": (
        action("turn_to s:satellite n:direction p:direction", "pointing s p", "pointing s p", "pointing s n"),
        action("switch_on i:instrument s:satellite", "on_board i s, power_avail s", "calibrated i, power_avail s", "power_on i"),
        action("switch_off i:instrument s:satellite", "on_board i s, power_on i", "power_on i", "power_avail s"),
        action("calibrate s:satellite i:instrument d:direction", "on_board i s, calibration_target i d, pointing s d, power_on i", "", "calibrated i"),
        action("take_image s:satellite d:direction i:instrument m:mode", "calibrated i, on_board i s, supports i m, power_on i, pointing s d", "", "have_image d m"),
    ),
}
ABOVE = {"depot": ("place",), "distributor": ("place",), "pallet": ("surface",), "crate": ("surface",)}


@dataclass(frozen=True)
class Step:
    """A grounded action."""

    name: Fact
    needs: State
    removes: State
    adds: State


@dataclass(frozen=True)
class Problem:
    start: State
    goal: State
    steps: tuple[Step, ...]


def typed_objects(text: str) -> dict[str, set[str]]:
    """{object: its types} of ``a b - t c - u``; the types above are added, and the empty one is any."""
    found: dict[str, set[str]] = {}
    held: list[str] = []
    words = text.split()
    i = 0
    while i < len(words):
        if words[i] == "-" and i + 1 < len(words):
            for o in held:
                found[o] = {"", words[i + 1], *ABOVE.get(words[i + 1], ())}
            held, i = [], i + 2
            continue
        held.append(words[i])
        i += 1
    return found | {o: {""} for o in held}


def read(text: str, actions: tuple[Action, ...]) -> Problem | None:
    """A problem in PDDL, grounded; none if it lacks a start or a goal."""
    init, goal, objects = text.find("(:init"), text.find("(:goal"), text.find("(:objects")
    if init < 0 or goal < init:
        return None
    facts = lambda part: frozenset(tuple(f.split()) for f in BRACKETED.findall(part))
    start, want = facts(text[init + 6 : goal]), facts(text[goal + 6 :])
    known = typed_objects(text[objects + 9 : text.find(")", objects)]) if objects >= 0 else {}
    for f in start | want:
        for o in f[1:]:
            known.setdefault(o, {""})
    return Problem(start, want, ground(actions, known, start))


def ground(actions: tuple[Action, ...], objects: dict[str, set[str]], start: State) -> tuple[Step, ...]:
    """All actions over objects of fitting types whose facts that never change hold at the start."""
    changing = {f[0] for a in actions for f in (*a.adds, *a.removes)}
    steps = []
    for a in actions:
        options = [sorted(o for o, kinds in objects.items() if kind in kinds) for _, kind in a.parameters]
        for chosen in product(*options):
            if len(a.parameters) > 1 and a.name in ("stack", "unstack", "drive", "turn_to") and len(set(chosen)) < len(chosen):
                continue
            of = dict(zip((p for p, _ in a.parameters), chosen))
            bound = lambda facts, of=of: frozenset((f[0], *(of.get(x, x) for x in f[1:])) for f in facts)
            needs = bound(a.needs)
            if all(f in start for f in needs if f[0] not in changing):
                removes, adds = bound(a.removes), bound(a.adds)
                steps.append(Step((a.name, *chosen), needs, removes - adds, adds))
    return tuple(steps)


def relaxed(problem: Problem, state: State) -> float:
    """Steps of a plan for the goal if nothing ever ceased to hold, found by cheapest supporters; infinite if there is none."""
    if problem.goal <= state:
        return 0
    level: dict[Fact, int] = dict.fromkeys(state, 0)
    by: dict[Fact, Step] = {}
    left = list(problem.steps)
    depth = 0
    while not all(f in level for f in problem.goal):
        depth += 1
        now = [s for s in left if all(f in level for f in s.needs)]
        if not now:
            return float("inf")
        fresh: dict[Fact, Step] = {}
        for s in now:
            cost = sum(level[f] for f in s.needs)
            for f in s.adds:
                if f not in level and (f not in fresh or cost < sum(level[x] for x in fresh[f].needs)):
                    fresh[f] = s
        done = set(map(id, now))
        left = [s for s in left if id(s) not in done]
        for f, s in fresh.items():
            level[f], by[f] = depth, s
    chosen: set[Fact] = set()
    wanted, met = [f for f in problem.goal if level[f]], set()
    while wanted:
        f = wanted.pop()
        if f in met:
            continue
        met.add(f)
        chosen.add(by[f].name)
        wanted += [n for n in by[f].needs if level[n] and n not in met]
    return len(chosen)


@dataclass
class Found:
    solved: bool
    created: int
    expanded: int
    plan_length: int | None
    seed_valid: int
    seed_total: int
    cut: bool = False


def search(problem: Problem, seeds: list[Fact] = (), limit: int = 100_000) -> Found:
    """Greedy best-first by `relaxed`; states that a given plan passes enter the queue first, and a state met again at less cost is opened again. `cut` tells that the limit ended it."""
    named = {s.name: s for s in problem.steps}
    queue: list[tuple] = []
    cost = {problem.start: 0}
    first = relaxed(problem, problem.start)
    if first == float("inf"):
        return Found(False, 1, 0, None, 0, len(seeds))
    heapq.heappush(queue, (first, 0, 0, problem.start))
    created, expanded, valid = 1, 0, 0
    state, g = problem.start, 0
    for name in seeds:
        s = named.get(name)
        if s is None or not s.needs <= state:
            break
        state, g = (state - s.removes) | s.adds, g + 1
        h = relaxed(problem, state)
        if h == float("inf"):
            break
        valid += 1
        if cost.get(state, float("inf")) > g:
            cost[state] = g
            heapq.heappush(queue, (h, created, g, state))
            created += 1
    while queue and expanded < limit:
        _, _, g, state = heapq.heappop(queue)
        if cost[state] < g:
            continue
        expanded += 1
        if problem.goal <= state:
            return Found(True, created, expanded, g, valid, len(seeds))
        for s in problem.steps:
            if s.needs <= state:
                new = (state - s.removes) | s.adds
                if cost.get(new, float("inf")) > g + 1:
                    h = relaxed(problem, new)
                    if h != float("inf"):
                        cost[new] = g + 1
                        heapq.heappush(queue, (h, created, g + 1, new))
                        created += 1
    return Found(False, created, expanded, None, valid, len(seeds), bool(queue))


def towers(blocks: list[str], rng: random.Random) -> list[list[str]]:
    blocks = rng.sample(blocks, len(blocks))
    out = []
    while blocks:
        n = rng.randint(1, len(blocks))
        out.append(blocks[:n])
        blocks = blocks[n:]
    return out


def standing(piles: list[list[str]]) -> set[str]:
    found = set()
    for pile in piles:
        found |= {f"(ontable {pile[0]})", f"(clear {pile[-1]})", *(f"(on {b} {a})" for a, b in zip(pile, pile[1:]))}
    return found


def text_of(domain: str, seed: int, objects: str, init: set[str], goal: set[str]) -> str:
    return f"(define (problem {domain}-{seed}) (:domain {domain}) (:objects {objects}) (:init {' '.join(sorted(init))}) (:goal (and {' '.join(sorted(goal))})))"


def random_blocks(size: int, seed: int) -> str | None:
    rng = random.Random(seed)
    blocks = [f"b{i}" for i in range(size)]
    init, goal = standing(towers(blocks, rng)), standing(towers(blocks, rng))
    return None if init == goal else text_of("blocksworld", seed, " ".join(blocks), init | {"(handempty)"}, goal)


def random_depot(size: int, seed: int) -> str | None:
    """Crates on pallets at places with a hoist each; some are wanted elsewhere."""
    rng = random.Random(seed)
    places = [f"p{i}" for i in range(max(2, size // 2))]
    crates = [f"c{i}" for i in range(size)]
    init, top = set(), {}
    for i, p in enumerate(places):
        init |= {f"(at h{i} {p})", f"(available h{i})", f"(at s{i} {p})"}
        top[p] = f"s{i}"
    at = {}
    for c in crates:
        at[c] = rng.choice(places)
        init |= {f"(at {c} {at[c]})", f"(on {c} {top[at[c]]})"}
        top[at[c]] = c
    init |= {f"(clear {t})" for t in top.values()} | {f"(at t0 {rng.choice(places)})"}
    goal = {f"(on {c} s{places.index(rng.choice([p for p in places if p != at[c]]))})" for c in rng.sample(crates, 1)}
    objects = f"{' '.join(places)} - depot t0 - truck {' '.join(f'h{i}' for i in range(len(places)))} - hoist {' '.join(f's{i}' for i in range(len(places)))} - pallet {' '.join(crates)} - crate"
    return text_of("depot", seed, objects, init, goal)


def random_satellite(size: int, seed: int) -> str | None:
    """Satellites with an instrument each, and images that are wanted."""
    rng = random.Random(seed)
    sats, dirs, modes = [f"s{i}" for i in range(max(1, size // 3))], [f"d{i}" for i in range(size)], ["m0", "m1"]
    init = set()
    for i, s in enumerate(sats):
        init |= {f"(on_board i{i} {s})", f"(power_avail {s})", f"(pointing {s} {rng.choice(dirs)})", f"(calibration_target i{i} {rng.choice(dirs)})", *(f"(supports i{i} {m})" for m in modes)}
    goal = {f"(have_image {d} {rng.choice(modes)})" for d in rng.sample(dirs, max(1, size // 2))}
    objects = f"{' '.join(sats)} - satellite {' '.join(f'i{i}' for i in range(len(sats)))} - instrument {' '.join(dirs)} - direction {' '.join(modes)} - mode"
    return text_of("satellite", seed, objects, init, goal)


GENERATORS = {"blocksworld": random_blocks, "depot": random_depot, "satellite": random_satellite}
