"""Parsing of programs by grammars in the ``name ::= a | b`` notation, and the minimal grammar that a program needs.

An alternative is a series of quoted literals, names of rules and patterns between
slashes. White space between tokens doesn't matter. Any context-free grammar goes,
left-recursive ones too; of several derivations the one of the earlier alternatives and
longer tokens is taken. A rule that is named but not defined never matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

SYMBOL = re.compile(r'"((?:[^"\\]|\\.)*)"|/((?:[^/\\]|\\.)+)/|([^\s"/]+)')
SPACE = re.compile(r"\s*")


class Grammar:
    """rules: {name: [alternative, ...]} in their order."""

    def __init__(self, rules: dict[str, list[str]]):
        self.rules: dict[str, list[tuple[str, list[tuple[str, str]]]]] = {}
        #: Rules of nothing but literals: looked up by length, however many they are.
        self.words: dict[str, dict[int, set[str]]] = {}
        for name, alts in rules.items():
            parsed = [(a, [("text", m[1]) if m[1] is not None else ("pattern", m[2]) if m[2] is not None else ("rule", m[3]) for m in SYMBOL.finditer(a)]) for a in alts]
            if parsed and all(len(s) == 1 and s[0][0] == "text" and s[0][1] for _, s in parsed):
                by_length: dict[int, set[str]] = defaultdict(set)
                for _, s in parsed:
                    by_length[len(s[0][1])].add(s[0][1])
                self.words[name] = dict(sorted(by_length.items(), reverse=True))
            else:
                self.rules[name] = [(a, s) for a, s in parsed if s and all(v for _, v in s)]

    @classmethod
    def read(cls, text: str) -> Grammar:
        """Of several lines with one name the last counts."""
        rules: dict[str, list[str]] = {}
        for line in text.split("\n"):
            if "::=" in line:
                name, _, rhs = line.partition("::=")
                rules[name.strip(" \t\r")] = [a for a in (x.strip(" \t\r") for x in rhs.split(" | ")) if a]
        return cls(rules)

    def match(self, kind: str, value: str, text: str, at: int) -> list[tuple[int, str]]:
        """(end, what was read) of a token at a place, longest first."""
        at = SPACE.match(text, at).end()
        if kind == "text":
            return [(at + len(value), value)] if text.startswith(value, at) else []
        if kind == "pattern":
            m = compiled(value).match(text, at)
            return [(m.end(), m.group())] if m and m.end() > at else []
        return [(at + n, text[at : at + n]) for n, known in self.words[value].items() if text[at : at + n] in known]

    def parse(self, text: str, start: str) -> list[tuple[str, str]] | None:
        """(rule, alternative) of each node of a derivation, from the top and left to right; none if there is no derivation."""
        end = len(text)
        back: dict[tuple, tuple] = {}  # (rule, alternative, dot, origin, place) -> (item before, child)
        done: dict[tuple[str, int, int], tuple] = {}
        waiting: dict[tuple[int, str], list[tuple]] = defaultdict(list)
        agenda: dict[int, list[tuple]] = defaultdict(list)
        predicted: set[tuple[int, str]] = set()

        def add(item: tuple, before: tuple | None, child) -> None:
            if item not in back:
                back[item] = (before, child)
                agenda[item[4]].append(item)

        def predict(name: str, at: int) -> None:
            if (at, name) in predicted:
                return
            predicted.add((at, name))
            for k, (_, symbols) in enumerate(self.rules.get(name, ())):
                kind, value = symbols[0]
                if kind == "rule" or self.match(kind, value, text, at):
                    add((name, k, 0, at, at), None, None)

        predict(start, 0)
        place = 0
        while place <= end:
            queue, i = agenda.get(place, []), 0
            while i < len(queue):
                item = queue[i]
                i += 1
                name, k, dot, origin, _ = item
                symbols = self.rules[name][k][1]
                if dot == len(symbols):
                    if (name, origin, place) not in done:
                        done[name, origin, place] = item
                        for w in waiting.get((origin, name), ()):
                            add((w[0], w[1], w[2] + 1, w[3], place), w, (name, origin, place))
                    continue
                kind, value = symbols[dot]
                if kind == "rule" and value not in self.words:
                    waiting[place, value].append(item)
                    predict(value, place)
                    if (value, place, place) in done:
                        add((name, k, dot + 1, origin, place), item, (value, place, place))
                    continue
                for stop, read in self.match("words" if kind == "rule" else kind, value, text, place):
                    add((name, k, dot + 1, origin, stop), item, (value, f'"{read}"') if kind == "rule" else (name, f'"{read}"') if kind == "pattern" and len(symbols) == 1 else None)
            place += 1
        ends = [at for (name, origin, at) in done if name == start and origin == 0 and SPACE.match(text, at).end() == end]
        if not ends:
            return None
        found: list[tuple[str, str]] = []
        stack: list[tuple] = [(start, 0, max(ends))]
        while stack:
            node = stack.pop()
            if len(node) == 2:
                found.append(node)
                continue
            item = done[node]
            alternative, symbols = self.rules[item[0]][item[1]]
            if len(symbols) > 1 or symbols[0][0] != "pattern":  # a rule that is a pattern is told by what it read
                found.append((item[0], alternative))
            children = []
            while item is not None:
                item, child = back[item]
                if child is not None:
                    children.append(child)
            stack.extend(children)  # read from the last to the first, so the first is popped next
        return found

    def minimal(self, text: str, start: str, skip: frozenset[str] = frozenset()) -> dict[str, list[str]] | None:
        """Rules and alternatives that the program uses, each once, in the order of their first use; `skip` are scaffolding rules."""
        found = self.parse(text, start)
        if found is None:
            return None
        rules: dict[str, list[str]] = {}
        for name, alt in found:
            if name not in skip and alt not in rules.setdefault(name, []):
                rules[name].append(alt)
        return rules


@lru_cache(maxsize=1024)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def list_rules(rules: dict[str, list[str]]) -> dict[str, tuple[str, str]]:
    """{rule: (element, separator)} of rules that only repeat an element: ``x ::= x SEP y | y``."""
    found = {}
    for name, alts in rules.items():
        parts = [[m.group() for m in SYMBOL.finditer(a)] for a in alts]
        single = [p[0] for p in parts if len(p) == 1]
        longer = [p for p in parts if len(p) > 1]
        if len(parts) == 2 and len(single) == 1 and len(longer) == 1 and longer[0][0] == name and longer[0][-1] == single[0]:
            found[name] = (single[0], " ".join(longer[0][1:-1]))
    return found


def flat_lists(rules: dict[str, list[str]]) -> dict[str, list[str]]:
    """Rules with each repeating one written as the sorted elements that it repeats and itself."""
    lists = list_rules(rules)
    return {n: sorted({lists[n][0], *(a for a in rules[n])}) if n in lists else a for n, a in rules.items()}


def render(rules: dict[str, list[str]]) -> str:
    return "\n".join(f"{n} ::= {' | '.join(a)}" for n, a in rules.items())
