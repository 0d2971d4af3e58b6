"""Grammar files: a small text that is read on the driver, into rules and on to other notations."""

from __future__ import annotations

import re

HEAD = re.compile(r"^[?!]?(\w+)(?:\.\d+)?\s*:\s*(.*)$")
PIECE = re.compile(r'"(?:[^"\\]|\\.)*"i?|/(?:[^/\\]|\\.)+/[a-z]*|\w+|[()\[\]|]|[*+?]|~\d+(?:\.\.\d+)?|\S')


def alternatives(text: str) -> list[str]:
    """Splits at bars that stand outside literals, patterns and brackets."""
    found, start, depth = [], 0, 0
    for m in PIECE.finditer(text):
        token = m.group()
        depth += (token in "([") - (token in ")]")
        if token == "|" and depth == 0:
            found.append(text[start : m.start()].strip())
            start = m.end()
    return [*found, text[start:].strip()]


def read_rules(text: str) -> dict[str, list[str]]:
    """Rules and terminals with their alternatives, in the order of the file; comments and directives are skipped."""
    bodies: dict[str, str] = {}
    name = None
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith(("//", "%")):
            continue
        if line.startswith("|"):
            if name:
                bodies[name] += " " + line
        elif m := HEAD.match(line):
            name = m.group(1)
            bodies[name] = m.group(2)
        elif name:
            bodies[name] += " " + line
    return {n: [re.sub(r"\s*->\s*\w+$", "", a) for a in alternatives(b)] for n, b in bodies.items()}


def minimal_text(rules: dict[str, list[str]]) -> str:
    return "\n".join(f"{n} ::= {' | '.join(a)}" for n, a in rules.items())


def to_gbnf(rules: dict[str, list[str]], root: str) -> str:
    """GBNF with white space allowed between tokens; names in lower case with hyphens, patterns as character classes where they are one."""
    name = lambda w: w.lower().replace("_", "-")

    def convert(alt: str) -> str:
        out = []
        for t in PIECE.findall(alt):
            if t in "*+?" or t in ")]":
                if out:
                    out[-1] += {"]": ")?"}.get(t, t)
            elif t.startswith("/"):
                out.append(t.rsplit("/", 1)[0][1:])
            elif t.startswith('"'):
                out.append(t.rstrip("i") if t.endswith('"i') else t)
            else:
                out.append({"[": "("}.get(t, name(t) if re.fullmatch(r"\w+", t) else t))
        return " ws ".join(out).replace("( ws ", "( ").replace(" ws |", " |").replace("| ws ", "| ") or '""'

    lines = [f"root ::= {name(root)}", *(f"{name(n)} ::= {' | '.join(map(convert, a))}" for n, a in rules.items()), 'ws ::= [ \\t\\n]*']
    return "\n".join(lines)


def prune(text: str, unused: set[tuple[str, str]]) -> str:
    """The file without the (rule, alternative) pairs in `unused`; comments and directives stay, a rule left empty goes."""
    keep = {n: [a for a in alts if (n, a) not in unused] for n, alts in read_rules(text).items()}
    out, name = [], None
    for line in text.split("\n"):
        m = HEAD.match(line.strip())
        if m and not line.strip().startswith(("//", "%")):
            name = m.group(1)
            if keep[name]:
                head = line[: line.index(":") + 1]
                out.append(f"{head} " + "\n    | ".join(keep[name]))
        elif not line.strip() or line.strip().startswith(("//", "%")):
            out.append(line)
    return "\n".join(out)
