"""Messages of prompts as arrays of (role, content), built from columns; nothing is asked here.

System texts are parameters. A null query reads as an empty text; a part that an example
lacks (a module header, a grammar) is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tasks of supervised rows and whether their completion holds a grammar, its reasoning, or a program.
TASKS = ("program", "grammar", "grammar_cot", "grammar_program")
SYSTEM = {
    "with_grammar": "Write a program for the query that follows the grammar.",
    "plain": "Write a program for the query.",
    "grammar": "Write the rules that the program of the query needs.",
    "grammar_cot": "Reason about the query, then write the rules that its program needs.",
    "grammar_program": "Write the rules that the query needs, then its program.",
    "specialize": "Replace general alternatives by those that the query needs.",
    "explain": "Explain how the rules follow from the query.",
}


@dataclass(frozen=True)
class Mode:
    """What a prompt shows: demonstrations with grammars or reasoning, the grammar predicted for the query, and how demonstrations are chosen."""

    demo_grammar: bool
    demo_cot: bool
    own_grammar: bool
    selection: str
    system: str


MODES = {
    "zero_shot": Mode(False, False, False, "none", SYSTEM["plain"]),
    "baseline": Mode(False, False, False, "first_k", SYSTEM["plain"]),
    "grammar_first": Mode(True, False, False, "first_k", SYSTEM["grammar_program"]),
    "grammar_knn": Mode(True, False, False, "knn", SYSTEM["grammar_program"]),
    "rag_cot": Mode(True, True, False, "knn", SYSTEM["grammar_cot"]),
    "rag_cot_with_grammar": Mode(True, True, True, "knn", SYSTEM["with_grammar"]),
}
MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def asked(query: Column, header: Column | None = None) -> Column:
    """The query, and the module header if there is one."""
    plain = F.concat(F.lit("Query: "), text(query))
    return plain if header is None else F.when(text(header) != "", F.concat(plain, F.lit("\n\nModule header:\n"), header)).otherwise(plain)


def block(grammar: Column) -> Column:
    return F.concat(F.lit("<grammar>\n"), text(grammar), F.lit("\n</grammar>"))


def task_messages(query: Column, grammar: Column, header: Column, task: str, with_grammar: bool = True) -> Column:
    """System and user message of a task; an unknown task is a plain program's. The grammar is shown for programs only."""
    own = task in ("grammar", "grammar_cot", "grammar_program")
    system = SYSTEM[task if own else "with_grammar" if with_grammar else "plain"]
    user = asked(query, header)
    if with_grammar and not own:
        user = F.concat(user, F.lit("\n\nGrammar:\n"), text(grammar))
    return F.array(message("system", F.lit(system)), message("user", user))


def completion(grammar: Column, program: Column, cot: Column, task: str) -> Column:
    """What a supervised row wants as an answer."""
    return {"grammar_program": F.concat(text(grammar), F.lit("\n\nProgram:\n"), text(program)), "grammar": grammar, "grammar_cot": cot}.get(task, program)


def demo_messages(demos: Column, mode: Mode) -> Column:
    """A user and an assistant message for each of an array of demonstrations (query, module_header, minimal_grammar, grammar_cot, program)."""

    def pair(d: Column) -> Column:
        reasoned = F.when(text(d["grammar_cot"]) != "", d["grammar_cot"]).otherwise(block(d["minimal_grammar"]))
        shown = reasoned if mode.demo_cot else block(d["minimal_grammar"])
        user = asked(d["query"], d["module_header"])
        if mode.own_grammar:
            user = F.concat(user, F.lit("\n\nPredicted grammar:\n"), shown)
        answer = F.concat(shown, F.lit("\n\nProgram:\n"), text(d["program"])) if mode.demo_grammar and not mode.own_grammar else text(d["program"])
        return F.array(message("user", user), message("assistant", answer))

    return F.flatten(F.transform(demos, pair))


def mode_messages(query: Column, header: Column, predicted: Column, demos: Column, mode: Mode) -> Column:
    """System message, demonstrations, and the query with its predicted grammar where the mode shows it."""
    user = asked(query, header)
    if mode.own_grammar:
        user = F.concat(user, F.lit("\n\nPredicted grammar:\n"), text(predicted))
    shown = F.array().cast(MESSAGES) if mode.selection == "none" else demo_messages(demos, mode)
    return F.concat(F.array(message("system", F.lit(mode.system))), shown, F.array(message("user", user)))


def retrieved_user(query: Column, neighbours: Column, style: str = "default") -> Column:
    """One user message with numbered neighbours (query, minimal_grammar, grammar_cot, program), best first, then the task."""

    def show(n: Column, i: Column) -> Column:
        cot = text(n["grammar_cot"]) != "" if style == "cot" else F.lit(False)
        label = F.when(cot, "Reasoning and Grammar").otherwise("Grammar")
        value = F.when(cot, n["grammar_cot"]).otherwise(text(n["minimal_grammar"]))
        head = F.concat(F.lit("--- Example "), (i + 1).cast("string"), F.lit(" ---\nQuery: "), text(n["query"]), F.lit("\n"))
        return F.concat(head, label, F.lit(":\n"), value, F.lit("\nProgram:\n"), text(n["program"]), F.lit("\n"))

    parts = F.concat(F.array(F.lit("Similar examples:\n")), F.transform(neighbours, show), F.array(F.concat(F.lit("--- Your Task ---\nQuery: "), text(query))))
    return F.array_join(parts, "\n")


def system_prompt(templates: dict[str, str], stem: str, grammar: str, style: str = "default") -> str:
    """The template of a grammar's name, for reasoning that of ``name_cot``, else a default one, with the grammar put in."""
    suffix = "_cot" if style == "cot" else ""
    template = templates.get(stem + suffix, templates["default" + suffix])
    if "{full_grammar}" not in template:
        raise ValueError(f"the template of {stem} has no place for the grammar")
    return template.replace("{full_grammar}", grammar)


def explain_messages(query: Column, header: Column, program: Column, grammar: Column) -> Column:
    """Asks for the reasoning behind a grammar."""
    parts = F.concat(asked(query, header), F.lit("\n\nGold program:\n"), text(program), F.lit("\n\nMinimal grammar:\n"), text(grammar))
    return F.array(message("system", F.lit(SYSTEM["explain"])), message("user", parts))


def reasoning_with_grammar(reasoning: Column, grammar: Column) -> Column:
    return F.concat(text(reasoning), F.lit("\n\n"), block(grammar))


def rendered(messages: Column) -> Column:
    """Messages as one text, a line with the role ahead of each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), text(m["content"]))), "\n")
