"""Column functions on programs, raw answers and grammars; all run inside the JVM.

Each gives null for null unless it says otherwise.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..common import grammar_lines, let

WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def grammar_of_output(text: Column) -> Column:
    """What stands in the first <grammar> block, else the whole text, trimmed."""
    pattern = r"(?s)<grammar>(.*?)</grammar>"
    return strip(F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(text))


def program_of_output(raw: Column, with_grammar: Column) -> Column:
    """What follows the last ``Program:`` where the mode also gives a grammar, else the whole; "" for null."""
    return F.coalesce(strip(F.when(with_grammar, F.substring_index(raw, "Program:", -1)).otherwise(raw)), F.lit(""))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; "" if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.when(text.isNotNull(), F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def fenced(text: Column, tags: str = r"[A-Za-z]*") -> Column:
    """The first fenced block, or the whole text."""
    pattern = rf"(?s)```(?:{tags})?[ \t]*\n(.*?)```"
    return strip(F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(text))


def last_fenced(text: Column) -> Column:
    """The last fenced block; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```[A-Za-z]*[ \t]*\n(.*?)```"), F.lit(1)), F.lit(-1))


def netlist(text: Column) -> Column:
    """Lines up to the first ``.end`` in any case, and with it."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.lower(strip(x))), ".end")
    return F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), at.cast("int")), "\n")).otherwise(text)


def completion(text: Column) -> Column:
    """A module body up to its first ``endmodule``, which is appended if it is missing; starts on a new line."""
    body = r"(?s)^(.*?\bendmodule\b)"
    cut = F.when(F.rlike(text, F.lit(body)), F.regexp_extract(text, body, 1)).otherwise(F.concat(text, F.lit("\nendmodule")))
    return F.when(F.startswith(cut, F.lit("\n")), cut).otherwise(F.concat(F.lit("\n"), cut))


def plan_steps(text: Column) -> Column:
    """Trimmed lines that start with a bracket."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.startswith(x, F.lit("(")))


def molecule_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(Br|Cl|%\d{2}|@@|[A-Z][a-z]?|[a-z]|[^A-Za-z])"), F.lit(1))


def call_tokens(text: Column) -> Column:
    """Tokens of a functional program: brackets and commas stand alone."""
    return F.filter(F.split(F.regexp_replace(text, r"([(),])", r" $1 "), r"\s+"), lambda x: x != "")


def list_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9_.]+|[^\s])"), F.lit(1))


#: Letters that name components; fixed values.
COMPONENTS = "RCLVIDQMXKJGEFHBSW"


def component_types(text: Column) -> Column:
    """Distinct first letters of lines that name a component, in upper case, sorted; the title line counts like others."""
    firsts = F.transform(F.split(text, "\n"), lambda x: F.upper(F.substring(strip(x), 1, 1)))
    return F.array_sort(F.array_distinct(F.filter(firsts, lambda c: (c != "") & F.contains(F.lit(COMPONENTS), c))))


def references(alternative: Column) -> Column:
    """Words of lower-case letters that stand between white space: the rules that an alternative refers to."""
    return F.regexp_extract_all(alternative, F.lit(r"(?:^|(?<=\s))([a-z_][a-z0-9_]*)(?=\s|$)"), F.lit(1))


def normal_alternative(alternative: Column) -> Column:
    """Literals and other tokens, joined by one blank."""
    return F.array_join(F.regexp_extract_all(alternative, F.lit(r'("(?:[^"\\]|\\.)*"|[^\s"]+)'), F.lit(1)), " ")


def mentions_terminal(alternative: Column, terminals: list[str]) -> Column:
    """Whether one of the terminals stands outside literals."""
    return F.rlike(F.regexp_replace(alternative, r'"[^"]*"', ""), F.lit(rf"\b({'|'.join(terminals)})\b"))


def render(grammar: Column) -> Column:
    """A grammar as plain ``name ::= a | b`` lines, in the order of the lines that count."""
    trimmed = lambda rhs: F.filter(F.transform(F.split(rhs, r" \| ", -1), lambda a: F.btrim(a, F.lit(" \t\r"))), lambda a: a != "")
    lines = F.array_sort(F.transform(grammar_lines(grammar), lambda r: F.struct((-r["neg_pos"]).alias("pos"), r["name"].alias("name"), r["rhs"].alias("rhs"))))
    return F.array_join(F.transform(lines, lambda r: F.concat(r["name"], F.lit(" ::= "), F.array_join(trimmed(r["rhs"]), " | "))), "\n")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k of n samples passes when c do: 1 - prod(1 - k/i) over i in n-c+1..n; 0 if none passes."""
    product = F.aggregate(F.sequence((n - c + 1).cast("int"), n.cast("int")), F.lit(1.0), lambda p, i: p * (1.0 - k / i))
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - product)


def sentence_bleu(gold: list[str], guess: list[str]) -> float:
    """BLEU-4: brevity penalty, 0.1 for an order without a match, 0 without a common word."""
    from collections import Counter
    from math import exp, log

    if not len(guess) or not set(gold) & set(guess):
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        want, have = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (gold, guess))
        hits, total = sum((want & have).values()), max(1, sum(have.values()))
        logs += log((hits or 0.1) / total)
    return exp(logs / 4 + (0 if len(guess) > len(gold) else 1 - len(gold) / len(guess)))


def bleu(gold: Column, guess: Column) -> Column:
    """sentence_bleu of two token arrays, in Arrow batches: counting n-grams has no built-in function."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def score(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else sentence_bleu(list(a), list(b)) for a, b in zip(g, p)], dtype="float64")

    return score(gold, guess)


def tokens_of_alternative(alternative: Column) -> Column:
    """Quoted texts without their marks and words, in their order."""
    return F.transform(F.regexp_extract_all(alternative, F.lit(r'("[^"]*"|\w+)'), F.lit(1)), lambda t: F.regexp_replace(t, '"', ""))


def plain_alternative(alternative: Column) -> Column:
    """The tokens joined by a blank, which is dropped where no word character stands on either side."""
    return F.regexp_replace(F.array_join(tokens_of_alternative(alternative), " "), r"(?<=\W)\s+(?=\W)", "")


def expanded_alternatives(alternative: Column, values: dict[str, list[str]]) -> Column:
    """The alternative with each terminal of `values`, outside quotes, replaced by each of its values; terminals in their order, all combinations."""

    def replaced(terminal: str, options: list[str]):
        outside = rf'\b{terminal}\b(?=(?:[^"]*"[^"]*")*[^"]*$)'
        plain = [v.replace("\\", "\\\\").replace("$", r"\$") for v in options]
        return lambda a: F.when(F.rlike(a, F.lit(outside)), F.array(*[F.regexp_replace(a, outside, v) for v in plain])).otherwise(F.array(a))

    found = F.array(alternative)
    for terminal, options in values.items():
        found = F.flatten(F.transform(found, replaced(terminal, options)))
    return found


def comment_and_rest(text: Column) -> Column:
    """struct<description, rest>: the leading lines that start with ``//``, without that, joined by blanks; and all from the first other line on, trimmed."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: ~F.startswith(strip(x), F.lit("//"))), True).cast("int")
    n = F.when(at > 0, at - 1).otherwise(F.size(lines))
    plain = F.transform(F.slice(lines, F.lit(1), n), lambda x: strip(F.regexp_replace(x, "^[/ ]+", "")))
    rest = F.slice(lines, n + 1, F.size(lines))
    return F.when(text.isNotNull(), F.struct(strip(F.array_join(plain, " ")).alias("description"), strip(F.array_join(rest, "\n")).alias("rest")))


#: What stands ahead of descriptions; a fixed pattern.
BOILERPLATE = r"(?s)^Implement the Verilog module based on the following (?:description|block level summaries)\.\s*Assume that signals are positive clock/clk edge triggered unless otherwise stated\.\s*"


def instruction_parts(text: Column) -> Column:
    """struct<description, header> of an instruction between ``<</SYS>>`` and ``[/INST]``; a text without these is all description."""
    inner = F.regexp_extract(text, r"(?s)<</SYS>>\s*(.*?)\s*\[/INST\]", 1)
    there = F.rlike(text, F.lit(r"(?s)<</SYS>>\s*(.*?)\s*\[/INST\]"))
    parts = F.split(inner, r"Module header:\s*", 2)
    description = F.when(there, strip(F.regexp_replace(strip(F.get(parts, F.lit(0))), BOILERPLATE, ""))).otherwise(strip(text))
    return F.when(text.isNotNull(), F.struct(description.alias("description"), F.when(there, strip(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise("").alias("header")))


def module_header(headers: list[Column], code: Column) -> Column:
    """The first header that isn't empty, else the code up to its first semicolon if it starts with a module, else an empty text."""
    own = F.when(F.startswith(strip(code), F.lit("module")), F.concat(F.substring_index(strip(code), ";", 1), F.lit(";")))
    return F.coalesce(*[F.when(h != "", h) for h in headers], own, F.lit(""))


#: First letters that lines of a netlist may have, and the words with a dot; fixed values.
NETLIST_STARTS = "RCLVIDQMXKJGEFHBSWrclvidqmxkjgefhbsw."
DOT_WORDS = (
    ".model .subckt .ends .tran .dc .ac .op .param .lib .include .options .ic .control .endc .print .plot .meas .measure .global .temp .nodeset .save .tf .end .node"
).split()


def clean_netlist(text: Column) -> Column:
    """A netlist line by line: comments and their tails are dropped, brackets replaced, unknown words with a dot lose it, continued lines joined to the one before; then lines that can't start a statement (but the title), unmatched subcircuits, and blanks; it is closed by ``.end``."""

    def one(line: Column) -> Column:
        for pattern, by in ((r"\s*;.*$", ""), (r"\s+\*\s+.*$", ""), (r"<[^>]*>", "PLACEHOLDER"), (r"\[[^\]]*\]", "PLACEHOLDER")):
            line = F.regexp_replace(line, pattern, by)
        unknown = F.rlike(line, F.lit(r"^\.[A-Za-z]")) & ~F.lower(F.regexp_extract(line, r"^(\S+)", 1)).isin(*DOT_WORDS)
        return F.regexp_replace(F.when(unknown, F.substr(line, F.lit(2))).otherwise(line), rf"{WHITE}+$", "")

    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, rf"{WHITE}+$", ""))
    kept = F.filter(F.transform(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("*"))), one), lambda x: x != "")
    none = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, F.size(a))
    tail = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last(a), F.lit(" "), strip(F.substr(x, F.lit(2))))))
    merged = F.aggregate(kept, none, lambda a, x: F.when(F.startswith(x, F.lit("+")) & (F.size(a) > 0), tail(a, x)).otherwise(F.concat(a, F.array(x))))
    first = lambda x: F.substring(strip(x), 1, 1)
    legal = let(merged, lambda m: F.filter(m, lambda x, i: (i == 0) | ((strip(x) != "") & F.contains(F.lit(NETLIST_STARTS), first(x)))))
    low = lambda x: F.lower(strip(x))
    ended = let(legal, lambda m: F.when(F.exists(m, lambda x: F.startswith(low(x), F.lit(".ends"))), m).otherwise(F.filter(m, lambda x: ~F.startswith(low(x), F.lit(".subckt")))))
    closed = let(ended, lambda m: F.when(F.exists(m, lambda x: low(x) == ".end"), m).otherwise(F.concat(m, F.array(F.lit(".end")))))
    squeezed = F.transform(closed, lambda x: let(F.regexp_replace(x, r"[ \t]+", " "), lambda y: F.when(F.contains(y, F.lit("{")) & ~F.contains(y, F.lit("}")), F.concat(y, F.lit("}"))).otherwise(y)))
    return F.when(text.isNotNull(), F.array_join(squeezed, "\n"))


#: How many of a component's fields are nets; fixed values.
NETS = {"R": 2, "C": 2, "L": 2, "V": 2, "I": 2, "D": 2, "Q": 3, "M": 4, "J": 3, "K": 0, "G": 4, "E": 4, "F": 2, "H": 2, "B": 2, "S": 4, "W": 2}


def netlist_edges(text: Column) -> Column:
    """array<struct<component, kind, net>>: what each component is joined to. A subcircuit call has all fields before the first assignment but the last as nets."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.split(strip(x), r"\s+"))
    kind = lambda f: F.upper(F.substring(F.get(f, F.lit(0)), 1, 1))
    arity = F.create_map(*[F.lit(v) for kv in NETS.items() for v in kv])
    rest = lambda f: F.slice(f, F.lit(2), F.size(f))
    called = lambda f: let(F.array_position(F.transform(rest(f), lambda x: F.contains(x, F.lit("="))), True).cast("int"), lambda at: F.when(at > 0, F.slice(rest(f), F.lit(1), at - 1)).otherwise(rest(f)))
    nets = lambda f: F.when(kind(f) == "X", let(called(f), lambda c: F.when(F.size(c) > 1, F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c))).otherwise(F.slice(rest(f), F.lit(1), F.coalesce(F.try_element_at(arity, kind(f)), F.lit(2))))
    known = F.filter(lines, lambda f: (kind(f) != "") & F.contains(F.lit(COMPONENTS), kind(f)))
    return F.array_distinct(F.flatten(F.transform(known, lambda f: F.transform(nets(f), lambda n: F.struct(F.lower(F.get(f, F.lit(0))).alias("component"), kind(f).alias("kind"), F.lower(n).alias("net"))))))


def compact_constants(program: Column) -> Column:
    """A functional program without blanks, but for those inside quoted names of two or three words."""
    held = F.regexp_replace(F.regexp_replace(program, r"' (\w+) (\w+) '", "'$1#$2'"), r"' (\w+) (\w+) (\w+) '", "'$1#$2#$3'")
    return F.replace(F.replace(held, F.lit(" "), F.lit("")), F.lit("#"), F.lit(" "))


def outcome(out: Column, err: Column) -> Column:
    """What a simulator's output says of a program; null output means that it never came."""
    pattern = r"Mismatches: ([0-9]+) in ([0-9]+) samples"
    wrong, all_ = F.regexp_extract(out, pattern, 1), F.regexp_extract(out, pattern, 2)
    return (
        F.when(out.isNull() & err.isNull(), "timed out")
        .when(F.contains(err, F.lit("syntax error")), "failed: syntax error.")
        .when(F.length(err) > 0, "failed: compile error.")
        .when(~F.coalesce(F.rlike(out, F.lit(pattern)), F.lit(False)), "failed: info string not matched.")
        .when(wrong.cast("bigint") == 0, "passed")
        .otherwise(F.concat(F.lit("failed: "), wrong, F.lit(" out of "), all_, F.lit(" samples.")))
    )


def task_name(path: Column) -> Column:
    """A path as a name of a task."""
    return F.translate(path, "/.", "__")


def rejection(query: Column, program: Column, netlist: Column) -> Column:
    """Why a row can't be taken: an empty query, an empty program, or a netlist of under two lines; null if it can."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    lines = F.filter(F.split(program, "\n"), lambda x: (strip(x) != "") & (F.lower(strip(x)) != ".end"))
    return F.when(blank(query), "empty query").when(blank(program), "empty program").when(netlist & (F.size(lines) <= 1), "degenerate program")
