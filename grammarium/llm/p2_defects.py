"""Broken prompt and response pairs: empty, copied, refused, truncated or in another language.

One pass reads each field: is anything there, does it hold a program or reasoning,
does it repeat the query, does it stop before its end, in what language is its
prose. What holds neither a program nor marks of reasoning (rules, quoted terms,
rule names) is a candidate for a refusal. Its opening, the longer of its first two
sentences with the query's words and all names masked, is clustered with the other
openings: openings alike have a similarity of 0.8 over shingles of five words, found
by the rare shingles that such pairs must share; clusters are the connected
components of all pairs alike. A cluster that recurs over at least
PROMPTS unrelated queries is a template. Templates that seldom stand inside
reasoning are refusals; these, and on the other side reasoning and the words around
programs, teach what refusals are worded like, as counts of words and pairs of
words. A candidate is a refusal if its words, and the share of refusals among the
templates of its field, tell more for one than against it; an answer without a
program is one unless they tell clearly against it.

Languages are told by the frequent words of about LABELLED documents of known
language and of the queries whose language these tell for sure; an answer in a
language that none of them has is told by words that it shares with another one
than the query's. Without such documents no defect of language is found, and
without templates no words are learned.

A null field is empty. Fields of grammar_cot in modes that ask for no reasoning
are no cases. Of a null query only empty, truncated and refusal can be told.
Repeated rows count once; empty tables give no rows; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, let, table, unique

REASONED = ("cot", "rag_cot_with_grammar")
PROMPTS, SHINGLE, ALIKE = 5, 5, 0.8
#: Openings of one shingle that a task compares with as many others.
BLOCK = 2_000
#: Places of the counts of words and pairs of words, share of the pooled counts that smooths a side's, the most that one of them may tell, and what must tell against a refusal where an answer has no program.
BUCKETS, SMOOTH, MOST, LEEWAY = 1 << 16, 0.1, 4.0, 12.0
#: Documents whose language is learned from (about so many), places of the counts of their words, share and number of a language's texts that a word must stand in, texts that are shared out among languages beforehand, rounds of learning from queries, how sure the language of a query must be to teach and how much likelier another language must be.
LABELLED, PLACES, FREQUENT, LEAST, PRIOR, ROUNDS, SURE, FARTHER = 20_000, 1 << 18, 0.02, 3, 20.0, 2, 4.0, 3.5

#: Words for "no value" and labels that may stand alone; fixed values.
NOTHING = frozenset("n a na none null nil nan empty nothing void undefined unknown tbd todo no value answer response".split())
LABELS = frozenset("program programme reasoning answer response output result solution grammar query text code plan netlist spice verilog lisp json xml plain explanation thought thoughts step steps".split())
GRAMMAR = re.compile(r"(?s)<grammar>(.*?)</grammar>")
OPEN_GRAMMAR = re.compile(r"<grammar>(?!.*</grammar>)", re.S)
MARKUP = re.compile(r"</?[a-z_]+>|```[a-z]*|[*_`#>]+", re.I)
FENCED = re.compile(r"(?s)```.*?(?:```|\Z)")
WORD = re.compile(r"[^\W_]+", re.U)
#: What only programs of the datasets hold, by line.
PROGRAM = re.compile(
    r"::=|\banswer\(|\(\s*listvalue|\(\s*(?:pick-up|put-down|unstack|stack|drive|lift|drop|load|unload)\b|^\s*\(\s*[a-z-]+(?:\s+[a-z]+){1,2}\s*\)\s*$|^\W*(?:program: )?\* ?\w+ stage\s*$|^\s*[rclvdqmix]\d+ \S+ \S+"
    r"|^\s*\.end\b|\bassign\b.*=|= ?\(+\w+ [&|^+-]|\bwire\s*\[|\bendmodule\b|\w+\(\w+\(|\(\w+ \(\w+",
    re.I | re.M,
)
#: A line of nothing but atoms, bonds and brackets, slips allowed.
MOLECULE = re.compile(r"^[A-Za-z0-9()=#@+\-\[\]%/\\]{3,}(?: ?(?:\.\.\.|…))?$")
LOOSE = re.compile(r"\s*([()])\s*")
QUOTED = re.compile(r'"[^"]*"|\'[^\']*\'')
LABEL = re.compile(r"^\W*(?:query|q|a|answer|program|reasoning|you asked|the query is|question|die frage lautet|la pregunta es|la question est|anfrage)\s*:\s*", re.I)
ASKED = re.compile(r"^\W*(?:query|q|you asked|the query is|question|die frage lautet|la pregunta es|la question est|la consulta es|la requête est|la domanda è|a pergunta é|[\w ]{3,24})\s*:\s*", re.I)
UNITS = re.compile(r"(?<=[.!?])\s+|\n+")
TAIL = re.compile(r"(?:\s|</?[a-z]+>|\*\*ok\*\*|\*\*|\(\d+/\d+\)|✓|-{3,}|​|done\.?$)+$", re.I)
RULE_NAME = re.compile(r"\b[A-Z][A-Z_]{2,}\b|\b[a-z]+_[a-z_]+\b")


def tokens(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def is_empty(text: str) -> bool:
    rest = MARKUP.sub(" ", text.replace("​", " "))
    found = tokens(rest)
    return all(w in NOTHING for w in found) or all(w in LABELS or w in NOTHING for w in found) and len(found) <= 3


class Speech:
    """Languages by their frequent words, hashed into PLACES, from sources of (texts of each language, texts of each language that hold the word at each place). A word weighs the logarithm of its share of a language's texts; one that no source holds in FREQUENT of a language's texts and in LEAST of them, as names are, weighs nothing. The last source tells how often each language asks."""

    def __init__(self, *sources: tuple[dict[str, int], dict[str, np.ndarray]]):
        self.names = sorted({k for sizes, _ in sources for k in sizes})
        none = np.zeros(PLACES)
        counts = [np.array([c.get(k, none) for k in self.names]).reshape(-1, PLACES) for _, c in sources]
        sizes = [np.array([z.get(k, 0) for k in self.names], dtype=np.float64).reshape(-1, 1) for z, _ in sources]
        n, size = sum(counts), sum(sizes)
        log = np.log((n + PRIOR * n.sum(axis=0) / max(1.0, size.sum())) / (size + PRIOR) + 1e-9)
        heard = [((c >= FREQUENT * z) & (c >= LEAST)).any(axis=0) for c, z in zip(counts, sizes)]
        log[:, ~np.any(heard, axis=0)] = 0
        self.log = np.ascontiguousarray(log.T)
        self.known = np.any(heard, axis=0)
        self.places: dict[str, int] = {}
        self.asked: dict[str, tuple[int, float]] = {}
        self.prior = np.log((sizes[-1][:, 0] + 1) / (sizes[-1].sum() + len(self.names))) if len(sources) > 1 else np.zeros(len(self.names))

    @staticmethod
    def place(word: str) -> int:
        return crc32(word.encode()) % PLACES

    def of(self, found: list[str]) -> np.ndarray:
        """Logarithms of the shares of those words that weigh anything: a row for each, a column for each language."""
        at = []
        for w in found:
            if w not in self.places:
                if len(self.places) > 100_000:
                    self.places.clear()
                p = self.place(w) if w.isalpha() else -1
                self.places[w] = p if p >= 0 and self.known[p] else -1
            if self.places[w] >= 0:
                at.append(self.places[w])
        return self.log[at]

    def asks(self, query: str) -> tuple[int, float]:
        """The language of a query, and how much likelier it is than the next one."""
        if query not in self.asked:
            if len(self.asked) > 10_000:
                self.asked.clear()
            score = self.of(tokens(query)).sum(axis=0) + self.prior
            last = np.sort(score)
            self.asked[query] = int(score.argmax()), float(last[-1] - last[-2])
        return self.asked[query]

    def other(self, query: str, text: str) -> bool:
        """Whether `text` is worded in another language than `query`."""
        if len(self.names) < 2:
            return False
        own, used = self.asks(query)[0], {w for w in tokens(query) if len(w) > 3}
        said = self.of([w for w in tokens(RULE_NAME.sub(" ", QUOTED.sub(" ", text))) if w not in used])
        if len(said) < 2:
            return False
        nearer = said - said[:, own : own + 1]
        top = nearer[:, int(nearer.sum(axis=0).argmax())]
        return bool(top.sum() > FARTHER and (top > 0).sum() >= 2)  # one word alone may be a slip


def trigrams(text: str) -> set[str]:
    s = " ".join(tokens(text))
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


def repeats(query: str, text: str) -> bool:
    """Whether `text` is the query, perhaps with small changes, and nothing else."""
    q, t = trigrams(query), trigrams("\n".join(LABEL.sub("", x) for x in text.split("\n")))
    both = len(q & t)
    return both >= 0.7 * len(t) and both >= 0.6 * len(q) and len(tokens(text)) <= 2.6 * len(tokens(query)) + 4


def without_query(lines: list[str], query: str) -> list[str]:
    """Lines without those that quote the query."""
    q = set(tokens(query))
    return [x for x in lines if not (len(q) >= 4 and len(q & set(tokens(x))) >= 0.8 * len(q))]


def is_molecule(line: str) -> bool:
    x = LOOSE.sub(r"\1", LABEL.sub("", line.strip(" `*\""))).strip()
    upper = sum(c.isupper() for c in x)
    return bool(MOLECULE.match(x)) and upper > 0 and (upper >= 0.3 * sum(c.isalpha() for c in x) or "(" in x or "=" in x)


def has_program(body: str) -> bool:
    """A program's own marks, or a line that writes a molecule."""
    return bool(PROGRAM.search(body)) or any(is_molecule(line) for line in body.split("\n"))


def is_open(text: str) -> bool:
    return sum(map(text.count, "([{")) > sum(map(text.count, ")]}"))


def stops_early(body: str) -> bool:
    """A program that isn't closed."""
    text = FENCE_LINES.sub("", body).strip()
    if is_open(text):
        return True
    low = text.lower()
    if re.search(r"^\W*(?:program: )?\*.*stage|^[rclvd]\d+ ", low, re.M):
        last = [w for w in re.findall(r"\S+", low)]
        if not any(w == ".end" or w.startswith(".end") or sorted(w) == sorted(".end") for w in last):
            return True
    if re.search(r"\bassign\b|\bwire\s*\[", low) and not any(near_word(w, "endmodule") for w in re.findall(r"[a-z]+", low)):
        return True
    return bool(re.search(r"(?:\.\.\.|…)\s*$", text))


FENCE_LINES = re.compile(r"^\s*```.*$", re.M)


@lru_cache(maxsize=65_536)
def near_word(w: str, goal: str) -> bool:
    """Equal but for one slip: two letters swapped, one wrong, doubled or (not at the end) left out."""
    if w == goal:
        return True
    if abs(len(w) - len(goal)) > 1 or goal.startswith(w):
        return False
    if len(w) == len(goal):
        wrong = [i for i in range(len(w)) if w[i] != goal[i]]
        return len(wrong) == 1 or len(wrong) == 2 and w[wrong[0]] == goal[wrong[1]] and w[wrong[1]] == goal[wrong[0]]
    a, b = sorted((w, goal), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def breaks_off(text: str) -> bool:
    """Reasoning that stops inside a sentence or fence."""
    if text.count("```") % 2:
        return True
    rest = TAIL.sub("", text.rstrip())
    if not rest or rest.endswith("```"):
        return False
    if re.search(r"(?:\.\.\.|…)$", rest):
        return True
    last = rest.rsplit("\n", 1)[-1]
    if "::=" in last:
        return False
    end = rest.rstrip("\"'”’*)")
    return not end or end[-1] not in ".!?" or UNITS.split(last)[-1].count('"') % 2 == 1


def mask(unit: str, query: str) -> str:
    """The unit's words, with what belongs to one query or grammar replaced."""
    own = {w for w in tokens(query) if len(w) > 3}
    text = RULE_NAME.sub(" _ ", QUOTED.sub(" _ ", LABEL.sub("", unit)))
    return " ".join("_" if w in own or any(c.isdigit() for c in w) else w for w in tokens(text.replace("’", "'").replace("'", "")))


Told = tuple[str | None, bool, str, list[str]]


def judge(field: str, query: str | None, text: str | None, other=lambda query, text: False) -> Told:
    """(defect, candidate for a refusal, its opening, masked sentences); `other` tells whether a text is in another language than a query."""
    if text is None or is_empty(text):
        return "empty", False, "", []
    query = query or ""
    gone = GRAMMAR.sub("\n", text)
    program = has_program(gone)
    if query and not program and repeats(query, text):
        return "copy", False, "", []
    if field == "gold":
        return ("truncated" if stops_early(text) else None), False, "", []
    if field == "prediction":
        if OPEN_GRAMMAR.search(text):
            return "truncated", False, "", []
        if not program and is_empty(gone):
            return "empty", False, "", []
        if program:
            lines = [x for x in without_query(FENCED.sub("\n", gone).split("\n"), query) if not has_program(x)]
            around = [mask(x, query) for x in lines if tokens(x)]
            if stops_early(gone):
                return "truncated", False, "", around
            return ("language" if query and other(query, "\n".join(lines)) else None), False, "", around
    spoken = FENCED.sub(lambda m: "\n" if "::=" in m.group() else m.group(), text)
    units = [u for u in UNITS.split(MARKUP.sub(" ", spoken)) if tokens(u)]
    inner = [mask(u, query) for u in units]
    if field == "prediction":
        late = "truncated" if is_open(gone) or re.search(r"(?:\.\.\.|…)\W*$", text) else None
    else:
        late = "truncated" if breaks_off(text) else None
    prose = "\n".join(without_query([x for x in spoken.split("\n") if "::=" not in x], query))
    if late is None and query and other(query, prose):
        late = "language"
    if field == "grammar_cot" and ("::=" in text or '"' in text or not text.isupper() and RULE_NAME.search(text)):
        return late, False, "", inner
    return late, True, max(inner[:2], key=len, default=""), inner


def read(batches: Iterator[pd.DataFrame], speech: Speech) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [judge(f, q, t, speech.other) for f, q, t in zip(b["field"], b["query"], b["text"])]
        cols = list(zip(*out)) or [()] * 4
        yield pd.DataFrame({"pred_id": b["pred_id"], "field": b["field"], "prompt": b["prompt"], "defect": cols[0], "candidate": cols[1], "opening": cols[2], "inner": cols[3]})


def spoken(texts: DataFrame) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """Texts of each language of texts(lang, text), and in how many of them the words at each place stand; PLACES rows of a language are collected at most."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    places = F.array_distinct(F.transform(found, lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(PLACES))))
    sizes, counts = {}, {}
    marked = F.when(F.size(places) > 0, F.concat(places, F.array(F.lit(-1).cast("bigint"))))  # a text itself counts at -1
    for r in texts.select("lang", F.explode(marked).alias("place")).groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["place"] < 0:
            sizes[r["lang"]] = r["n"]
        else:
            counts.setdefault(r["lang"], np.zeros(PLACES))[r["place"]] = r["n"]
    return sizes, counts


def languages(texts: DataFrame, queries: DataFrame) -> Speech:
    """Learned from texts(text, lang), of which about LABELLED are drawn by a hash, and then also from the different queries(text) whose language these tell for sure."""
    known = texts.filter("text is not null and lang is not null").select("lang", "text")
    known = known.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, known.count()))) < LABELLED)
    sources = [spoken(known)]
    if len(sources[0][0]) < 2:
        return Speech(*sources)
    asked = checkpointed(queries.filter("text is not null").distinct())
    for _ in range(ROUNDS):
        speech = texts.sparkSession.sparkContext.broadcast(Speech(*sources))

        def tell(batches: Iterator[pd.DataFrame], speech=speech) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(speech.value.names[k], q) for q in b["text"] for k, sure in [speech.value.asks(q)] if sure > SURE]
                yield pd.DataFrame(rows, columns=["lang", "text"])

        sources[1:] = [spoken(asked.mapInPandas(tell, "lang string, text string"))]
    return Speech(*sources)


def shingles(opening: str) -> set[str]:
    w = opening.split()
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(opening, mark): each opening's shingles as 64 bits of a hash."""
    import xxhash

    for b in batches:
        rows = [(o, xxhash.xxh64_intdigest(x) - (1 << 63)) for o in b["opening"] for x in shingles(o)]
        yield pd.DataFrame(rows, columns=["opening", "mark"])


def marked(openings: DataFrame) -> DataFrame:
    """(opening, marks, mark): a row for each shingle of an opening that must be looked at. Two of n and more shingles that are alike share ALIKE * n at least, so in any common order, rare ones first here, one of the first that are left without so many and one more."""
    each = checkpointed(openings.select("opening").distinct().mapInPandas(hashed, "opening string, mark bigint").distinct())
    uses = each.groupBy("mark").agg(F.count(F.lit(1)).alias("uses"))
    ordered = each.join(uses, "mark").groupBy("opening").agg(F.array_sort(F.collect_list(F.struct("uses", "mark")))["mark"].alias("marks"))
    first = F.size("marks") - F.ceil(F.lit(ALIKE) * F.size("marks")).cast("int") + 1
    return checkpointed(ordered.select("opening", "marks", F.explode(F.slice("marks", F.lit(1), first)).alias("mark")))


def alike(x: str, y: str):
    """Whether two columns of different shingles have a similarity of ALIKE."""
    n, m = F.size(x), F.size(y)
    may = F.least(n, m) >= F.lit(ALIKE) * F.greatest(n, m)
    return may & let(F.size(F.array_intersect(x, y)), lambda both: both >= F.lit(ALIKE) * (n + m - both))


def links(openings: DataFrame) -> DataFrame:
    """(a, b) of openings that are alike; a pair alike is left out only if others given join the two. First each opening is compared with one of those that share a shingle with it, drawn anew for each shingle, so that openings that are all alike cost their number of rows; then all that share one and aren't joined yet are compared, in blocks."""
    shared = marked(openings)
    heads = shared.groupBy("mark").agg(F.min_by(F.struct("opening", "marks"), F.struct(F.xxhash64("opening", "mark"), "opening")).alias("head"))
    drawn = shared.join(heads, "mark").filter(F.col("opening") != F.col("head.opening")).filter(alike("marks", "head.marks"))
    found = checkpointed(drawn.select(F.least("opening", "head.opening").alias("a"), F.greatest("opening", "head.opening").alias("b")).distinct())
    named = shared.join(components(openings, found), "opening")
    apart = named.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("least"), F.max("head").alias("most")).filter("least <> most")
    blocks = F.ceil(F.col("n") / BLOCK)
    rest = checkpointed(named.join(apart.select("mark", blocks.alias("blocks")), "mark").withColumn("block", F.pmod(F.xxhash64("opening"), F.col("blocks"))))
    side = lambda x, lists, i, j: rest.select("mark", F.struct("opening", "marks", "head").alias(x), F.col("block").alias(i), F.explode(lists).alias(j))
    left = side("x", F.sequence("block", F.col("blocks") - 1), "i", "j")
    right = side("y", F.sequence(F.lit(0).cast("bigint"), "block"), "j", "i")
    pairs = left.join(right, ["mark", "i", "j"]).filter("x.head <> y.head and (i < j or x.opening < y.opening)").filter(alike("x.marks", "y.marks"))
    return found.union(pairs.select(F.least("x.opening", "y.opening"), F.greatest("x.opening", "y.opening")).distinct())


def components(openings: DataFrame, found: DataFrame) -> DataFrame:
    """(opening, head): connected components of distinct openings along the links found(a, b), named by their least member. Least names are handed along the links, and names along themselves, until nothing changes."""
    both = checkpointed(found.union(found.select("b", "a")).distinct())
    state = openings.select("opening", F.col("opening").alias("head"))
    while True:
        near = both.join(state.select(F.col("opening").alias("b"), "head"), "b").groupBy(F.col("a").alias("opening")).agg(F.min("head").alias("near"))
        step = state.join(near, "opening", "left").select("opening", F.col("head").alias("was"), F.least("head", "near").alias("head"))
        up = step.select(F.col("opening").alias("head"), F.col("head").alias("top"))
        new = checkpointed(step.join(up, "head").select("opening", "was", F.least("head", "top").alias("head")))
        state = new.select("opening", "head")
        if new.filter("head <> was").isEmpty():
            return state


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, head): components of distinct openings whose pairs alike are linked."""
    return components(openings, links(openings))


def fields(predictions: DataFrame) -> DataFrame:
    """(pred_id, field, query, prompt, text), a row for each field that is a case."""
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("prediction", "gold", "grammar_cot")])
    rows = predictions.select("pred_id", "query", "mode", F.xxhash64("query").alias("prompt"), F.explode(kinds).alias("x"))
    return rows.filter((F.col("x.field") != "grammar_cot") | F.col("mode").isin(*REASONED)).select("pred_id", "x.field", "query", "prompt", "x.text")


def templates(seen: DataFrame) -> DataFrame:
    """(opening, refusal): openings of recurring clusters, and whether these seldom stand inside reasoning."""
    uses = checkpointed(seen.filter("candidate").select("opening", "prompt").distinct().groupBy("opening").agg(F.count(F.lit(1)).alias("prompts")))
    headed = clusters(uses).join(uses, "opening")
    inner = seen.filter("not candidate").select(F.explode("inner").alias("opening")).groupBy("opening").agg(F.count(F.lit(1)).alias("inner_uses"))
    sums = headed.join(inner, "opening", "left").groupBy("head").agg(F.sum("prompts").alias("prompts"), F.coalesce(F.sum("inner_uses"), F.lit(0)).alias("inner_uses"))
    recurring = sums.filter(F.col("prompts") >= PROMPTS).select("head", (F.col("inner_uses") * 2 < F.col("prompts")).alias("refusal"))
    return headed.select("opening", "head").join(recurring, "head").select("opening", "refusal")


def buckets(unit):
    """Places of the different words and pairs of words of a masked sentence."""
    w = F.filter(F.split(unit, " "), lambda x: (x != "_") & (x != ""))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.array_distinct(F.transform(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))), lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))


def weights(taught: DataFrame) -> DataFrame:
    """(bucket, weight) of taught(refusal, inner): how much a word or pair tells for a refusal, the logarithm of its share on that side over its share on the other. At most BUCKETS rows; none where a side is empty."""
    each = taught.select("refusal", F.explode("inner").alias("unit")).select("refusal", F.explode(buckets(F.col("unit"))).alias("bucket"))
    n = checkpointed(each.groupBy("bucket").agg(F.count_if("refusal").alias("p"), F.count_if(~F.col("refusal")).alias("q")))
    all_ = n.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    pooled = (F.col("p") + F.col("q")) / (F.col("all_p") + F.col("all_q"))
    side = lambda c: (F.col(c) / F.col(f"all_{c}") + SMOOTH * pooled) / (1 + SMOOTH)
    told = F.log(side("p") / side("q"))
    return n.join(F.broadcast(all_), F.lit(True)).filter("all_p > 0 and all_q > 0").select("bucket", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), told)).alias("weight"))


def refusals(seen: DataFrame) -> DataFrame:
    """(pred_id, field, defect, refused) of the candidates."""
    open_ = seen.filter("candidate").select("pred_id", "field", "defect", "opening", "inner")
    marked = checkpointed(open_.join(templates(seen), "opening", "left"))
    taught = marked.filter("refusal is not null").select("refusal", "inner").union(seen.filter("not candidate").select(F.lit(False), "inner"))
    words = marked.select("pred_id", "field", F.explode("inner").alias("unit")).select("pred_id", "field", F.explode(buckets(F.col("unit"))).alias("bucket"))
    score = words.join(F.broadcast(weights(taught)), "bucket").groupBy("pred_id", "field").agg(F.sum("weight").alias("score"))
    # how often templates of a field are refusals; a row for each field
    before = marked.groupBy("field").agg(F.log((F.count_if("refusal") + 1) / (F.count_if(~F.col("refusal")) + 1)).alias("before"))
    # sums in any order may differ in the last digits only; what tells nothing has no row
    told = F.round(F.col("before") + F.coalesce("score", F.lit(0.0)), 6)
    bare = (F.col("field") == "prediction") & F.coalesce(F.col("defect") != "truncated", F.lit(True))
    refused = F.when(bare, told >= -LEEWAY).otherwise(told > 0)
    scored = marked.join(F.broadcast(before), "field").join(score, ["pred_id", "field"], "left")
    return scored.select("pred_id", "field", "defect", refused.alias("refused"), told.alias("score"))


def defects(predictions: DataFrame, texts: DataFrame) -> DataFrame:
    """(pred_id, field, defect) of predictions(pred_id, mode, query, prediction, gold, grammar_cot); texts(text, lang) teach the languages."""
    kind = predictions.schema["pred_id"].dataType.simpleString()
    speech = predictions.sparkSession.sparkContext.broadcast(languages(texts, predictions.select(F.col("query").alias("text"))))  # PLACES numbers of each language
    shape = f"pred_id {kind}, field string, prompt bigint, defect string, candidate boolean, opening string, inner array<string>"
    seen = checkpointed(fields(predictions).mapInPandas(lambda b: read(b, speech.value), shape))
    told = refusals(seen).select("pred_id", "field", F.when(F.col("refused"), F.lit("refusal")).otherwise(F.col("defect")).alias("defect"))
    return seen.filter("not candidate").select("pred_id", "field", "defect").union(told).filter("defect is not null")


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "predictions").select("pred_id", "run_id", "dataset", "mode", "query", "prediction", "gold", "grammar_cot"), "pred_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text", "lang")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(load(spark, sf_dir), labelled(spark, sf_dir))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of each run, dataset and mode."""
    rows = load(spark, sf_dir)
    found = defects(rows, labelled(spark, sf_dir))
    return found.join(rows.select("pred_id", "run_id", "dataset", "mode"), "pred_id").groupBy("run_id", "dataset", "mode", "field", "defect").agg(F.count(F.lit(1)).alias("rows_with"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLES: dict[str, str] = {}
