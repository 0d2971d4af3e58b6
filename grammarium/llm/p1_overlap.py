"""Same or nearly the same records across splits: winnowing fingerprints.

The words of a record's query and program are read as two sequences. A gram starts
at each word and reaches on to the first word that isn't common (and over two words
at least), so grams of nothing but stock phrases don't arise; of each WINDOW grams
in a row the one with the least hash is a fingerprint. A run of equal words that
holds WINDOW grams therefore gives both records a fingerprint in common.
Fingerprints of train rows are joined with those of the other splits; hits are
chained along the two texts, chains are extended by alignment, and the share of
words so covered is reported. Pairs of p1_found are kept by the share of common
words in both fields.

Equal texts are joined once and stand for all their rows: rows whose queries and
programs have equal words form a class, and only pairs of classes are compared.
Common words are those in more than 1/COMMON of the classes, so at most COMMON
times a record's words; they are the only thing that is collected.

Rows with a null query or program have no partner; texts without words are alike
to nothing; rows of one example_id count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, spread, table, unique, words

WINDOW, LEAST_WORDS, COMMON, ALIKE = 3, 2, 200, 0.8
#: Rows of a class that one task expands at a time.
BLOCK = 2_000
FIELDS = ("query", "program")


def grams(sequence: list[str], common: frozenset[str]) -> list[str]:
    """The gram that starts at each place; none where only common words follow, unless there is no other word at all."""
    n, out, end = len(sequence), [], None
    rare_at = [None] * (n + 1)
    for i in range(n - 1, -1, -1):
        rare_at[i] = i if sequence[i] not in common else rare_at[i + 1]
    if n and rare_at[0] is None:
        return [" ".join(sequence)]
    for i in range(n):
        if rare_at[i] is None:
            break
        end = min(n, max(i + LEAST_WORDS, rare_at[i] + 1))
        out.append(" ".join(sequence[i:end]))
    return out


def winnow(sequence: list[str], common: frozenset[str], field: str) -> list[tuple[int, int]]:
    """(place, hash) of the grams that are least in some window; of equal ones the last."""
    found = grams(sequence, common)
    if not found:
        return []
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(f"{field}\t{g}") for g in found), np.uint64, len(found))
    w = min(WINDOW, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(len(views)) + (w - 1 - np.argmin(views[:, ::-1], axis=1)))
    return [(int(i), int(h[i].astype(np.int64))) for i in at]


def fingerprints(classes: DataFrame, common: frozenset[str]) -> DataFrame:
    """(class, field, place, print) of classes(class, query_w, program_w)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, f, place, h) for c, q, p in zip(b["class"], b["query_w"], b["program_w"]) for f, s in (("query", q), ("program", p)) for place, h in winnow(list(s), common, f)]
            yield pd.DataFrame(rows, columns=["class", "field", "place", "print"])

    return classes.select("class", "query_w", "program_w").mapInPandas(run, "class bigint, field string, place int, print bigint")


def common_words(classes: DataFrame) -> frozenset[str]:
    """Words in more than 1/COMMON of the classes: at most COMMON times the mean number of words of a class."""
    n = classes.count()
    df = classes.select(F.explode(F.array_distinct(F.concat("query_w", "program_w"))).alias("word")).groupBy("word").count()
    return frozenset(r["word"] for r in df.filter(F.col("count") * COMMON > n).select("word").collect()) if n >= COMMON else frozenset()


def share(a: Column, b: Column) -> Column:
    """Common words over all words of two arrays of distinct words."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def bits(words: Column) -> Column:
    """64 bits that mark the words of an array: one of them for each."""
    one = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(one(w)))


class Overlap:
    """Classes of equal records, and the pairs of a train class and a class of another split that share fingerprints."""

    def __init__(self, examples: DataFrame):
        """examples: example_id, split, query, program."""
        usable = examples.filter(F.col("query").isNotNull() & F.col("program").isNotNull())
        rows = usable.select("example_id", (F.col("split") == "train").alias("train"), words(F.col("query")).alias("query_w"), words(F.col("program")).alias("program_w"))
        text = F.concat_ws(" ", F.array_join("query_w", " "), F.lit("|"), F.array_join("program_w", " "))
        # the class is named by 64 bits of its text's hash; two texts of one name would differ in `share` below only if the hash collided
        self.rows = checkpointed(rows.withColumn("class", F.xxhash64(text, F.lit(1))))
        firsts = self.rows.groupBy("class").agg(F.first("query_w").alias("query_w"), F.first("program_w").alias("program_w"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_other"))
        for f in FIELDS:
            w = F.array_distinct(f"{f}_w")
            firsts = firsts.withColumn(f"{f}_n", F.size(w)).withColumn(f"{f}_bits", bits(w))
        self.classes = checkpointed(firsts)
        self.common = common_words(self.classes)
        marks = [f"{f}_{m}" for f in FIELDS for m in ("n", "bits")]
        prints = checkpointed(fingerprints(spread(self.classes, "class"), self.common).join(self.classes.select("class", "in_train", "in_other", *marks), "class"))
        side = lambda name: prints.filter(f"in_{name}").select("field", "print", F.col("class").alias(f"{name}_class"), F.col("place").alias(f"{name}_place"), *[F.col(m).alias(f"{name}_{m}") for m in marks])
        hits = side("train").join(side("other"), ["field", "print"])
        seed = F.struct("field", "other_place", "train_place")
        self.hits = hits
        self.seeded = hits.groupBy("train_class", "other_class").agg(F.collect_set(seed).alias("seeds"))

    def near(self) -> DataFrame:
        """Hits of pairs that may be alike: two sets of a and b words that share 0.8 of all differ in (a + b) / 9 words at most, so their marks differ in no more bits."""
        most = (1 - ALIKE) / (1 + ALIKE)
        fits = lambda f: F.bit_count(F.col(f"train_{f}_bits").bitwiseXOR(F.col(f"other_{f}_bits"))) <= (F.col(f"train_{f}_n") + F.col(f"other_{f}_n")) * most + 1e-9
        return self.hits.filter(fits("query") & fits("program"))

    def pairs(self, seeds: bool = True) -> DataFrame:
        """(train_class, other_class, seeds, query and program words of both, query_share, program_share); without the seeds where these aren't asked for."""
        side = lambda name: self.classes.select(F.col("class").alias(f"{name}_class"), F.col("query_w").alias(f"{name}_query"), F.col("program_w").alias(f"{name}_program"))
        found = self.seeded if seeds else self.near().select("train_class", "other_class").distinct()
        both = found.join(side("train"), "train_class").join(side("other"), "other_class")
        for f in FIELDS:
            both = both.withColumn(f"{f}_share", share(F.array_distinct(f"train_{f}"), F.array_distinct(f"other_{f}")))
        return both

    def alike(self) -> DataFrame:
        return self.pairs(False).filter((F.col("query_share") >= ALIKE) & (F.col("program_share") >= ALIKE)).select("train_class", "other_class")

    def row_pairs(self) -> DataFrame:
        """(train_id, other_id) of all pairs of alike classes. Large classes are cut into blocks, each of which is expanded on its own."""
        place = F.pmod(F.xxhash64("example_id"), F.col("blocks")).cast("int")
        sizes = self.rows.groupBy("class", "train").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        members = self.rows.select("class", "train", "example_id").join(sizes, ["class", "train"]).withColumn("block", place)
        blocks = lambda train, name: sizes.filter(F.col("train") == train).select(F.col("class").alias(f"{name}_class"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"{name}_block"))
        side = lambda train, name: members.filter(F.col("train") == train).select(F.col("class").alias(f"{name}_class"), F.col("block").alias(f"{name}_block"), F.col("example_id").alias(f"{name}_id"))
        tiles = self.alike().join(blocks(True, "train"), "train_class").join(blocks(False, "other"), "other_class")
        return tiles.join(side(True, "train"), ["train_class", "train_block"]).join(side(False, "other"), ["other_class", "other_block"]).select("train_id", "other_id")


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest series of seeds that rises in both texts."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    import bisect

    for i, (_, t) in enumerate(seeds):
        k = bisect.bisect_left(tails, t)
        if k == len(tails):
            tails.append(t)
            at.append(i)
        else:
            tails[k], at[k] = t, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def extend(a: list[str], b: list[str], seeds: list[tuple[int, int]], slack: int = 2) -> int:
    """Words of `a` that stand in `b` along the chain: from each seed both ways over equal words and over up to `slack` changed ones before an equal one."""
    covered: set[int] = set()
    for i, j in chain(seeds):
        for step in (1, -1):
            x, y = (i, j) if step == 1 else (i - 1, j - 1)
            while 0 <= x < len(a) and 0 <= y < len(b):
                if a[x] == b[y]:
                    covered.add(x)
                    x, y = x + step, y + step
                    continue
                skips = [(p, q) for d in range(1, 2 * slack + 1) for p in range(min(d, slack) + 1) if (q := d - p) <= slack]
                hop = next(((p, q) for p, q in skips if 0 <= x + step * p < len(a) and 0 <= y + step * q < len(b) and a[x + step * p] == b[y + step * q]), None)
                if hop is None:
                    break
                x, y = x + step * hop[0], y + step * hop[1]
    return len(covered)


def coverage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for seeds, *texts in zip(b["seeds"], b["other_query"], b["train_query"], b["other_program"], b["train_program"]):
            of = lambda f: [(s["other_place"], s["train_place"]) for s in seeds if s["field"] == f]
            q = extend(list(texts[0]), list(texts[1]), of("query"))
            p = extend(list(texts[2]), list(texts[3]), of("program"))
            out.append((q / max(1, len(texts[0])), p / max(1, len(texts[2]))))
        yield pd.DataFrame({"other_class": b["other_class"], "query_covered": [q for q, _ in out], "program_covered": [p for _, p in out]})


def load(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return unique(table(spark, sf_dir, "examples").select("example_id", "split", "query", "program", *more), "example_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = Overlap(load(spark, sf_dir)).row_pairs()
    return ids.select(F.least("train_id", "other_id").alias("example_a"), F.greatest("train_id", "other_id").alias("example_b"))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each valid and test row, with its split, dataset and source: the largest shares of its query's and its program's words that one train row's chain covers."""
    examples = load(spark, sf_dir, "dataset", "source")
    found = Overlap(examples)
    covered = found.pairs().select("other_class", "seeds", "other_query", "train_query", "other_program", "train_program").mapInPandas(coverage, "other_class bigint, query_covered double, program_covered double")
    best = covered.groupBy("other_class").agg(F.max("query_covered").alias("query_covered"), F.max("program_covered").alias("program_covered"), F.max(F.least("query_covered", "program_covered")).alias("both_covered"))
    rows = found.rows.filter("not train").select("example_id", F.col("class").alias("other_class"))
    none = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    parts = rows.join(best, "other_class", "left").select("example_id", none("query_covered"), none("program_covered"), none("both_covered"))
    return parts.join(examples.select("example_id", "split", "dataset", "source"), "example_id")


def p1_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, dataset and source: rows, the mean share of words that train rows cover, and rows covered for the most part."""
    return p1_coverage(spark, sf_dir).groupBy("split", "dataset", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("both_covered").alias("mean_covered"), F.count_if(F.col("both_covered") >= ALIKE).alias("mostly_covered"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, dataset and source: rows, rows with a partner in train, and pairs, from the sizes of the classes."""
    rows = load(spark, sf_dir, "dataset", "source")
    found = Overlap(rows)
    sizes = found.rows.filter("train").groupBy(F.col("class").alias("train_class")).agg(F.count(F.lit(1)).alias("n"))
    partners = found.alike().join(sizes, "train_class").groupBy(F.col("other_class").alias("class")).agg(F.sum("n").alias("partners"))
    of_row = found.rows.filter("not train").select("example_id", "class").join(partners, "class")
    return (
        rows.filter("split <> 'train'")
        .join(of_row.select("example_id", "partners"), "example_id", "left")
        .groupBy("split", "dataset", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))
    )


PAIRS_SQL = """
WITH e AS (SELECT DISTINCT ON (example_id) example_id, split, dataset, source, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(program), '[a-z0-9]+')) AS p, query IS NOT NULL AND program IS NOT NULL AS usable FROM examples),
pairs AS (SELECT t.example_id AS t, o.example_id AS o FROM e t JOIN e o ON t.split = 'train' AND o.split <> 'train' AND t.usable AND o.usable
 WHERE len(list_intersect(t.q, o.q)) >= 0.8 * (len(t.q) + len(o.q) - len(list_intersect(t.q, o.q))) AND len(list_intersect(t.p, o.p)) >= 0.8 * (len(t.p) + len(o.p) - len(list_intersect(t.p, o.p)))
 AND len(t.q) > 0 AND len(t.p) > 0)
"""
QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p1_source_coverage": p1_source_coverage, "p1_report": p1_report}
ORACLES = {
    "p1_found": PAIRS_SQL + "SELECT least(t, o) AS example_a, greatest(t, o) AS example_b FROM pairs",
    "p1_report": PAIRS_SQL + "SELECT split, dataset, source, count(*) AS n_rows, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM e LEFT JOIN (SELECT o AS example_id, count(*) AS n FROM pairs GROUP BY o) USING (example_id) WHERE split <> 'train' GROUP BY ALL",
}
