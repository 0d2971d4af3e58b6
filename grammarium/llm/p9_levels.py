"""Reading level of each document: coverage rank of its vocabulary and complexity of its sentences.

Words of all English documents are ranked by frequency. A document's coverage rank
at a share is the least r such that its words among the r most frequent ones make
up that share of its tokens; plain texts are covered by few frequent words. With
the lengths of sentences and words and the number of commas these ranks are
calibrated on rated documents: a multinomial logistic model of the features and
their squares, fitted on at most LABELS rated documents and applied as SQL.

No list of words is given. Only prose counts: fenced or indented code, headings,
footers and sentences that carry code are left out; where nothing remains the whole
text counts as one sentence. Only English words are ranked, those that are relatively
no less frequent in the documents marked en than in those of other languages, but all
of these: the ranks are a table that is joined, broadcast only if it is weighed to be
small. Words of equal frequency share the least rank; capitalised ones have none.

Documents that aren't marked en or have under LEAST_WORDS words get no row; without
any rated document the level is null. Repeated rows and ratings count once; the
ratings of one document are averaged, halves rounded up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import checkpointed, let, small_or_shuffled, table, unique, words

LANG, LEAST_WORDS, LABELS = "en", 40, 20_000
SHARES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Binary logarithm of the rank of a word where a text has none that is ranked.
NO_RANK = 20.0

FENCE, ASIDE = r"(?s)```.*?(?:```|\z)", r"(?m)^(?:(?: {4}|\t|#|--).*$|[> \t*/-]+)"
CODE = r"[=;{}<|^\[\]()\d]"
END = r"(?<=[.!?])\s*(?=[A-Z\n])|\n{2,}"
WORD = r"([A-Za-z][A-Za-z'-]*)"

FEATURES = [f"cover_{int(100 * s)}" for s in SHARES] + ["mean_rank", "spread_rank", "mean_words", *(f"words_{int(100 * q)}" for q in QUARTILES), "commas", "median_commas", "letters", "median_letters"]


def sentences(text: Column) -> Column:
    """array<struct<w, commas>> of the sentences of `text` without code, or of the whole text where none is left."""
    plain = F.regexp_replace(F.regexp_replace(text, FENCE, "\n\n"), ASIDE, "")
    units = F.filter(F.split(plain, END, -1), lambda s: ~F.rlike(s, F.lit(CODE)))
    parsed = lambda units: F.filter(
        F.transform(units, lambda s: F.struct(F.regexp_extract_all(s, F.lit(WORD), F.lit(1)).alias("w"), (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))).alias("commas"))),
        lambda x: F.size(x["w"]) >= 2,
    )
    return let(parsed(units), lambda c: F.when(F.size(c) > 0, c).otherwise(parsed(F.array(text))))


def prose(docs: DataFrame) -> DataFrame:
    """(doc_id, english, wanted, sents: array<struct<n, commas, letters>>, low) of docs(doc_id, text, lang) with a language: words, commas and mean length of words of each sentence, and all words in small letters."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    english = F.col("lang") == LANG
    parsed = known.select("doc_id", english.alias("english"), (english & (F.size(words(F.col("text"))) >= LEAST_WORDS)).alias("wanted"), sentences(F.col("text")).alias("s"))
    sizes = F.transform("s", lambda x: F.struct(F.size(x["w"]).alias("n"), x["commas"].alias("commas"), (F.length(F.array_join(x["w"], "")) / F.size(x["w"])).alias("letters")))
    low = F.filter(F.flatten(F.transform("s", lambda x: x["w"])), lambda w: (w >= "a") & (w < "{"))
    return checkpointed(parsed.select("doc_id", "english", "wanted", sizes.alias("sents"), low.alias("low")))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, rank) of all English words by their frequency in English documents, as binary logarithms."""
    each = texts.select("english", F.explode("low").alias("word"))
    counts = checkpointed(each.groupBy("word").agg(F.count_if("english").alias("n"), F.count_if(~F.col("english")).alias("foreign")))
    totals = counts.agg(F.sum("n").alias("all_n"), F.sum("foreign").alias("all_foreign"))
    relative = F.col("n") * F.greatest("all_foreign", F.lit(1)) >= F.col("foreign") * F.col("all_n")
    english = counts.join(F.broadcast(totals), F.lit(True)).filter((F.col("n") > 0) & relative).select("word", "n")  # one row of totals
    # there are no more different frequencies than the root of twice the number of tokens, so one task may cumulate them
    before = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = english.groupBy("n").agg(F.count(F.lit(1)).alias("k")).select("n", F.log2(F.coalesce(before, F.lit(0)) + 1).alias("rank"))
    return english.join(ranks, "n").select("word", "rank")


def quantile(ordered: Column, q: float) -> Column:
    """Quantile of a sorted array, between its neighbours in proportion."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return (low + (high - low) * (at - F.floor(at))).cast("double")


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def measured(sents: Column, ranks: Column) -> Column:
    """FEATURES of array<struct<n, commas, letters>> and a sorted array of ranks, as array<double>."""
    column = lambda name: F.array_sort(F.transform(sents, lambda s: s[name].cast("double")))

    def features(r: Column, n: Column, c: Column, m: Column) -> Column:
        cover = [F.get(r, F.greatest(F.lit(0), F.ceil(F.size(r) * F.lit(s)).cast("int") - 1)) for s in SHARES]
        spread = let(mean(r), lambda u: F.sqrt(mean(F.transform(r, lambda x: (x - u) * (x - u)))))
        lengths = [F.log(mean(n)), *(F.log(quantile(n, q)) for q in QUARTILES)]
        return F.array(*cover, mean(r), spread, *lengths, mean(c), quantile(c, 0.5), mean(m), quantile(m, 0.5))

    four = F.struct(ranks.alias("r"), column("n").alias("n"), column("commas").alias("c"), column("letters").alias("m"))
    return let(four, lambda x: features(x["r"], x["n"], x["c"], x["m"]))


def profile(texts: DataFrame) -> DataFrame:
    """(doc_id, f: array<double>) in the order of FEATURES, for the wanted documents."""
    ranks = small_or_shuffled(checkpointed(vocabulary(texts)))
    docs = texts.filter("wanted").select("doc_id", "sents", "low").repartition("doc_id")  # what follows keeps to it where the ranks are broadcast
    tokens = docs.select("doc_id", F.explode("low").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).cast("int").alias("k")).join(ranks, "word")
    held = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "k"))).alias("held"))
    each = F.flatten(F.transform("held", lambda x: F.array_repeat(x["rank"], x["k"])))
    none = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("commas"), F.lit(1.0).alias("letters")))
    sents = F.when(F.size("sents") > 0, F.col("sents")).otherwise(none)
    return docs.select("doc_id", "sents").join(held, "doc_id", "left").select("doc_id", measured(sents, F.coalesce(each, F.array(F.lit(NO_RANK)))).alias("f"))


class Calibration:
    """Multinomial logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 1200, rate: float = 0.5, shrink: float = 1e-3):
        self.levels = np.unique(y)
        self.mean, self.sd = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self.expand(x)
        want = (y[:, None] == self.levels).astype(float)
        self.b = np.zeros((z.shape[1], len(self.levels)))
        for _ in range(rounds):
            s = z @ self.b
            p = np.exp(s - s.max(1, keepdims=True))
            self.b -= rate * (z.T @ (p / p.sum(1, keepdims=True) - want) / len(z) + shrink * self.b)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        return np.c_[z, z**2, np.ones(len(x))]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.levels[(self.expand(x) @ self.b).argmax(1)]

    def sql(self, f: Column) -> Column:
        """The level as a column: a weighted sum for each level, and the level of the largest."""
        lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
        scaled = F.zip_with(F.zip_with(f, lit(self.mean), lambda a, b: a - b), lit(self.sd), lambda a, b: a / b)
        z = F.transform(scaled, lambda a: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), a)))
        k = len(self.mean)
        total = lambda terms, start: F.aggregate(terms, F.lit(start), lambda a, b: a + b)

        def score(z: Column, w: np.ndarray) -> Column:
            linear = total(F.zip_with(z, lit(w[:k]), lambda a, b: a * b), float(w[-1]))
            return linear + total(F.zip_with(z, lit(w[k : 2 * k]), lambda a, b: a * a * b), 0.0)

        each = lambda z: F.array(*[F.struct(score(z, self.b[:, i]).alias("s"), F.lit(int(v)).alias("level")) for i, v in enumerate(self.levels)])
        return let(z, lambda z: F.array_max(each(z)))["level"]


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, level): one level of each rated document."""
    there = labels.filter(F.col("doc_id").isNotNull() & F.col("reading_level").isNotNull())
    return there.distinct().groupBy("doc_id").agg(F.floor(F.avg("reading_level") + 0.5).cast("int").alias("level"))


def levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) of docs(doc_id, text, lang) by labels(doc_id, reading_level, rater)."""
    found = checkpointed(profile(prose(docs)))
    sample = found.join(rated(labels), "doc_id").orderBy(F.xxhash64("doc_id")).limit(LABELS).select("f", "level").toPandas()
    if not len(sample):
        return found.select("doc_id", F.lit(None).cast("int").alias("reading_level"))
    fit = Calibration(np.array(sample["f"].tolist()), sample["level"].to_numpy())
    return found.select("doc_id", fit.sql(F.col("f")).cast("int").alias("reading_level"))


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = unique(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return docs, table(spark, sf_dir, "level_labels").select("doc_id", "reading_level", "rater")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir)
    return levels(docs.select("doc_id", "text", "lang"), labels)


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each level in each source."""
    docs, labels = load(spark, sf_dir)
    found = levels(docs.select("doc_id", "text", "lang"), labels)
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile}
ORACLES: dict[str, str] = {}
