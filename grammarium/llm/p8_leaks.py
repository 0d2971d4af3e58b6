"""Evaluation texts that leak into a corpus: spaced-seed hashing.

A seed is a window of SPAN words of which a fixed mask reads some places and
ignores the others, so a window still meets its copy when the ignored words were
changed. Windows of test items and of documents are joined by (mask, hash), and
each hit is verified on the words around it, along the diagonal of the hit: the
longest run of equal words and the longest stretch of at least 80 % equal words
that starts and ends with equal words.

The item side is broadcast only if it is counted to be small, else both sides are
shuffled. Null or blank texts share nothing; texts of under SPAN words can't leak;
repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import let, small_or_shuffled, table, unique, words

SPAN, RUN, TOLERANCE = 10, 10, 0.8
#: 1: the word is read; 0: it is ignored. Any window that is equal throughout meets under each mask.
MASKS = ("1111001111", "1100111011")


def seeds(texts: DataFrame, key: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key, place, seed) of texts(key, w): a row for each window and mask."""
    read = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    codes = F.transform("w", lambda x: F.xxhash64(x))
    windows = let(
        codes,
        lambda c: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(c) - F.lit(SPAN)),
                lambda i: F.array(*[F.struct(i.alias("place"), F.xxhash64(F.lit(m), *[F.get(c, i + F.lit(k)) for k in at]).alias("seed")) for m, at in enumerate(read)]),
            )
        ),
    )
    return texts.filter(F.size("w") >= SPAN).select(key, F.explode(windows).alias("s")).select(key, "s.place", "s.seed")


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Along one diagonal: the longest run of equal words, and the longest stretch with TOLERANCE equal words."""
    a, b = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[a:b] == item[a - shift : b - shift]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    run = int((edge[1::2] - edge[::2]).max(initial=0))
    # stretches whose balance of equal words over the tolerance doesn't fall below zero
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    score = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - TOLERANCE, -TOLERANCE))))
    low = np.minimum.accumulate(np.where(np.concatenate((same, [False])), score, np.inf)[:-1])  # least prefix that starts with an equal word
    best = 0
    starts = {}
    for i in at:  # a diagonal is no longer than an item
        if np.isfinite(low[i]) and low[i] not in starts:
            starts[low[i]] = i
    order = sorted(starts.items())
    for j in at[::-1]:
        first = min((i for s, i in order if s <= score[j + 1] + 1e-9 and i <= j), default=None)
        if first is not None:
            best = max(best, int(j - first + 1))
    return run, best


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, item, shifts in zip(batch["dw"], batch["iw"], batch["shifts"]):
            found = [overlap(doc, item, int(s)) for s in shifts]
            out.append((max(r for r, _ in found), max(t for _, t in found)))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "item_id": batch["item_id"], "run": [r for r, _ in out], "tolerant": [t for _, t in out]})


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, tolerant) of docs(doc_id, text) and items(item_id, item_text) whose windows meet under a mask."""
    docs = docs.select("doc_id", words(F.col("text")).alias("w"))  # already spread by doc_id, as rows of one id were brought together
    items = items.select("item_id", words(F.col("item_text")).alias("w"))
    item_seeds = small_or_shuffled(seeds(items, "item_id").withColumnRenamed("place", "item_place"))
    hits = seeds(docs, "doc_id").join(item_seeds, "seed")
    diagonals = hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    code = lambda name: F.transform("w", lambda x: F.xxhash64(x)).alias(name)
    pairs = diagonals.join(docs.select("doc_id", code("dw")), "doc_id").join(small_or_shuffled(items.select("item_id", code("iw"))), "item_id")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.mapInPandas(verify, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, run int, tolerant int")


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = unique(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs, unique(table(spark, sf_dir, "heldout_items").select("item_id", "item_text"), "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(*load(spark, sf_dir)).filter(F.col("run") >= RUN).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that they hold passages of, with the longest run of equal words and the longest stretch with changed words; a stretch that holds no window that a mask reads may be missed."""
    return leaks(*load(spark, sf_dir)).filter(F.col("tolerant") >= RUN)


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item with the documents that give it away, whole or with changed words, and its largest share of words found in one of them."""
    docs, items = load(spark, sf_dir)
    found = leaks(docs, items).filter(F.col("tolerant") >= RUN)
    sizes = items.select("item_id", F.coalesce(F.size(words(F.col("item_text"))), F.lit(0)).alias("n_words"))
    report = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("run") >= RUN).alias("exact_documents"), F.max("tolerant").alias("longest"))
    share = F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.coalesce("longest", F.lit(0)) / F.col("n_words")))
    return sizes.join(report, "item_id", "left").select(
        "item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("exact_documents", F.lit(0)).alias("exact_documents"), share.alias("largest_share")
    )


QUERIES = {"p8_found": p8_found, "p8_overlaps": p8_overlaps, "p8_leaked_items": p8_leaked_items}
ORACLES = {
    "p8_found": """
WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT ON (item_id) item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM heldout_items WHERE item_text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 8, 1))) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 1))) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
}
