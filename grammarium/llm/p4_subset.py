"""A varied subset of given size: two rounds of lazy greedy facility location.

The objective is the weighted sum, over all rows, of a row's similarity to the
nearest chosen one. Rows with equal texts form one class whose weight grows with
the logarithm of its size, so that copies hardly count. Partitions of PART classes
nominate candidates, SURPLUS times their part of the subset, by lazy greedy; each
candidate takes over the weight of the classes nearest to it. A final greedy pass
over all candidates picks the subset, at every size, in one task; of their matrix of
similarities at most HELD bytes are in memory, other rows are computed when needed.

The subset holds share * (rows) rows, rounded up, but each distinct text at most
once, so it is smaller where there are fewer. Null texts count as empty ones; rows
of one example_id count once; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, grammar_alternatives, spread, table, unique, words

SHARE, PART, SURPLUS = 0.01, 1_500, 3
#: Bytes of similarities that a greedy pass keeps, and rows that it computes at a time.
HELD, ROWS = 256 << 20, 32
DIM = 96


def embed(tokens: list[str]) -> np.ndarray:
    """Signed hashing of tokens into DIM numbers, of length 1."""
    import xxhash

    v = np.zeros(DIM, np.float32)
    for t in set(tokens):
        h = xxhash.xxh64_intdigest(t)
        v[h % DIM] += 1 if (h >> 32) & 1 else -1
    return v / max(float(np.linalg.norm(v)), 1e-9)


NAME = re.compile(r'"[^"]*"')


def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        raw = [np.concatenate((embed(list(q)), embed([f"{m['name']}={m['alt']}" for m in g] + [f"{m['name']}:{NAME.sub('_', m['alt'])}" for m in g]))).astype(np.float32).tobytes() for q, g in zip(b["q"], b["g"])]
        yield pd.DataFrame({"class": b["class"], "id": b["id"], "weight": b["weight"], "raw": raw})


class Similarities:
    """Rows of the matrix of similarities of x, none below 0; the latest used ones are kept, as many as fit into `held` bytes."""

    def __init__(self, x: np.ndarray, held: int):
        self.x, self.room = x, max(ROWS, held // (4 * max(1, len(x))))
        self.kept: dict[int, np.ndarray] = {}

    def gains(self, weight: np.ndarray) -> np.ndarray:
        """First gain of each row."""
        if len(self.x) <= self.room:
            s = np.maximum(self.x @ self.x.T, 0)
            self.kept = dict(enumerate(s))
            return weight @ s
        return np.concatenate([weight @ np.maximum(self.x @ self.x[i : i + ROWS].T, 0) for i in range(0, len(self.x), ROWS)])

    def row(self, i: int, soon: list[int]) -> np.ndarray:
        """Row i; if it has to be computed, those that are needed soon are computed with it."""
        if i not in self.kept:
            new = [j for j in soon[: ROWS - 1] if j not in self.kept] + [i]
            for j in list(self.kept)[: max(0, len(self.kept) + len(new) - self.room)]:
                del self.kept[j]
            self.kept |= zip(new, map(np.copy, np.maximum(self.x[new] @ self.x.T, 0)))
        self.kept[i] = self.kept.pop(i)
        return self.kept[i]


def lazy_greedy(x: np.ndarray, weight: np.ndarray, k: int, held: int = HELD) -> tuple[list[int], np.ndarray]:
    """Places of the k chosen rows of x in their order, and the place of the chosen row nearest to each row."""
    s = Similarities(x, held)
    best, nearest = np.zeros(len(x), np.float32), np.zeros(len(x), int)
    heap = [(-float(g), i) for i, g in enumerate(s.gains(weight))]
    heapq.heapify(heap)
    chosen: list[int] = []
    fresh: dict[int, int] = {}
    while heap and len(chosen) < k:
        gain, i = heapq.heappop(heap)
        row = s.row(i, [j for _, j in heap[: ROWS - 1]])
        if fresh.get(i, 0) < len(chosen):  # gains only fall, so a renewed one that still leads is the largest
            fresh[i] = len(chosen)
            heapq.heappush(heap, (-float(weight @ np.maximum(row - best, 0)), i))
            continue
        closer = row > best
        closer[i] = True
        nearest[closer] = i
        best = np.maximum(best, row)
        chosen.append(i)
        del s.kept[i]
    return chosen, nearest


def unpack(raw: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, 2 * DIM)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def subset(rows: DataFrame, size: int) -> DataFrame:
    """(example_id, gain_rank) of rows(example_id, query, minimal_grammar)."""
    spark = rows.sparkSession
    texts = rows.select("example_id", words(F.coalesce("query", F.lit(""))).alias("q"), grammar_alternatives(F.coalesce("minimal_grammar", F.lit(""))).alias("g"))
    named = texts.withColumn("class", F.xxhash64("q", "g"))
    classes = named.groupBy("class").agg(F.min("example_id").alias("id"), F.first("q").alias("q"), F.first("g").alias("g"), F.log2(F.count(F.lit(1)) + 1).alias("weight"))
    ready = checkpointed(spread(classes).mapInPandas(vectors, "class bigint, id bigint, weight double, raw binary"))
    n = ready.count()
    if not n or size <= 0:
        return spark.createDataFrame([], "example_id bigint, gain_rank int")
    parts = ceil(n / PART)

    def nominate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        w = part["weight"].to_numpy()
        want = min(len(part), ceil(SURPLUS * size * len(part) / n))
        chosen, nearest = lazy_greedy(unpack(part["raw"]), w.astype(np.float32), want)
        held = np.bincount(nearest, weights=w, minlength=len(part))
        return pd.DataFrame({"id": part["id"].to_numpy()[chosen], "weight": held[chosen], "raw": part["raw"].to_numpy()[chosen]})

    candidates = checkpointed(ready.withColumn("part", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(parts))).groupBy("part").applyInPandas(nominate, "id bigint, weight double, raw binary"))

    def choose(every: pd.DataFrame) -> pd.DataFrame:
        every = every.sort_values("id")
        chosen, _ = lazy_greedy(unpack(every["raw"]), every["weight"].to_numpy().astype(np.float32), size)
        return pd.DataFrame({"example_id": every["id"].to_numpy()[chosen], "gain_rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return candidates.groupBy().applyInPandas(choose, "example_id bigint, gain_rank int")


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique(table(spark, sf_dir, "examples").select("example_id", "split", "query", "minimal_grammar", "dataset"), "example_id").filter("split = 'train'")
    picked = subset(rows, ceil(rows.count() * SHARE))
    return picked.join(rows.select("example_id", "dataset"), "example_id")


QUERIES = {"p4_subset": p4_subset}
ORACLES: dict[str, str] = {}
