"""Answering prompts through a cache: keys, probes, batches bounded in size, states, collection.

Prompts are keyed by a digest of model and text; a prompt that several rows share is
asked once. Rows with one key count once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import small_or_shuffled, table, unique
from ..oracle import one_per
from ..sources.files import latest_manifest
from .scoring import predictions

#: Bytes and requests of a batch at most.
BATCH_BYTES, BATCH_ROWS = 20_000, 100


def prompt_key(model, text):
    return F.sha2(F.concat_ws("\x1f", model, text), 256)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = unique(table(spark, sf_dir, "batch_runs").select("run_id", "model", "task_name"), "run_id")
    return predictions(spark, sf_dir).join(small_or_shuffled(runs), "run_id").select("pred_id", "run_id", "model", "query", prompt_key(F.col("model"), F.coalesce("query", F.lit(""))).alias("key"), "prediction", "received_at")


def prompt_keys(spark, sf_dir):
    return requests(spark, sf_dir).select("pred_id", "key")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, response): the first answer that was received for a key; ties by pred_id."""
    rows = requests(spark, sf_dir).filter("prediction is not null")
    return rows.groupBy("key").agg(F.min_by("prediction", F.struct("received_at", "pred_id")).alias("response"))


def cache_entries(spark, sf_dir):
    return cache(spark, sf_dir)


def uncached_requests(spark, sf_dir):
    """Distinct prompts without an answer in the cache, which holds what was received up to the middle of the time that answers came in."""
    rows = requests(spark, sf_dir)
    span = rows.agg(F.min(F.unix_micros(F.col("received_at").cast("timestamp"))).alias("low"), F.max(F.unix_micros(F.col("received_at").cast("timestamp"))).alias("high"))
    cached = rows.filter("prediction is not null").join(F.broadcast(span), F.unix_micros(F.col("received_at").cast("timestamp")) * 2 <= F.col("low") + F.col("high")).select("key")  # one row of times
    return rows.select("key").distinct().join(cached, "key", "left_anti")


def answered(rows: DataFrame, cached: DataFrame, ask: Callable[[list[str]], list[str]], attempts: int = 5, delay: float = 2.0, at_once: int = 20) -> DataFrame:
    """rows(key, prompt, ...) with response: from the cache, else by `ask` on up to `at_once` distinct prompts; it is tried again after delay * 2^k seconds, then prompt by prompt, and null where even that fails. Tasks bound what is in flight: at_once each."""

    def tried(prompts: list[str], times: int) -> list[str | None]:
        for k in range(times):
            try:
                return list(ask(prompts))
            except Exception:  # noqa: BLE001
                if k < times - 1:
                    time.sleep(delay * 2**k)
        return [None] if len(prompts) == 1 else [tried([p], 1)[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prompts = b["prompt"].tolist()
            answers = [r for i in range(0, len(prompts), at_once) for r in tried(prompts[i : i + at_once], attempts)]
            yield pd.DataFrame({"key": b["key"], "response": pd.Series(answers, dtype=object)})

    new = rows.join(cached, "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt")).mapInPandas(run, "key string, response string")
    return rows.join(cached.select("key", "response").unionByName(new), "key", "left")


def request_batches(spark, sf_dir):
    """Batch of each request of a run: in the order of pred_id a batch is filled until the next request would pass BATCH_BYTES or BATCH_ROWS; a request over the limit has its own. Each step depends on the last, so a run's sizes (not its texts) are folded by one task."""
    rows = predictions(spark, sf_dir).select("run_id", "pred_id", F.coalesce(F.octet_length("query"), F.lit(0)).cast("bigint").alias("bytes"))

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("pred_id")
        batch, held, n, out = 0, 0, 0, []
        for size in run["bytes"]:
            if n and (held + size > BATCH_BYTES or n >= BATCH_ROWS):
                batch, held, n = batch + 1, 0, 0
            held, n = held + size, n + 1
            out.append(batch)
        return run.assign(batch=out)[["run_id", "pred_id", "batch"]]

    return rows.groupBy("run_id").applyInPandas(fold, "run_id string, pred_id bigint, batch int")


def run_states(spark, sf_dir):
    """State of each run: failed if a batch has no input file, complete if as many answers came as were submitted, else in progress."""
    runs = unique(table(spark, sf_dir, "batch_runs"), "run_id").select("run_id", "n_total", F.exists("batches", lambda b: b["input_file_id"].isNull()).alias("broken"))
    got = predictions(spark, sf_dir).groupBy("run_id").agg(F.count("prediction").alias("got"))
    n = F.coalesce("got", F.lit(0))
    return runs.join(got, "run_id", "left").select("run_id", n.alias("collected"), F.when(F.col("broken"), "failed").when(n >= F.col("n_total"), "completed").otherwise("in_progress").alias("state"))


def latest_runs(spark, sf_dir):
    return latest_manifest(unique(table(spark, sf_dir, "batch_runs"), "run_id")).select("task_name", "run_id")


R = "WITH p AS " + one_per("predictions", "pred_id") + ", r AS " + one_per("batch_runs", "run_id") + ", q AS (SELECT pred_id, p.run_id, sha256(concat_ws(chr(31), model, coalesce(query, ''))) AS key, prediction, received_at FROM p JOIN r USING (run_id))"
QUERIES = {f.__name__: f for f in (prompt_keys, cache_entries, uncached_requests, request_batches, run_states, latest_runs)}
ORACLES = {
    "prompt_keys": R + " SELECT pred_id, key FROM q",
    "cache_entries": R + " SELECT key, prediction AS response FROM q WHERE prediction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY received_at, pred_id) = 1",
    "uncached_requests": R + " SELECT DISTINCT key FROM q WHERE key NOT IN (SELECT key FROM q WHERE prediction IS NOT NULL AND epoch_us(received_at) * 2 <= (SELECT min(epoch_us(received_at)) + max(epoch_us(received_at)) FROM q))",
    "run_states": R + ", g AS (SELECT run_id, count(prediction) AS got FROM p GROUP BY run_id) SELECT r.run_id, coalesce(got, 0) AS collected, CASE WHEN len(list_filter(batches, lambda b: b.input_file_id IS NULL)) > 0 THEN 'failed' WHEN coalesce(got, 0) >= n_total THEN 'completed' ELSE 'in_progress' END AS state FROM r LEFT JOIN g USING (run_id)",
    "latest_runs": R + " SELECT task_name, run_id FROM r QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY created_at DESC, run_id DESC) = 1",
}
