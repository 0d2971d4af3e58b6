"""Encoding of whole texts with a public byte-level BPE vocabulary.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. A
chunk's scan starts at an arbitrary place, so its first boundaries may be false;
where a boundary of the earlier chunk's scan falls together with one of the later
chunk's, both scans agree from there on, as the pattern never looks back. Texts
are cut at these places and the pieces are encoded on their own; ids of the
pieces in order are the ids of the text. Where two chunks share no boundary
(one run of letters, say), their pieces are joined and encoded as one.

Null and empty texts give an empty list; strings that look like special tokens
are plain text; one row per doc_id; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import spread, table, unique

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 4_096, 512


def vocabulary_path(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pre_token():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of `text`, and its end."""
    return [*(m.start() for m in pre_token().finditer(text)), len(text)]


def cut(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """(doc_id, text) -> (doc_id, no, start, text, chunks); at most about 4 MB of text in a batch."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            text = text or ""
            n = max(1, -(-(len(text) - overlap) // chunk))
            for no in range(n):
                part = text if n == 1 else text[no * chunk : (no + 1) * chunk + overlap if no < n - 1 else len(text)]
                rows.append((doc, no, no * chunk, part, n))
                held += len(part)
                if held > 1 << 22 or len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "no", "start", "text", "chunks"])
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["doc_id", "no", "start", "text", "chunks"])


def encode_batches(batches: Iterator[pd.DataFrame], path: str | None) -> Iterator[pd.DataFrame]:
    bpe = encoder(vocabulary_path(path))  # where the task runs
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "no": batch["no"], "ids": [bpe.encode_ordinary(t) if t else [] for t in batch["text"]]})


def edges(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Boundaries of a chunk's scan, as places in the text, in what it shares with its neighbours."""
    for batch in batches:
        head, tail = [], []
        for start, text in zip(batch["start"], batch["text"]):
            found = boundaries(text)
            head.append([start + b for b in found if b < overlap])
            # the last two pre-tokens may be cut short by the chunk's end
            tail.append([start + b for b in found[:-2] if b >= chunk])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "no": batch["no"], "head": head, "tail": tail})


def glue(batches: Iterator[pd.DataFrame], path: str | None) -> Iterator[pd.DataFrame]:
    """Rebuilds and encodes a run of chunks: parts is an ordered list of (start, text)."""
    bpe = encoder(vocabulary_path(path))
    for batch in batches:
        out = []
        for parts, begin, end in zip(batch["parts"], batch["begin"], batch["end"]):
            text, origin = "", parts[0]["start"]
            for p in parts:
                text = text[: p["start"] - origin] + p["text"]
            out.append(bpe.encode_ordinary(text[begin - origin : None if pd.isna(end) else int(end) - origin]))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "no": batch["no"], "ids": out})


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text)."""
    if chunk < 2 * overlap:
        raise ValueError("a chunk must be at least twice its overlap")
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # a text of one chunk has nothing to stitch
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    whole = docs.filter(~long).mapInPandas(
        lambda b: encode_batches((x.assign(no=0) for x in b), path), f"doc_id {id_type}, no int, ids array<int>"
    ).select("doc_id", "ids")
    chunks = spread(docs.filter(long).mapInPandas(lambda b: cut(b, chunk, overlap), f"doc_id {id_type}, no int, start bigint, text string, chunks int"), "doc_id", "no")
    scans = chunks.mapInPandas(lambda b: edges(b, chunk, overlap), f"doc_id {id_type}, no int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("doc_id").orderBy("no")
    places = (
        scans.withColumn("common", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
        # a chunk that shares no boundary leaves open whether later scans agree, so the rest is joined to it
        .withColumn("agree", F.min((F.col("no") == 0) | F.col("common").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("cut", F.when(F.col("no") == 0, F.lit(0).cast("bigint")).when(F.col("agree"), F.col("common")))
        .withColumn("run", F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", "no", "run", "cut")
    )
    # a run starts at its first chunk's cut and ends at the next run's
    runs = places.filter(F.col("cut").isNotNull()).select("doc_id", "run", F.col("cut").alias("begin"), F.lead("cut").over(order).alias("end"))
    parts = (
        chunks.join(places.select("doc_id", "no", "run"), ["doc_id", "no"])
        .groupBy("doc_id", "run")
        .agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
        .join(runs, ["doc_id", "run"])
    )
    pieces = parts.select("doc_id", F.col("run").alias("no"), "parts", "begin", "end").mapInPandas(lambda b: glue(b, path), f"doc_id {id_type}, no bigint, ids array<int>")
    stitched = pieces.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.unionByName(stitched)


def decode(ids: list[int], path: str | None = None) -> str:
    """The text whose ids these are: raw bytes of the tokens, joined and only then read as UTF-8."""
    bpe = encoder(vocabulary_path(path))
    return b"".join(bpe.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unique(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return encode(docs)


def p7_source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and texts of each source."""
    docs = unique(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    ids = encode(docs).select("doc_id", F.size("ids").alias("n"))
    return ids.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").cast("bigint").alias("tokens"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document again, from its ids."""
    docs = unique(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [decode(list(ids)) for ids in b["ids"]]})

    return encode(docs).mapInPandas(read, "doc_id bigint, text string")


QUERIES = {"p7_ids": p7_ids, "p7_source_tokens": p7_source_tokens, "p7_decoded": p7_decoded}
ORACLES = {"p7_decoded": "SELECT DISTINCT ON (doc_id) doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL"}
