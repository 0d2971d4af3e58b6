"""Sources and sinks: enveloped JSON, JSON lines, aligned text, Arrow files, split folders.

Readers give null for absent fields; blank lines are skipped; a missing required
field ends the read with an error that names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that stand in for one another, the first that isn't null wins.
STAND_INS = {"query": ("query", "description"), "program": ("program", "canonical_solution")}


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``{"data": [...]}`` with their place as pos."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("data").alias("pos", "row")).select("pos", "row.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or gzipped."""
    return spark.read.json(path)


def read_problems(spark: SparkSession, path: str, key: str = "task_id") -> DataFrame:
    """JSON lines, one row per key; of several rows the last of the file wins."""
    rows = spark.read.json(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # by file, then along it
    order = rows.select("*", at.alias("_at"))
    return order.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_at").alias("r")).select("r.*")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Enveloped JSON or JSON lines by the file's ending, with query and program filled from their stand-ins; a row without either is an error."""
    rows = read_envelope(spark, path) if path.endswith(".json") else read_lines(spark, path)
    for name, options in STAND_INS.items():
        there = [F.col(c) for c in options if c in rows.columns]
        if not there:
            raise ValueError(f"{path} has no column for {name}")
        rows = rows.withColumn(name, F.coalesce(*there, F.raise_error(F.lit(f"a row has no {name}"))))
    return rows


def numbered(lines: DataFrame) -> DataFrame:
    """(idx, value) of the lines that aren't blank, numbered densely in their order."""
    rows = lines.filter(F.trim("value") != "").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["value"]))  # a dense order has no DataFrame operator that isn't one task
    return lines.sparkSession.createDataFrame(rows, "idx bigint, value string")


def read_aligned(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(idx, query, program) of two files whose lines belong together; different numbers of lines are an error."""
    q, p = (numbered(spark.read.text(x)) for x in (source, target))
    if q.count() != p.count():
        raise ValueError(f"{source} and {target} differ in their numbers of lines")
    return q.withColumnRenamed("value", "query").join(p.withColumnRenamed("value", "program"), "idx")


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC files or streams; each file is read by one task, batch by batch."""
    import pyarrow as pa

    def load(path: str):
        source = pa.memory_map(path)
        try:
            return pa.ipc.open_file(source)
        except pa.ArrowInvalid:
            source.seek(0)
            return pa.ipc.open_stream(source)

    schema = load(paths[0]).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def batches(rows):
        for b in rows:
            for path in b.column("path").to_pylist():
                reader = load(path)
                yield from (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInArrow(batches, from_arrow_schema(schema))


def read_splits(spark: SparkSession, folder: str, splits=("train", "valid", "test")) -> DataFrame:
    """Parquet folders of splits, with their name; a split that isn't there is left out."""
    found = []
    for s in splits:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{s}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found.append(spark.read.parquet(f"{folder}/{s}").withColumn("split", F.lit(s)))
    if not found:
        raise FileNotFoundError(folder)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzipped JSON lines without rows of nothing but nulls."""
    df.dropna(how="all").write.mode(mode).option("compression", "gzip").json(path)


def write_envelope(df: DataFrame, path: str) -> None:
    """``{"data": [...]}`` in one file, in the order of pos where there is one. For exports only: all rows pass one task, as the format asks."""
    rows = df.withColumn("pos", F.col("pos") if "pos" in df.columns else F.lit(0))
    fields = F.struct(*[c for c in df.columns if c != "pos"])
    rows.select(F.struct("pos", fields.alias("r")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("data")).coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Scores of rows: the ``results`` of one JSON document with their place as pos, or JSON lines, by the file's ending."""
    if not path.endswith(".json"):
        return read_lines(spark, path)
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("results").alias("pos", "row")).select("pos", "row.*")


def write_results(metrics: DataFrame, rows: DataFrame, folder: str) -> None:
    """Two tables: the metrics of a run and the scores of its rows."""
    metrics.write.mode("overwrite").parquet(f"{folder}/metrics")
    rows.write.mode("overwrite").parquet(f"{folder}/results")


def read_report(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """(model, name, value) of all result documents under folder/MODEL/NAME.json, the metric by its dotted path; null where a document lacks it."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    path = F.col("_metadata.file_path")
    return texts.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("model"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("name"), F.get_json_object("value", f"$.{metric}").cast("double").alias("value"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, description, simple_description); the simple one is null where the file has none."""
    rows = read_lines(spark, path)
    simple = F.col("simple_description") if "simple_description" in rows.columns else F.lit(None).cast("string")
    return rows.select("task_id", F.col("detail_description").alias("description"), simple.alias("simple_description"))


def append_cache(new: DataFrame, folder: str) -> None:
    """Adds answers (key, response) to a cache of Parquet files; keys that are there already aren't added again."""
    spark = new.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(folder).select("key"), "key", "left_anti")
    new.dropDuplicates(["key"]).write.mode("append").parquet(folder)


def embedding_keys(rows: DataFrame, model: str) -> DataFrame:
    """rows with the key of their vector: the model and a digest of each text by itself, so that no two splits share one by chance."""
    return rows.withColumn("vector_key", F.concat_ws("-", F.lit(model), F.sha2(F.coalesce("query", F.lit("")), 256)))


def latest_manifest(runs: DataFrame) -> DataFrame:
    """The newest manifest of each task, told by equal names; ties by the larger run_id."""
    rank = F.row_number().over(Window.partitionBy("task_name").orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.withColumn("k", rank).filter("k = 1").drop("k")
