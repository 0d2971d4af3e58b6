"""Occurrences and records of every distinct term, and marks on the rare and the common.

(field, term, record) rows are sorted externally over range partitions and
counted by scanning runs. Ranges are cut by term *and* record, so a term that
stands in a third of all records is spread over many tasks; rows of one term and
record always meet in one partition, so the partial counts of a term just add up.

Null texts hold no terms and don't count as records of their field; empty ones
hold none but count. Rows of one example_id count once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpointed, grammar_alternatives, table, unique

RARE_RECORDS, COMMON_SHARE = 2, 10


def term_rows(examples: DataFrame) -> DataFrame:
    """(field, term, record, hits) of each record; hits is how often the term stands in it."""
    members = F.transform(grammar_alternatives(F.col("minimal_grammar")), lambda m: F.concat(m["name"], F.lit(" ::= "), m["alt"]))
    idents = F.regexp_extract_all(F.col("program"), F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    fields = F.array(F.struct(F.lit("minimal_grammar").alias("field"), members.alias("terms")), F.struct(F.lit("program").alias("field"), idents.alias("terms")))
    return examples.select(F.col("example_id").alias("record"), F.explode(fields).alias("f")).select("f.field", F.explode("f.terms").alias("term"), "record")


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over rows sorted by (field, term, record): a row per term and partition."""
    open_term, open_record, hits, records = None, None, 0, 0

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["field", "term", "hits", "records"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        field, term, record = b.column("field"), b.column("term"), b.column("record")
        differs = lambda x: pc.not_equal(x.slice(1), x.slice(0, n - 1))
        new_term = pc.or_(differs(field), differs(term))
        new_record = pc.or_(new_term, differs(record))
        first = (field[0].as_py(), term[0].as_py())
        same_term = first == open_term
        same_record = same_term and record[0].as_py() == open_record
        if not same_term and open_term is not None:
            yield row(*open_term, hits, records)
            hits, records = 0, 0
        starts = [0, *(i + 1 for i in pc.indices_nonzero(new_term).to_pylist())]
        # the number of new records up to each place, so that a run's records are a difference
        upto = pa.concat_arrays([pa.array([0 if same_record else 1], pa.int64()), pc.cast(new_record, pa.int64())])
        upto = pc.cumulative_sum(upto).to_numpy()
        ends = [*starts[1:], n]
        run_hits = [e - s for s, e in zip(starts, ends)]
        run_records = [int(upto[e - 1] - (upto[s - 1] if s else 0)) for s, e in zip(starts, ends)]
        run_hits[0] += hits
        run_records[0] += records
        if len(starts) > 1:
            at = pa.array(starts[:-1])
            yield pa.RecordBatch.from_arrays([field.take(at), term.take(at), pa.array(run_hits[:-1], pa.int64()), pa.array(run_records[:-1], pa.int64())], ["field", "term", "hits", "records"])
        hits, records = run_hits[-1], run_records[-1]
        open_term, open_record = (field[n - 1].as_py(), term[n - 1].as_py()), record[n - 1].as_py()
    if open_term is not None:
        yield row(*open_term, hits, records)


def term_counts(examples: DataFrame, partitions: int | None = None) -> DataFrame:
    """(field, term, occurrences, records, mark); mark is rare, common or null."""
    examples = checkpointed(examples.select("example_id", "minimal_grammar", "program"))  # read once for the bounds of the ranges, once for the sort, once for the totals
    rows = term_rows(examples)
    keys = ("field", "term", "record")
    ranges = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    runs = ranges.sortWithinPartitions(*keys).mapInArrow(scan_runs, "field string, term string, hits bigint, records bigint")
    counts = runs.groupBy("field", "term").agg(F.sum("hits").alias("occurrences"), F.sum("records").alias("records"))
    totals = examples.agg(F.count("minimal_grammar").alias("minimal_grammar"), F.count("program").alias("program"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in ("minimal_grammar", "program")])).alias("t")).select("t.*")
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") * COMMON_SHARE >= F.col("n"), "common")
    return counts.join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", mark.alias("mark"))


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(table(spark, sf_dir, "examples").select("example_id", "minimal_grammar", "program"), "example_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(load(spark, sf_dir)).filter("mark is not null").select("field", "term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(load(spark, sf_dir))


#: (example_id, name, alt) of examples for DuckDB; shared by other oracles with another table.
MEMBERS_SQL = r"""
lines AS (SELECT {key} AS id, i, trim(line, E' \t\r') AS line FROM (SELECT {key}, unnest(string_split(minimal_grammar, E'\n')) AS line, generate_subscripts(string_split(minimal_grammar, E'\n'), 1) AS i FROM {source})),
ruled AS (SELECT id, i, trim(split_part(line, '::=', 1), E' \t\r') AS name, substr(line, instr(line, '::=') + 3) AS rhs FROM lines WHERE contains(line, '::=')),
latest AS (SELECT id, name, arg_max(rhs, i) AS rhs FROM ruled GROUP BY id, name),
members AS (SELECT id, name, trim(a, E' \t\r') AS alt FROM (SELECT id, name, unnest(string_split(rhs, ' | ')) AS a FROM latest) WHERE trim(a, E' \t\r') <> '')"""

COUNTS_SQL = (
    "WITH e AS (SELECT DISTINCT ON (example_id) example_id, minimal_grammar, program FROM examples), "
    + MEMBERS_SQL.format(key="example_id", source="e")
    + r""",
terms AS (SELECT 'minimal_grammar' AS field, name || ' ::= ' || alt AS term, id FROM members UNION ALL SELECT 'program', unnest(regexp_extract_all(program, '[A-Za-z0-9_]+')), example_id FROM e),
n AS (SELECT 'minimal_grammar' AS field, count(minimal_grammar) AS n FROM e UNION ALL SELECT 'program', count(program) FROM e),
counted AS (SELECT t.field, t.term, count(*) AS occurrences, count(DISTINCT id) AS records, CASE WHEN count(DISTINCT id) <= 2 THEN 'rare' WHEN count(DISTINCT id) * 10 >= any_value(n.n) THEN 'common' END AS mark FROM terms t JOIN n USING (field) GROUP BY ALL)
"""
)

QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}
ORACLES = {"p3_found": COUNTS_SQL + "SELECT field, term, mark FROM counted WHERE mark IS NOT NULL", "p3_terms": COUNTS_SQL + "SELECT * FROM counted"}
