"""Every core query against its SQL on the smallest tables, and on tables without rows."""

import pytest

from grammarium import registry
from run_queries import normal

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, small, duck):
    got, want = normal(QUERIES[name](spark, small).toPandas()), normal(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in ("examples", "predictions", "predicted_grammars", "batch_runs", "query_vectors"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(root / f"{t}.parquet"))
    return str(root)


EMPTY = (
    "rule_table rule_composition balance_split grammar_diff_summary knn_union pass_at_k added_alternatives request_batches run_states bootstrap "
    "rule_equality specialization_accuracy problem_grammars rescue_by_gold rescue_numeric proportional_sample tidy_accuracy set_iou supervised_rows demonstrated_prompts "
    "retrieval_prompts ingested_plans reparsed_grammars plan_searches encoded_labels decoded_labels corrupted_grammars rejections netlist_graph clean_netlists uncached_requests sized_split"
).split()


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
