"""Column functions and sources on cases worked out by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from grammarium.common import grammar_alternatives
from grammarium.functions import text as T
from grammarium.operators.dataflow import answered
from grammarium.operators.scoring import bootstrap_interval
from grammarium.sources import files


@pytest.mark.parametrize(
    "text, want",
    [
        ('a ::= "x" | b\n\nnoise\nb ::= "y|z"', [("a", '"x"'), ("a", "b"), ("b", '"y|z"')]),
        ("a ::= p\na ::= q", [("a", "q")]),
        ("a ::=", []),
        ("\t a::=p\t|\tq | r \r\n", [("a", "p\t|\tq"), ("a", "r")]),
        ("a ::= b ::= c", [("a", "b ::= c")]),
        ("", []),
        (None, None),
    ],
)
def test_grammar(spark, text, want):
    got = spark.createDataFrame([(text,)], "g string").select(grammar_alternatives(F.col("g")).alias("a")).first()[0]
    assert (got and [tuple(x) for x in got] or got) == want


CASES = [
    (T.grammar_of_output, "t <grammar>\n r ::= s \n</grammar> <grammar>z</grammar>", "r ::= s"),
    (T.grammar_of_output, " r ", "r"),
    (T.netlist, "t\nR1 1 0 1k\n.END\njunk", "t\nR1 1 0 1k\n.END"),
    (T.completion, "assign y=a;\nendmodule junk", "\nassign y=a;\nendmodule"),
    (T.completion, "assign y=a;", "\nassign y=a;\nendmodule"),
    (T.plan_steps, " (pick-up a)\nnote\n(put-down a)", ["(pick-up a)", "(put-down a)"]),
    (T.molecule_tokens, "C[C@@H](Br)%12", ["C", "[", "C", "@@", "H", "]", "(", "Br", ")", "%12"]),
    (T.references, '"(" a b ")" "salt lake city"', ["a", "b", "lake"]),
    (T.component_types, "t\nR1 1 0\nc2 1 0\n*x", ["C", "R"]),
    (T.last_fenced, "```\na\n```\n```\nb\n```", "b\n"),
    (T.normal_alternative, '"a b"   c', '"a b" c'),
    (lambda c: T.program_of_output(c, F.lit(True)), "Program: a Program: b ", "b"),
    (lambda c: T.program_of_output(c, F.lit(True)), None, ""),
    (lambda c: T.mentions_terminal(c, ["NUMBER"]), '"NUMBER" x', False),
    (lambda c: T.mentions_terminal(c, ["NUMBER", "L"]), 'x NUMBER "L"', True),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_text(spark, case):
    f, text, want = case
    assert spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("n, c, k, want", [(5, 2, 1, 0.4), (5, 2, 3, 0.9), (5, 5, 1, 1.0), (10, 0, 5, 0.0)])
def test_pass_at_k(spark, n, c, k, want):
    assert spark.createDataFrame([(n, c)], "n int, c int").select(T.pass_at_k(F.col("n"), F.col("c"), k)).first()[0] == pytest.approx(want)


def test_bleu():
    assert T.sentence_bleu(list("abcde"), list("abcde")) == pytest.approx(1)
    assert T.sentence_bleu(["a"], ["b"]) == 0
    assert 0 < T.sentence_bleu(list("abcd"), list("abxd")) < 1


def test_bootstrap():
    import numpy as np

    assert bootstrap_interval(np.array([np.nan])) == (0, 0, 0, 0)
    mean, low, high, _ = bootstrap_interval(np.array([0.0, 1.0] * 50))
    assert low < mean == 0.5 < high


def test_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"data": [{"description": "q0", "program": "p0"}, {"description": "q1", "program": "p1"}]}))
    assert [(r.pos, r.query) for r in files.read_examples(spark, str(tmp_path / "e.json")).orderBy("pos").collect()] == [(0, "q0"), (1, "q1")]
    with gzip.open(tmp_path / "p.jsonl.gz", "wt") as f:
        f.write('{"task_id": "a", "x": 1}\n\n{"task_id": "a", "x": 2}\n')
    assert [r.x for r in files.read_problems(spark, str(tmp_path / "p.jsonl.gz")).collect()] == [2]
    (tmp_path / "a.src").write_text("one\n\ntwo\n")
    (tmp_path / "a.tgt").write_text("1\n2\n\n")
    rows = files.read_aligned(spark, str(tmp_path / "a.src"), str(tmp_path / "a.tgt")).orderBy("idx").collect()
    assert [(r.query, r.program) for r in rows] == [("one", "1"), ("two", "2")]
    (tmp_path / "b.tgt").write_text("1\n")
    with pytest.raises(ValueError):
        files.read_aligned(spark, str(tmp_path / "a.src"), str(tmp_path / "b.tgt"))
    df = spark.createDataFrame([(1, "b"), (0, "a")], "pos int, x string")
    files.write_envelope(df, str(tmp_path / "out"))
    assert [r.x for r in files.read_envelope(spark, str(tmp_path / "out")).orderBy("pos").collect()] == ["a", "b"]
    import pyarrow as pa

    t = pa.table({"code": ["x", "y"], "d": [{"s": "1"}, {"s": None}]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert files.read_arrow(spark, [str(tmp_path / "t.arrow")]).count() == 2


def test_answered(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "bad")], "key string, prompt string")
    cached = spark.createDataFrame([("b", "kept")], "key string, response string")

    def ask(prompts):
        if "bad" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    got = sorted((r.key, r.response) for r in answered(rows.filter("key <> 'c'"), cached, ask).collect())
    assert got == [("a", "X"), ("a", "X"), ("b", "kept")]
    assert [r.response for r in answered(rows.filter("key = 'c'"), cached, ask).collect()] == [None]


def test_stream(spark, tmp_path):
    from grammarium.streaming.responses import collect_into

    land = tmp_path / "land"
    land.mkdir()
    row = lambda i, r: json.dumps({"custom_id": i, "response": r, "received_at": "2026-01-01 00:00:00"}) + "\n"
    (land / "1.json").write_text(row("a", "1") + row("a", "1"))
    collect_into(spark, str(land), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    (land / "2.json").write_text(row("a", "2") + row("b", "3"))
    collect_into(spark, str(land), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.custom_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
