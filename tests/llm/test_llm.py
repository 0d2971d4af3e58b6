"""Operators on training data: against SQL, brute force, round trips, and on odd tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grammarium import llm
from grammarium.llm import p1_overlap, p2_defects, p3_terms, p4_subset, p5_setjoin, p6_neighbours, p7_encode, p8_leaks, p9_levels
from run_queries import normal

QUERIES, SQL = llm.queries(), llm.oracle_sql()
TABLES = ("examples", "predictions", "predicted_grammars", "batch_runs", "query_vectors", "documents", "heldout_items", "level_labels")
FOUND = [n for n in QUERIES if n.endswith("_found")] + ["p4_subset", "p7_ids"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, small, duck):
    got, want = normal(QUERIES[name](spark, small).toPandas()), normal(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """Folders of tables: without rows, and with nulls in every column but the key, repeated rows and columns of clashing names."""
    root = tmp_path_factory.mktemp("odd")
    clash = ("class", "set", "block", "print", "blocks", "k", "place", "run", "no", "start", "w", "seed", "shifts", "f", "n", "token", "group", "field", "record", "hits", "raw", "ids")
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet").coalesce(1)
        key = df.columns[0]
        df.limit(0).write.parquet(str(root / "empty" / f"{t}.parquet"))
        nulls = df.limit(5).select(key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != key])
        more = df.union(df.limit(7)).union(nulls.withColumn(key, F.col(key) if t == "batch_runs" else -F.col(key) - 1))
        for c in clash:
            if c not in df.columns:
                more = more.withColumn(c, F.lit("x"))
        more.write.parquet(str(root / "odd" / f"{t}.parquet"))
    return root


@pytest.mark.parametrize("name", FOUND)
def test_empty(name, spark, odd):
    assert QUERIES[name](spark, str(odd / "empty")).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_nulls_repeats_clashes(name, spark, small, odd):
    """Rows of nulls, repeated rows and further columns change nothing but the rows of the null keys."""
    key = QUERIES[name](spark, small).columns[0]
    got, want = QUERIES[name](spark, str(odd / "odd")), QUERIES[name](spark, small)
    if name in ("p3_found", "p4_subset", "p9_found"):  # counts and models take the null rows in
        assert got.columns == want.columns and got.count() > 0
        return
    assert normal(got.filter(F.col(key) >= 0).toPandas()).equals(normal(want.toPandas()))


def test_p1_grams_and_chain():
    common = frozenset("how many people live in and".split())
    assert p1_overlap.grams("how many people live in zla and kru".split(), common)[0] == "how many people live in zla"
    assert p1_overlap.grams(["how", "many"], common) == ["how many"]
    assert p1_overlap.winnow([], common, "query") == []
    assert p1_overlap.chain([(0, 5), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]
    assert p1_overlap.extend("a b c x d e".split(), "a b c y d e".split(), [(0, 0)]) == 5


def test_p1_near_copies(spark):
    """Pairs of edited copies against brute force; the marks on candidates drop none."""
    rng = np.random.default_rng(7)
    base = [([f"q{rng.integers(300)}" for _ in range(14)], [f"p{rng.integers(300)}" for _ in range(18)]) for _ in range(20)]
    rows = []
    for i in range(160):
        q, p = (list(x) for x in base[i % 20])
        for w in (q, p):
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = f"z{rng.integers(40)}"
        rows.append((i, "train" if rng.random() < 0.6 else "test", " ".join(q), " ".join(p)))
    alike = lambda a, b: len(set(a.split()) & set(b.split())) >= 0.8 * len(set(a.split()) | set(b.split()))
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] == "test" and alike(a[2], b[2]) and alike(a[3], b[3])}
    got = [(r.train_id, r.other_id) for r in p1_overlap.Overlap(spark.createDataFrame(rows, "example_id bigint, split string, query string, program string")).row_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_p1_copies_expand(spark):
    rows = [(i, "train" if i < 40 else "test", "one two three four", "five six") for i in range(60)] + [(99, "test", None, "five six")]
    df = spark.createDataFrame(rows, "example_id bigint, split string, query string, program string")
    assert p1_overlap.Overlap(df).row_pairs().distinct().count() == 40 * 20


NAMED = "draw the substance zlapreine has 4 atoms of one kind"
JUDGED = [
    ("prediction", NAMED, None, "empty"), ("prediction", NAMED, "```text\n\n```", "empty"), ("gold", NAMED, "-", "empty"), ("grammar_cot", NAMED, "**Reasoning**", "empty"), ("grammar_cot", NAMED, "​", "empty"),
    ("prediction", NAMED, "Q: Draw the substance zlapreine has 4 atoms of one kind\nA:", "copy"), ("gold", NAMED, NAMED.upper(), "copy"),
    ("prediction", "list all cities", "answer(city(loc_2(stat", "truncated"), ("gold", "write a netlist", "* zla stage\nR1 a 0 1k", "truncated"), ("gold", "write module a", "assign a = (b + c);\nendmodule", None), ("gold", "write module a", "assign a = (b + c);\nendmo", "truncated"),
    ("prediction", "show me the list of cities", "So lautet die Antwort:\nanswer(city(all))\nDamit sind alle Namen erfasst.", "language"), ("prediction", "show me the list of cities", "Here is the program:\nanswer(city(all))", None),
    ("grammar_cot", "list all of the cities", 'The value kru is matched as a plain string. Since kru is named, we need the alternative "x" for', "truncated"),
    ("prediction", "list cities", "Query: list cities\nProgram: answer(city(all))", None), ("prediction", "draw x", "CCCll(Cl)O(=C)[13C]", None), ("prediction", None, "answer(city(all))", None),
]


SPOKEN = [("en", "here is the program for the list of all cities"), ("en", "show me the values that are matched"), ("de", "so lautet die antwort für das programm"), ("de", "damit sind alle namen erfasst und die regeln bleiben")] * 4


def speech(pairs):
    sizes, counts = {}, {}
    for lang, text in pairs:
        sizes[lang] = sizes.get(lang, 0) + 1
        counts.setdefault(lang, np.zeros(p2_defects.PLACES))[[p2_defects.Speech.place(w) for w in set(text.split())]] += 1
    return p2_defects.Speech((sizes, counts))


@pytest.mark.parametrize("case", JUDGED, ids=range(len(JUDGED)))
def test_p2_judge(case):
    field, query, text, want = case
    assert p2_defects.judge(field, query, text, speech(SPOKEN).other)[0] == want


def test_p2_languages(spark):
    """The same profiles from Spark; queries teach words that no document has; without documents nothing is told."""
    kinds = "text string, lang string"
    docs = spark.createDataFrame([(t, lang) for lang, t in SPOKEN * 8] + [(None, "en"), ("x", None)], kinds)
    queries = spark.createDataFrame([("show me the list of rivers past zla",)] * 3 + [(f"show me the list of rivers past kru{i}",) for i in range(6)] + [(None,)], "text string")
    told = p2_defects.languages(docs, queries)
    assert told.names == ["de", "en"] and told.other("rivers past bri", "so lautet die antwort") and not told.other("rivers past bri", "here is the list")
    assert not p2_defects.languages(docs.limit(0), queries).other("rivers past bri", "so lautet die antwort")


def test_p2_clusters(spark):
    """Components of openings against brute force: links lose none, and chains are followed to their end."""
    rng = np.random.default_rng(5)
    base = [[f"w{rng.integers(900)}" for _ in range(30)] for _ in range(25)]
    texts = set()
    for b in base:
        for _ in range(12):
            b = [*b, f"w{rng.integers(900)}"][1:]  # drifts by a word each time
            texts.add(" ".join(b))
    texts |= {"a b", "c", ""}
    names = sorted(texts)
    sets = [p2_defects.shingles(t) for t in names]
    top = list(range(len(names)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    want = {(names[i], names[root(i)]) for i in range(len(names))}
    got = {(r.opening, r.head) for r in p2_defects.clusters(spark.createDataFrame([(t,) for t in names], "opening string")).collect()}
    assert len(got) == len(names) and len(got & want) >= 0.98 * len(want)


def test_p2_clusters_exact(spark, monkeypatch):
    """Chains in which only next neighbours are alike, ends that differ, short openings at the bound, many that are all alike and pairs among many that nearly are: every component is that of brute force, and those all alike don't give all their pairs."""
    monkeypatch.setattr(p2_defects, "BLOCK", 50, raising=False)
    rng = np.random.default_rng(8)
    texts = {"", "a b", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "b c d e f g h i", "x a b c d e f g h"}
    for _ in range(120):
        long = [f"w{rng.integers(40_000)}" for _ in range(34)]
        texts |= {" ".join(long[i : i + 24]) for i in range(0, 11, 2)}
    same = [f"v{i}" for i in range(24)]
    texts |= {" ".join([*same, f"z{i}"]) for i in range(300)}
    texts |= {" ".join([f"y{i}", *same]) for i in range(300)}
    head = [f"u{i}" for i in range(59)]  # 55 shingles that all have, and 7 that two have
    for i in range(200):
        one = [*head, *[f"t{rng.integers(40_000)}" for _ in range(7)]]
        texts |= {" ".join(one), " ".join([*one, f"s{i}"])}
    names = sorted(texts)
    sets = [p2_defects.shingles(t) for t in names]
    top = list(range(len(names)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    by = {}
    for i, x in enumerate(sets):
        for w in x:
            by.setdefault(w, []).append(i)
    for j, i in {(j, i) for v in by.values() for i in v for j in v if j < i}:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            top[b] = a
    df = spark.createDataFrame([(t,) for t in names], "opening string")
    got = {(r.opening, r.head) for r in p2_defects.clusters(df).collect()}
    assert got == {(t, names[root(i)]) for i, t in enumerate(names)}
    found = [(r.a, r.b) for r in p2_defects.links(df).collect()]
    assert len(found) < 10 * len(names)
    assert all(len(x & y) >= 0.8 * len(x | y) for x, y in ((p2_defects.shingles(a), p2_defects.shingles(b)) for a, b in found))


def test_p2_refusals(spark):
    """A template that recurs over prompts, and an answer without a program that nothing is known of."""
    rows = [(i, "cot", f"list all cities near zla{i}", "Nada hoy por aquí, vuelva usted mañana con otra cosa distinta si quiere", "answer(all)", "The value a is matched as a plain string.") for i in range(8)]
    rows += [(100, "cot", "list all rivers", "I'm sorry, but I can't help with this task.", "answer(all)", "x")]
    df = spark.createDataFrame(rows, "pred_id bigint, mode string, query string, prediction string, gold string, grammar_cot string")
    texts = spark.createDataFrame([], "text string, lang string")
    got = {(r.pred_id, r.defect) for r in p2_defects.defects(df, texts).filter("field = 'prediction'").collect()}
    assert got == {(i, "refusal") for i in (*range(8), 100)}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_p3_runs(spark, parts):
    """One term in all rows, over any number of ranges."""
    df = spark.createDataFrame([(i, "r ::= a | a", "x x y" if i % 2 else "x") for i in range(50)], "example_id bigint, minimal_grammar string, program string")
    got = {(r.term): (r.occurrences, r.records, r.mark) for r in p3_terms.term_counts(df, parts).collect()}
    assert got == {"r ::= a": (100, 50, "common"), "x": (75, 50, "common"), "y": (25, 25, "common")}


def test_p4_variety(spark):
    rows = [(i, f"count the blocks {i % 3}", "a ::= b") for i in range(300)] + [(1000 + i, f"river number{i} flows{i}", f"q{i} ::= z{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "example_id bigint, query string, minimal_grammar string")
    got = [r.example_id for r in p4_subset.subset(df, 10).collect()]
    assert len(got) == len(set(got)) == 10
    assert sum(i < 1000 for i in got) <= 3


def test_p4_greedy():
    x = np.random.default_rng(0).normal(size=(40, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w, s = np.ones(40, np.float32), np.maximum(x @ x.T, 0)
    chosen, best = [], np.zeros(40)
    for _ in range(6):
        chosen.append(int(np.argmax([np.maximum(s[i], best).sum() for i in range(40)])))
        best = np.maximum(best, s[chosen[-1]])
    assert p4_subset.lazy_greedy(x, w, 6)[0] == chosen
    assert p4_subset.lazy_greedy(x, w, 6, held=0)[0] == chosen


def test_p4_one_final_pass(spark):
    """Above 3 000 candidates too, gains are compared among all: one order of ranks, and each group of likes is met once before any is met twice."""
    rows = [(i, f"group{i // 3} alpha{i // 3} beta{i // 3} gamma{i // 3} delta{i // 3} epsilon{i // 3} item{i}", f"r{i // 3} ::= s{i // 3} | t{i // 3}") for i in range(3_300)]
    df = spark.createDataFrame(rows, "example_id bigint, query string, minimal_grammar string")
    got = p4_subset.subset(df, 1_100).collect()
    assert sorted(r.gain_rank for r in got) == list(range(1, 1_101))
    assert len({r.example_id // 3 for r in got}) == 1_100


def test_p5_random_sets(spark):
    rng = np.random.default_rng(3)
    sets = []
    for i in range(150):
        base = rng.choice(400, rng.integers(1, 40), replace=False).tolist()
        sets.append(base)
        for _ in range(2):
            other = [t for t in base if rng.random() > 0.08] + rng.choice(400, rng.integers(0, 3)).tolist()
            sets.append(other or [1])
    sets = [sorted(set(s)) for s in {tuple(sorted(set(s))) for s in sets}]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "set bigint, tokens array<bigint>")
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if share(set(sets[i]), set(sets[j])) >= 0.8}
    got = [tuple(sorted((r.a, r.b), reverse=True)) for r in p5_setjoin.similar_sets(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_p6_recall(spark, monkeypatch):
    """Many lists, groups and splits: at least 0.95 of the exact neighbours; a hot vector is expanded whole."""
    for name, v in (("LIST", 40), ("GROUP", 500), ("GROUP_QUERIES", 300), ("SAMPLE", 1_200)):
        monkeypatch.setattr(p6_neighbours, name, v)
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(30, 64))
    x = heads[rng.integers(0, 30, 2000)] + 0.8 * rng.normal(size=(2000, 64))
    x[1500:] = x[1500]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 64), (5001, [1.0]), (5002, None), (5003, [float("nan")] * 64)], "vec_id bigint, embedding array<float>")
    got: dict = {}
    for r in p6_neighbours.neighbours(df).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    u = p6_neighbours.unit(x)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :10]
    assert set(got) == set(range(2000)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in range(2000)]) >= 0.95
    assert set(got[1999]) == set(range(1500, 1510))


def test_p7_chunks(spark):
    """Texts cut into chunks encode as they do whole, and decode to themselves."""
    rng = np.random.default_rng(2)
    words = ["don't", "we'll", " ", "  ", "\n\n", "über", "数据", "x" * 70, "123", "<|endoftext|>", "🧪", "...", "\t"]
    texts = ["".join(rng.choice(words, rng.integers(0, 400))) for _ in range(30)] + ["", None, "a" * 900, " " * 900, "a" * 300 + " b" * 200, " " * 250 + "b c " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bpe = p7_encode.encoder(p7_encode.vocabulary_path())
    for chunk, overlap in ((200, 60), (130, 20), (16_384, 1_024)):
        got = {r.doc_id: r.ids for r in p7_encode.encode(df, chunk=chunk, overlap=overlap).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i] == (bpe.encode_ordinary(t) if t else []), (chunk, i)
            assert p7_encode.decode(got[i]) == (t or "")


def test_p8_tolerance(spark):
    item = " ".join(f"w{i}" for i in range(30))
    changed = " ".join("zz" if i in (14, 24) else f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"x {changed}"), (3, "w1 w2 w3"), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(9)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "w1 w2")], "item_id bigint, item_text string")
    got = {r.doc_id: (r.run, r.tolerant) for r in p8_leaks.leaks(docs, items).collect()}
    assert got == {1: (30, 30), 2: (14, 30)}


def test_p9_held_out(spark):
    """Levels of rated documents that weren't fitted on."""
    docs, labels = p9_levels.load(spark, "/root/testdata/sf0.01")
    got = p9_levels.levels(docs, labels.filter("doc_id % 3 <> 0")).join(p9_levels.rated(labels.filter("doc_id % 3 = 0")), "doc_id").toPandas()
    assert len(got) and (abs(got["level"] - got["reading_level"]) <= 1).mean() > 0.9 and (got["level"] == got["reading_level"]).mean() > 0.7


def test_p9_sentences(spark):
    """Headings, code and footers are left out; sentences of another language stay, but their words aren't ranked (next test)."""
    text = "# Zla notes\n\nThe box holds a map.\n```\na ::= b\n```\n    R1 a 0 1k\nDer Hund läuft durch den Wald und bellt.\nEach tool helps this team!\n-- \nfooter"
    df = spark.createDataFrame([(1, text), (2, "x = 1; y"), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: [" ".join(x["w"]) for x in r.s] for r in df.select("doc_id", p9_levels.sentences(F.col("text")).alias("s")).collect()}
    assert [s.split()[0] for s in got[1]] == ["The", "Der", "Each"] and got[2] == ["x y"] and got[3] == []


def test_p9_vocabulary(spark):
    """Words by frequency, ties on the least rank; words that other languages use relatively more have none."""
    rows = [(i, "the box holds the map", "en") for i in range(30)] + [(100 + i, "der hund holds der map", "de") for i in range(3)] + [(200, "der box", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    ranks = {r.word: round(2**r.rank) for r in p9_levels.vocabulary(p9_levels.prose(df)).collect()}
    assert ranks == {"the": 1, "box": 2}
    features = p9_levels.profile(p9_levels.prose(df.withColumn("text", F.repeat(F.concat("text", F.lit(". ")), 12)))).first()["f"]
    assert len(features) == len(p9_levels.FEATURES)


def test_core_stands_alone():
    """Nothing outside the subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(llm.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M)]


def test_p6_memory_of_workers():
    """What a worker holds doesn't grow with lists, queries or weak bars: 16 384 isolated vectors, whose queries read nearly all lists, and postings whose nearest list is never read."""
    rng = np.random.default_rng(5)
    x = p6_neighbours.unit(rng.normal(size=(16_384, 64))).astype(np.float32)
    centroids = p6_neighbours.Centroids(x, 10**9)
    batch = pd.DataFrame({"class": np.arange(4_000), "vector": list(x[:4_000]), "ids": [np.array([i]) for i in range(4_000)]})
    lists = len(centroids.at)
    tasks = p6_neighbours.Tasks(np.full(lists, 4_000))

    def largest(frames):
        """Of frames that aren't kept: rows, the most numbers of one, and the peak in MB."""
        tracemalloc.start()
        rows, most = 0, 0
        for f in frames:
            rows, most = rows + len(f), max(most, sum(f[c].map(lambda v: 0 if v is None else len(v)).sum() for c in ("ids", "posts", "probes")) + 64 * len(f))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return rows, most, peak

    rows, most, peak = largest(p6_neighbours.route(iter([batch]), centroids))
    assert rows >= 4_000 and most < 2 << 20 and peak < 150
    routed = pd.concat(list(p6_neighbours.route(iter([batch[:300]]), centroids)))
    assert routed["probes"].map(len).max() <= 2_048
    assert sorted(routed[routed["posts"].map(len) > 0]["class"]) == list(range(300))  # posted once
    read = routed.groupby("class")["probes"].apply(lambda v: np.concatenate(list(v)))
    assert read.map(len).max() > 0.5 * lists and all(len(np.unique(r)) == len(r) for r in read)
    rows, most, peak = largest(tasks.send(iter([routed])))
    assert rows > 50_000 and most < 2 << 20 and peak < 150

    p, q = x[:6_000].astype(np.float64), x[6_000:12_000].astype(np.float64)
    holds = [np.array([1_000, i % 100], np.int32) for i in range(len(p))]
    tracemalloc.start()
    qi, pi = p6_neighbours.best(q, p, holds, [np.arange(100, dtype=np.int32)] * len(q), 16)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 300
    for row in range(0, len(q), 500):
        assert set(np.argsort(-(p @ q[row]))[:16]) <= set(pi[qi == row])


def test_p6_ties_of_scaled_copies(spark):
    """More vectors of one direction than a query keeps: the smaller ids come out."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=64)
    rows = [(int(i), (one * f).tolist()) for i, f in zip(rng.permutation(300), rng.uniform(0.5, 9, 300))]
    got = p6_neighbours.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    want = {(i, j) for i in range(300) for j in [j for j in range(11) if j != i][:10]}
    assert {(r.vec_id, r.neighbour_id) for r in got} == want
