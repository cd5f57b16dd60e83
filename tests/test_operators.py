import random

import pytest
from pyspark.sql import functions as F

from sparrowdex.functions import passages as P
from sparrowdex.functions import proximity
from sparrowdex.functions.text import Analyzer, cleaned_reply, normalized_answer
from sparrowdex.operators import evaluation, reranking, retrieval
from sparrowdex.operators.index import Index, SavedIndex
from sparrowdex.plans.runner import Runner
from sparrowdex.sources import files
from sparrowdex.streaming.postings import standing_matches, stream_postings


def walk_near(lists, n):
    at, out = [0] * len(lists), []
    while at[0] < len(lists[0]):
        prev, ok = lists[0][at[0]], True
        for i in range(1, len(lists)):
            while at[i] < len(lists[i]) and lists[i][at[i]] <= prev:
                at[i] += 1
            if at[i] == len(lists[i]):
                return out
            if lists[i][at[i]] - prev > n:
                ok = False
                break
            prev = lists[i][at[i]]
        if ok:
            out.append(prev)
            at = [x + 1 for x in at]
            if any(at[i] >= len(lists[i]) for i in range(len(lists))):
                return out
        else:
            at[0] += 1
    return out


def walk_window(lists, n):
    at, out = [0] * len(lists), []
    while all(a < len(x) for a, x in zip(at, lists)):
        now = [x[a] for a, x in zip(at, lists)]
        if max(now) - min(now) < n:
            out.append(max(now))
            at = [a + 1 for a in at]
        else:
            at[now.index(min(now))] += 1
    return out


def test_proximity_against_pointer_walks(spark):
    rng = random.Random(5)
    cases = []
    for i in range(600):
        cases.append((i, [sorted(rng.sample(range(30), rng.randint(1, 9))) for _ in range(rng.randint(2, 4))], rng.randint(1, 8)))
    df = spark.createDataFrame(cases, "i int, lists array<array<int>>, n int")
    rows = df.select("lists", "n", proximity.near(F.col("lists"), F.col("n")).alias("near"), proximity.window(F.col("lists"), F.col("n")).alias("window")).collect()
    for r in rows:
        assert list(r["near"]) == walk_near(r["lists"], r["n"])
        assert list(r["window"]) == walk_window(r["lists"], r["n"])


@pytest.fixture(scope="module")
def index(spark):
    docs = [("d1", "white house on the white lawn", "White House"), ("d2", "the house is white", "Houses"), ("d10", "a lawn", None), ("d3", None, "empty")]
    return Index(spark.createDataFrame(docs, "ext_id string, body string, title string"), ("body", "title"))


def ranked(df):
    return [(r["qid"], r["rank"], r["ext_id"], r["score"]) for r in df.orderBy("qid", "rank").collect()]


def test_boolean_models(index):
    got = retrieval.top(retrieval.evaluate(index, {"a": "white house", "b": "#or( lawn #syn( white house ) )", "c": "zzz"}, retrieval.Model("RankedBoolean")))
    assert ranked(got) == [("a", 1, "d1", 1.0), ("a", 2, "d2", 1.0), ("b", 1, "d1", 3.0), ("b", 2, "d2", 2.0), ("b", 3, "d10", 1.0)]
    with pytest.raises(ValueError):
        retrieval.evaluate(index, {"a": "#sum( white house )"}, retrieval.Model("RankedBoolean"))


def test_fields_and_ties(index):
    got = retrieval.top(retrieval.evaluate(index, {"a": "#or( white.title lawn )"}, retrieval.Model("UnrankedBoolean")))
    assert ranked(got) == [("a", 1, "d1", 1.0), ("a", 2, "d10", 1.0)]


def test_empty_queries(spark, index):
    got = retrieval.evaluate(Index(index.docs, ("body",), Analyzer(frozenset({"the"}))), {"a": "the"}, retrieval.Model())
    assert got.count() == 0
    lines = files.run_lines(spark.createDataFrame([("a",)], "qid string"), retrieval.top(got)).collect()
    assert lines[0]["line"] == "a Q0 Nonexistent_Docid 1 0.000000000000 reference"


def test_stopword_positions(index):
    some = Index(index.docs, ("body",), Analyzer(frozenset({"the", "on"})))
    ids = lambda q: [r["ext_id"] for r in retrieval.evaluate(some, {"a": q}, retrieval.Model("UnrankedBoolean")).collect()]
    assert ids("#near/1( house white )") == [] and ids("#near/2( house white )") == ["d2"] and sorted(ids("#near/3( house of white )".replace("of", "on"))) == ["d1", "d2"]
    got = {r["ext_id"]: (r["len"], r["pos_len"]) for r in some.lengths().collect()}
    assert got == {"d1": (6, 6), "d2": (4, 4), "d10": (2, 2), "d3": (0, 0)}


def test_saved_index(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    index.save(path, 2)
    again = SavedIndex(spark, path, index.fields)
    for q in ("white house", "#near/1( white house ).".rstrip(".")):
        a, b = (ranked(retrieval.top(retrieval.evaluate(i, {"q": q}, retrieval.Model()), digits=9)) for i in (index, again))
        assert a == b and a


def test_fusion_and_merge(spark):
    run = lambda rows: spark.createDataFrame(rows, "qid string, rank int, ext_id string, score double")
    a, b = run([("q", 1, "x", 3.0), ("q", 2, "y", 2.0)]), run([("q", 1, "y", 9.0), ("q", 2, "z", 8.0)])
    order = lambda df: [r["ext_id"] for r in df.orderBy("rank").collect()]
    assert order(reranking.fuse(a, b)) == ["x", "y", "z"] and order(reranking.fuse(a, b, "union", 1)) == ["x", "y"]
    merged = reranking.merge_reranked(run([("q", 1, "x", 3.0), ("q", 2, "y", 2.0), ("q", 3, "z", 1.0)]), run([("q", 1, "y", 0.5), ("q", 2, "x", 0.4)])).orderBy("rank").collect()
    assert [r["ext_id"] for r in merged] == ["y", "x", "z"] and abs(merged[2]["score"] - 0.3) < 1e-9


def test_passages_and_prompts(spark):
    df = spark.createDataFrame([("t u v", "a b c d e f g"), (None, None)], "title string, body string")
    got = [r[0] for r in df.select(P.passages(F.col("title"), F.col("body"), 3, 2, 9, 1)).collect()]
    assert got == [["t a b c", "t c d e", "t e f g"], [""]]
    long = spark.createDataFrame([(["x" * 9000, "y" * 9000, "z" * 9000],)], "p array<string>").select(P.capped_prompt(F.lit("q"), F.col("p"), 7).alias("m")).select(F.octet_length(F.to_json("m")), F.col("m")[1]["content"]).first()
    assert long[0] <= P.PROMPT_BYTES and "y" in long[1] and "z" * 10 not in long[1]


def test_answers(spark):
    df = spark.createDataFrame([('\n Answer: "Paris"\nmore',), ("EXCEPTION:: x",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaned_reply(F.col("t"))).collect()] == ["Paris", "EXCEPTION:: x", ""]
    assert spark.createDataFrame([("The_Quick,  a fox!",)], "t string").select(normalized_answer(F.col("t"))).first()[0] == "quick fox"
    scores = evaluation.answer_scores(spark.createDataFrame([("1", "red fox"), ("2", "x")], "qid string, answer string"), spark.createDataFrame([("1", "a fox"), ("1", "the Red Fox")], "qid string, truth string"))
    assert sorted(map(tuple, scores.collect())) == [("1", 1.0, 1.0, 1.0), ("2", 0.0, 0.0, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "q.qry").write_text("1: white house: dropped\n\n b_2 : lawn\n")
    assert [tuple(r) for r in files.read_queries(spark, f"file://{tmp_path}/q.qry").collect()] == [("1", "white house"), ("b_2", "lawn")]
    (tmp_path / "r").write_text("1 Q0 d1 1 2.5 x\n1 Q0 d2 2 1.5 x\n")
    assert files.read_run(spark, f"file://{tmp_path}/r", 1).count() == 1
    assert files.numbers({"a": ["1", "x", "2.5", True]}) == {"a": [1, "x", 2.5, True]}


def test_runner(spark, index, tmp_path):
    (tmp_path / "second").write_text("1 Q0 d10 1 2.5 x\n")
    tasks = {
        "task_1:ranker": {"type": "BM25", "BM25:k_1": 1.2, "BM25:b": 0.75, "outputLength": 10},
        "task_2:rewriter": {"prf:algorithm": "rm3", "prf:numDocs": 2, "prf:numTerms": 3, "prf:rm3:origWeight": 0.5},
        "task_3:ranker": {"type": "BM25", "BM25:k_1": 1.2, "BM25:b": 0.75},
        "task_4:reranker": {"type": "bertrr", "rerankDepth": 1, "bertrr:psgLen": 3, "bertrr:psgStride": 2, "bertrr:psgCnt": 2, "bertrr:scoreAggregation": "maxp"},
        "task_5:reranker": {"type": "rankfusion", "rankfusion:secondaryRankPath": f"file://{tmp_path}/second"},
        "task_6:agent": {"agentDepth": 2, "rag:psgLen": 4, "rag:psgStride": 2, "rag:psgCnt": 2},
        "task_7:output": {"type": "trec_eval"},
        "task_8:output": {"type": "triviaqa_evaluation"},
    }
    batch = Runner(spark, index).run(tasks, {"1": "white house"})
    lines = [r["value"] for r in batch.outputs[0].collect()]
    assert any(" d10 " in x for x in lines) and '"1"' in batch.outputs[1].first()["value"]
    with pytest.raises(ValueError):
        Runner(spark, index).run({"task_1:dance": {}}, {"1": "white"})


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "ext_id string, vector array<double>")
    got = reranking.dense_top(spark.createDataFrame([("q", [2.0, 1.0])], "qid string, vector array<double>"), v, 2)
    assert ranked(got) == [("q", 1, "a", 2.0), ("q", 2, "c", 2.0)]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("d1", "white house white")], "ext_id string, body string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("ext_id string, body string").parquet(f"{tmp_path}/in")
    for name, df in (("postings", stream_postings(docs)), ("standing", standing_matches(docs, {"q": ["white", "house"], "r": ["lawn"]}))):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert {(r["term"], r["tf"]) for r in spark.table("postings").collect()} == {("white", 2), ("house", 1)}
    assert [tuple(r) for r in spark.table("standing").collect()] == [("q", "d1", 3)]


def test_inspection(index):
    from sparrowdex.__main__ import inspect

    assert {r["field"]: r["n_docs"] for r in inspect(index, "stats").collect()} == {"body": 4, "title": 4}
    assert [r["tf"] for r in inspect(index, "postings", "white", "1").collect()] == [2]
    assert inspect(index, "attribute", "d2", "title").first()[0] == "Houses" and inspect(index, "docids").count() == 4
    assert [r["term"] for r in inspect(index, "termvector", "d1", "title").collect()] == ["house", "white"]
    with pytest.raises(ValueError):
        inspect(index, "dance")
