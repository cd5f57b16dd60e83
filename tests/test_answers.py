"""Answers and replies: cases that are easy to get wrong."""

from pyspark.sql import functions as F

from sparrowdex.functions.text import cleaned_reply, normalized_answer
from sparrowdex.operators import evaluation


def mapped(spark, f, texts):
    return [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_normalized_answers(spark):
    cases = {"ançeau": "ançeau", "The ançeau, an a the end": "ançeau end", "Été_a 'the'": "été", "éa the": "éa", "a b the": "b", None: "", "theory an1": "theory an1"}
    assert mapped(spark, normalized_answer, list(cases)) == list(cases.values())


def test_cleaned_replies(spark):
    cases = {
        "Answer:\nParis\nmore": "Paris", "Answer:": "", "exact answer: 'Rome '": "Rome", "The answer is: x": "The answer is: x", "  EXCEPTION::a\nb  ": "EXCEPTION::a\nb",
        "\n \nfinal ANSWER:  b\r\nc": "b", '"q"': "q", "'": "'", "Short answer:\r\n\r\nAnswer: z": "z", None: "", "a b": "a",
    }
    assert mapped(spark, cleaned_reply, list(cases)) == list(cases.values())


def test_answer_scores_count_repeated_words(spark):
    said = spark.createDataFrame([("1", "b b c d"), ("2", "x"), ("3", "")], "qid string, answer string")
    truths = spark.createDataFrame([("1", "b c c"), ("1", "q"), ("3", "")], "qid string, truth string")
    rows = {r["qid"]: (r["em"], round(r["f1"], 6), r["oracle"]) for r in evaluation.answer_scores(said, truths).collect()}
    assert rows == {"1": (0.0, round(4 / 7, 6), 0.0), "2": (0.0, 0.0, 0.0), "3": (1.0, 0.0, 0.0)}
