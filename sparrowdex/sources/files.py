"""Text files of experiments: queries, judgments, runs, answers, parameters, feature vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a run holds for a query without results, and the name of runs.
NO_DOCUMENT, RUN_ID = "Nonexistent_Docid", "reference"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, qstring from lines ``qid: text``; text after a second colon is dropped, blank lines are skipped."""
    parts = F.split("value", ":")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).alias("qid"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("qstring"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, ext_id, rel from lines of four words."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].alias("qid"), parts[2].alias("ext_id"), parts[3].cast("int").alias("rel"))


def read_run(spark: SparkSession, path: str, max_rank: int | None = None) -> DataFrame:
    """qid, rank, ext_id, score, run_id from lines of six words."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 6).select(parts[0].alias("qid"), parts[3].cast("int").alias("rank"), parts[2].alias("ext_id"), parts[4].cast("double").alias("score"), parts[5].alias("run_id"))
    return rows if max_rank is None else rows.where(F.col("rank") <= max_rank)


def split_runs(run: DataFrame) -> DataFrame:
    """Queries whose ranks aren't 1, 2, 3 ...: their rows stood in several groups or were cut."""
    return run.groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks")).where("n <> last OR n <> ranks")


def run_lines(queries: DataFrame, ranking: DataFrame, k: int = 1000, run_id: str = RUN_ID) -> DataFrame:
    """qid, rank, line: a run's lines; a query without results has one line that says so."""
    rows = queries.select("qid").join(ranking.where(F.col("rank") <= k), "qid", "left")
    rows = rows.select("qid", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("ext_id", F.lit(NO_DOCUMENT)).alias("ext_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.select("qid", "rank", F.format_string(f"%s Q0 %s %d %.12f {run_id}", "qid", "ext_id", "rank", "score").alias("line"))


def write_run(queries: DataFrame, ranking: DataFrame, path: str, k: int = 1000) -> None:
    run_lines(queries, ranking, k).orderBy("qid", "rank").select("line").coalesce(1).write.mode("overwrite").text(path)


def answers_json(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """value: one JSON object of all answers by query; missing ones are empty."""
    rows = queries.select("qid").join(answers, "qid", "left").select("qid", F.coalesce("answer", F.lit("")).alias("answer"))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "answer"))))).alias("value"))


def prompt_lines(prompts: DataFrame) -> DataFrame:
    return prompts.select("qid", F.concat("qid", F.lit(": "), F.to_json("prompt")).alias("line"))


def query_lines(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.concat("qid", F.lit(": "), "qstring").alias("line"))


def vector_lines(rows: DataFrame, features: tuple, keep_missing: bool = True) -> DataFrame:
    """qid, ext_id, line: ``label qid:q f:v ...  # ext``; missing values are 0.0, or left out."""
    parts = [F.when(F.col(f"f{n}").isNotNull() | F.lit(keep_missing), F.format_string(f"{n}:%s", F.coalesce(f"f{n}", F.lit(0.0)).cast("string"))) for n in features]
    return rows.select("qid", "ext_id", F.concat(F.col("label").cast("string"), F.lit(" qid:"), "qid", F.lit(" "), F.concat_ws(" ", *parts), F.lit("  # "), "ext_id").alias("line"))


def read_metrics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """file, metric, qid, value of an evaluation's output."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 3).select(F.lit(name).alias("file"), parts[0].alias("metric"), parts[1].alias("qid"), parts[2].try_cast("double").alias("value")).where("value IS NOT NULL")


def read_trivia(spark: SparkSession, path: str, verified_only: bool = False) -> DataFrame:
    """qid, truth (one row for each alias) of a question file; web data are keyed by question and file."""
    data = spark.read.option("multiLine", True).json(path)
    web = F.lower("Domain") == "web" if "Domain" in data.columns else F.lit(False)
    rows = data.select(web.alias("web"), F.explode("Data").alias("d"))
    names = set(rows.schema["d"].dataType.names)
    if verified_only and "QuestionPartOfVerifiedEval" in names:
        rows = rows.where("d.QuestionPartOfVerifiedEval")
    truths = F.concat(F.coalesce("d.Answer.NormalizedAliases", F.array().cast("array<string>")), F.coalesce("d.Answer.HumanAnswers", F.array().cast("array<string>")) if "HumanAnswers" in rows.select("d.Answer.*").columns else F.array().cast("array<string>"))
    if "SearchResults" in names:
        files = F.when(F.col("web"), F.transform("d.SearchResults", lambda s: F.concat("d.QuestionId", F.lit("--"), s["Filename"])))
        keys = F.coalesce(files, F.array("d.QuestionId"))
    else:
        keys = F.array("d.QuestionId")
    return rows.select(F.explode(keys).alias("qid"), truths.alias("t")).select("qid", F.explode_outer("t").alias("truth"))


def numbers(value):
    """Strings that look like numbers as such, in nested lists and objects; other values as they are."""
    if isinstance(value, dict):
        return {k: numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [numbers(v) for v in value]
    if isinstance(value, str):
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
    return value


def lower_keys(value):
    if isinstance(value, dict):
        return {str(k).lower(): lower_keys(v) for k, v in value.items()}
    return [lower_keys(v) for v in value] if isinstance(value, list) else value


def read_parameters(path: str) -> dict:
    """The parameters of an experiment; its tasks keep their order."""
    with open(path, encoding="utf-8") as f:
        return numbers(json.load(f))
