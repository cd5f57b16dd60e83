"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_answer


def run_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple = (5, 10, 20, 30), ndcg_cutoffs: tuple = (10, 20, 30), recall_cutoffs: tuple = (100, 1000), map_cutoffs: tuple = (1000,)) -> DataFrame:
    """metric, qid, value of each query that has relevant documents, and their means as qid ``all``.

    Runs are sorted by score, ties by descending external id, as the public evaluation tool does.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("ext_id"))
    judged = qrels.groupBy("qid", "ext_id").agg(F.max("rel").alias("rel"))
    need = judged.where("rel > 0").groupBy("qid").agg(F.count("*").alias("n_rel"), F.sort_array(F.collect_list("rel"), asc=False).alias("ideal"))
    ranked = run.select("qid", "ext_id", F.row_number().over(w).alias("r")).join(need.select("qid"), "qid", "left_semi").join(judged, ["qid", "ext_id"], "left")
    ranked = ranked.withColumn("rel", F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0))).withColumn("hit", (F.col("rel") > 0).cast("int"))
    ranked = ranked.withColumn("hits", F.sum("hit").over(Window.partitionBy("qid").orderBy("r")))
    gain = F.col("rel") / F.log2(F.col("r") + 1)
    aggs = [F.max(F.when(F.col("hit") == 1, 1.0 / F.col("r"))).alias("recip_rank"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("r"))).alias("map")]
    aggs += [F.sum(F.when((F.col("hit") == 1) & (F.col("r") <= k), F.col("hits") / F.col("r"))).alias(f"map_cut_{k}") for k in map_cutoffs]
    aggs += [F.sum(F.when(F.col("r") <= k, F.col("hit"))).alias(f"P_{k}") for k in cutoffs]
    aggs += [F.sum(F.when(F.col("r") <= k, F.col("hit"))).alias(f"recall_{k}") for k in recall_cutoffs]
    aggs += [F.sum(F.when(F.col("r") <= k, gain)).alias(f"ndcg_cut_{k}") for k in ndcg_cutoffs]
    raw = need.join(ranked.groupBy("qid").agg(*aggs), "qid", "left")
    values = {"recip_rank": F.col("recip_rank"), "map": F.col("map") / F.col("n_rel")}
    values |= {f"map_cut_{k}": F.col(f"map_cut_{k}") / F.col("n_rel") for k in map_cutoffs}
    values |= {f"P_{k}": F.col(f"P_{k}") / k for k in cutoffs}
    values |= {f"recall_{k}": F.col(f"recall_{k}") / F.col("n_rel") for k in recall_cutoffs}
    best = lambda k: F.aggregate(F.transform(F.slice("ideal", 1, k), lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    values |= {f"ndcg_cut_{k}": F.col(f"ndcg_cut_{k}") / best(k) for k in ndcg_cutoffs}
    each = raw.select("qid", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(v, F.lit(0.0)).cast("double").alias("value")) for m, v in values.items()))).alias("x")).select("x.metric", "qid", "x.value")
    return each.unionByName(each.groupBy("metric").agg(F.avg("value").alias("value")).select("metric", F.lit("all").alias("qid"), "value"))


def win_tie_loss(new: DataFrame, base: DataFrame, metric: str = "map", margin: float = 0.02) -> DataFrame:
    """wins, ties, losses of a metric by query: a relative change of at least ``margin``; over a base of 0, any gain wins."""
    pick = lambda df, name: df.where((F.col("metric") == metric) & (F.col("qid") != "all")).select("qid", F.col("value").alias(name))
    both = pick(new, "n").join(pick(base, "b"), "qid")
    change = (F.col("n") - F.col("b")) / F.col("b")
    kind = F.when(F.col("b") == 0, F.when(F.col("n") > 0, "win").otherwise("tie")).when(change >= margin, "win").when(change <= -margin, "loss").otherwise("tie")
    return both.select(kind.alias("k")).agg(*(F.count_if(F.col("k") == k).alias(a) for k, a in (("win", "wins"), ("tie", "ties"), ("loss", "losses"))))


def numbered_words(texts: DataFrame) -> DataFrame:
    """text and words of each distinct text: the n-th time that a word occurs has the number n, so bags compare as sets."""
    words = texts.select("text").where("text IS NOT NULL").distinct()
    times = words.select("text", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("text", "w").agg(F.count("*").cast("int").alias("n"))
    named = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws(" ", "w", i.cast("string")))
    return times.groupBy("text").agg(F.flatten(F.collect_list(named)).alias("words"))


def answer_scores(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """qid, em, f1, oracle of predictions (qid, answer) against truths (qid, truth; several a question).

    The best truth counts. ``oracle`` says whether a truth is contained in the answer. Without truths all are 0.
    """
    rows = predictions.select("qid", normalized_answer(F.col("answer")).alias("p")).join(truths.select("qid", normalized_answer(F.col("truth")).alias("t")), "qid", "left")
    bags = numbered_words(rows.select(F.explode(F.array("p", "t")).alias("text")))
    for side in ("p", "t"):
        rows = rows.join(bags.select(F.col("text").alias(side), F.col("words").alias(f"{side}_words")), side, "left")
    same, size = F.size(F.array_intersect("p_words", "t_words")), F.size("p_words") + F.size("t_words")
    f1 = F.when(same > 0, 2.0 * same / size).otherwise(0.0)
    return rows.groupBy("qid").agg(F.max(F.coalesce((F.col("p") == F.col("t")).cast("double"), F.lit(0.0))).alias("em"), F.max(F.coalesce(f1, F.lit(0.0))).alias("f1"), F.max(F.coalesce(((F.col("t") != "") & F.contains("p", F.col("t"))).cast("double"), F.lit(0.0))).alias("oracle"))


def answer_report(scores: DataFrame) -> DataFrame:
    """Percentages over all predictions."""
    return scores.agg(*(F.coalesce(F.avg(c) * 100, F.lit(0.0)).alias(n) for c, n in (("em", "exact_match"), ("f1", "f1"), ("oracle", "oracle"))), F.count("*").alias("n"))


def answer_place(docs: DataFrame, truths: DataFrame) -> DataFrame:
    """qid, ext_id, place (from 0) of the first truth, in the order of its place, in the lower-case text of ``docs`` (qid, ext_id, text); -1 if none is there."""
    rows = docs.join(truths, "qid", "left")
    at = F.expr("locate(lower(truth), lower(text)) - 1")
    return rows.groupBy("qid", "ext_id").agg(F.coalesce(F.min(F.when(at >= 0, at)), F.lit(-1)).alias("place"))


def pivot_metrics(files: DataFrame) -> DataFrame:
    """One row for each metric and query, one column for each run, from file, metric, qid, value."""
    return files.groupBy("metric", "qid").pivot("file").agg(F.first("value"))
