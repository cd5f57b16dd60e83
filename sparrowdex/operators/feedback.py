"""Pseudo-relevance feedback: terms of the first documents, as a new query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index


def feedback_terms(index: Index, ranking: DataFrame, algorithm: str = "okapi", docs: int = 10, terms: int = 10, field_in: str = "body", digits: int = 10) -> DataFrame:
    """qid, term, score, rank: the best terms of each query's first documents.

    ``okapi``: documents of the feedback set that hold the term, times its Robertson-Sparck Jones weight, kept if above 0.
    ``rm3``: sum of (share of the document) * (document's score) * log(corpus tokens / term's tokens), addends above 0 only.
    Terms with a dot, a comma or characters beyond ASCII are left out. Ties go to the lesser term.
    """
    first = F.broadcast(ranking.where(F.col("rank") <= docs).select("qid", "ext_id", F.col("score").alias("doc_score")))  # the queries' first documents
    chosen = Index(index.docs.join(F.broadcast(first.select("ext_id").distinct()), "ext_id", "left_semi"), (field_in,), index.analyzer)
    counts = chosen.occurrences().groupBy("term", "ext_id").agg(F.count("*").alias("tf")).where(~F.col("term").rlike(r"[.,]|[^\x00-\x7F]"))
    rows = counts.join(first, "ext_id")
    whole = Index(index.docs, (field_in,), index.analyzer)
    lexicon = whole.lexicon().join(rows.select("term").distinct(), "term", "left_semi").select("term", "df", "ctf")
    stats = F.broadcast(whole.stats().select("sum_len", "n_docs"))  # one row
    if algorithm == "rm3":
        lengths = chosen.lengths().select("ext_id", "pos_len")
        rows = rows.join(lengths, "ext_id").join(lexicon, "term").join(stats)
        part = F.col("tf") / F.col("pos_len") * F.col("doc_score") * F.log(F.col("sum_len") / F.col("ctf"))
        found = rows.groupBy("qid", "term").agg(F.sum(F.when(part > 0, part).otherwise(0.0)).alias("score"))
    else:
        found = rows.groupBy("qid", "term").agg(F.count_distinct("ext_id").alias("rdf")).join(lexicon, "term").join(stats)
        rsj = F.greatest(F.lit(0.0), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        found = found.select("qid", "term", (F.col("rdf") * rsj).alias("score"))
    found = found.withColumn("score", F.round("score", digits)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= terms)


def weighted(terms: DataFrame, algorithm: str, field_out: str = "body") -> DataFrame:
    """qid, field, term, weight: rm3 weights sum to 1, okapi's are 1."""
    if algorithm == "rm3":
        total = F.sum("score").over(Window.partitionBy("qid"))
        weight = F.col("score") / F.when(total == 0, 1.0).otherwise(total)
    else:
        weight = F.lit(1.0)
    return terms.select("qid", F.lit(field_out).alias("field"), "term", weight.alias("weight"), "score")


def expanded(queries: DataFrame, terms: DataFrame, algorithm: str, orig_weight: float = 0.0, field_out: str = "body") -> DataFrame:
    """qid, qstring: the learned query, terms by ascending score; interpolated with the original if it has a weight."""
    suffix = "" if field_out == "body" else f".{field_out}"
    rows = weighted(terms, algorithm, field_out)
    text = F.format_string("%.20f %s", "weight", F.concat("term", F.lit(suffix))) if algorithm == "rm3" else F.concat("term", F.lit(suffix))
    rows = rows.groupBy("qid").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("score", "term", text.alias("t")))), lambda x: x["t"])).alias("body"))
    learned = F.concat(F.lit("#WSUM( " if algorithm == "rm3" else "#SUM( "), "body", F.lit(" )"))
    if orig_weight > 0:
        original = F.when(F.col("qstring").startswith("#"), F.col("qstring")).otherwise(F.concat(F.lit("#SUM( "), "qstring", F.lit(" )")))
        learned = F.concat(F.lit(f"#WSUM( {orig_weight:g} "), original, F.lit(f" {1 - orig_weight:g} "), learned, F.lit(" )"))
    return queries.join(rows, "qid", "left").select("qid", F.coalesce(learned, "qstring").alias("qstring"))
