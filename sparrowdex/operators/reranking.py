"""Rankings from rankings: fusion, reranking of a prefix, dense search, passage scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.passages import dot


def fuse(primary: DataFrame, secondary: DataFrame, method: str = "interleave", max_input: int | None = None, max_output: int = 1000) -> DataFrame:
    """One ranking of two. ``union``: the primary, then what only the secondary has. ``interleave``: in turn,
    primary first, without repeats. Scores count down to 1."""
    if method not in ("union", "interleave"):
        raise ValueError(f"unknown fusion {method!r}")
    if max_input is not None:
        secondary = secondary.where(F.col("rank") <= max_input)
    rows = primary.select("qid", "ext_id", "rank", F.lit(0).alias("src")).unionByName(secondary.select("qid", "ext_id", "rank", F.lit(1).alias("src")))
    key = F.struct("src", "rank") if method == "union" else F.struct((2 * (F.col("rank") - 1) + F.col("src")).alias("src"), F.lit(0).alias("rank"))
    rows = rows.groupBy("qid", "ext_id").agg(F.min(key).alias("key"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("key", "ext_id"))).where(F.col("rank") <= max_output)
    size = F.count("*").over(Window.partitionBy("qid"))
    return rows.select("qid", "rank", "ext_id", (size - F.col("rank") + 1).cast("double").alias("score"))


def merge_reranked(old: DataFrame, new: DataFrame) -> DataFrame:
    """A reranked head and the old tail below it.

    The tail keeps its order; if its first score isn't below the head's last, it is shifted so that it is, by 0.1.
    Queries without a reranked head keep the old ranking.
    """
    size = new.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    rows = old.join(size, "qid", "left").where(F.col("n").isNull() | (F.col("rank") > F.col("n")))
    first = rows.where(F.col("rank") == F.col("n") + 1).select("qid", F.greatest(F.lit(0.0), F.col("score") + 0.1 - F.col("least")).alias("shift"))
    tail = rows.join(first, "qid", "left").select("qid", "ext_id", (F.col("score") - F.coalesce("shift", F.lit(0.0))).alias("score"), "rank", F.lit(1).alias("part"))
    both = new.select("qid", "ext_id", "score", "rank", F.lit(0).alias("part")).unionByName(tail)
    return both.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("part", "rank")).alias("rank"), "ext_id", "score")


#: Query vectors that one search sends to all tasks.
DENSE_QUERIES = 4096


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Exact inner-product search: ``queries`` (qid, vector), a stated set sent out in blocks, against all ``vectors``
    (ext_id, vector). A task keeps its own best ``k`` of each query, so a task moves no more than that.
    """
    spark, asked = vectors.sparkSession, [(r["qid"], [float(x) for x in r["vector"]]) for r in queries.select("qid", "vector").toLocalIterator()]
    out = None
    for at in range(0, max(len(asked), 1), DENSE_QUERIES):
        part = _dense(spark.sparkContext.broadcast(asked[at : at + DENSE_QUERIES]), vectors, k, digits)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ext_id"))
    return out.select("qid", rank.alias("rank"), "ext_id", "score").where(F.col("rank") <= k)


def _dense(shared, vectors: DataFrame, k: int, digits: int | None) -> DataFrame:
    def work(batches):
        import numpy as np
        import pyarrow as pa

        asked = shared.value
        if not asked:
            return
        q, best = np.array([v for _, v in asked]), [[] for _ in asked]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            v = np.array(batch.column(1).to_pylist(), dtype=float).reshape(len(ids), -1)
            if not len(ids):
                continue
            found = v @ q.T
            if digits is not None:
                found = np.round(found, digits)
            for i in range(len(asked)):
                order = np.argsort(-found[:, i], kind="stable")
                least = found[order[min(k, len(order)) - 1], i]
                near = [(-found[j, i], ids[j]) for j in np.flatnonzero(found[:, i] >= least)]
                best[i] = sorted(best[i] + near)[:k]
        for (qid, _), rows in zip(asked, best):
            yield pa.RecordBatch.from_pydict({"qid": pa.array([qid] * len(rows), pa.string()), "ext_id": pa.array([e for _, e in rows], pa.string()), "score": pa.array([-s + 0.0 for s, _ in rows], pa.float64())})

    return vectors.select("ext_id", "vector").mapInArrow(work, "qid string, ext_id string, score double")


def embed(text, dimensions: int = 64):
    """A stand-in text encoder: signed hashes of words, summed by dimension and scaled to unit length."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    ones = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int").alias("d"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(ones, F.lit(0.0), lambda t, x: t + F.when(x["d"] == d, x["s"]).otherwise(0.0)))
    norm = F.sqrt(dot(raw, raw))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def passage_scores(rows: DataFrame, how: str) -> DataFrame:
    """Document scores from passage scores (qid, ext_id, psg_no, score): ``firstp``, ``avgp`` or ``maxp``."""
    made = {"firstp": F.min_by("score", "psg_no"), "avgp": F.avg("score"), "maxp": F.max("score")}
    if how not in made:
        raise ValueError(f"unknown aggregation {how!r}")
    return rows.groupBy("qid", "ext_id").agg(F.coalesce(made[how], F.lit(float("-inf"))).alias("score"))
