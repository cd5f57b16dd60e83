"""Experiments from parameters: tasks that pass rankings of a query batch from one to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions.text import cleaned_reply
from ..operators import evaluation, feedback, ltr, reranking, retrieval
from ..operators.index import Index
from ..sources import files
from .language import bag_of_words


@dataclass
class Batch:
    """Queries, and what tasks have made of them."""

    queries: dict[str, str]
    ranking: DataFrame | None = None
    answers: DataFrame | None = None
    prompts: DataFrame | None = None
    outputs: list[DataFrame] = field(default_factory=list)


def extractive_reply(question, context):
    """A stand-in for a language model: the sentence of the context with most of the question's words."""
    words = F.array_distinct(F.split(F.lower(question), r"[^\p{L}\p{N}]+"))
    sentences = F.filter(F.split(F.concat_ws(" ", context), r"(?<=[.!?])\s+"), lambda s: s != "")
    shared = F.transform(sentences, lambda s: F.size(F.array_intersect(words, F.split(F.lower(s), r"[^\p{L}\p{N}]+"))))
    return F.coalesce(F.try_element_at(sentences, F.array_position(shared, F.array_max(shared)).cast("int")), F.lit(""))


def overlap_score(query, passage):
    """A stand-in for a cross-encoder: the cosine of hashed word vectors."""
    return P.dot(reranking.embed(query), reranking.embed(passage))


class Runner:
    """Runs the tasks of an experiment over an index.

    ``dense_vectors`` is a table (ext_id, vector), ``encode`` a column function from text to vector, ``pair_score`` one
    from query and passage to a score, ``reply`` one from question and passages to a reply: models plug in there.
    """

    def __init__(self, spark: SparkSession, index: Index, dense_vectors: DataFrame | None = None, encode: Callable = reranking.embed, pair_score: Callable = overlap_score, reply: Callable = extractive_reply):
        self.spark, self.index, self.vectors, self.encode, self.pair_score, self.reply = spark, index, dense_vectors, encode, pair_score, reply
        self.tasks = {"ranker": self.rank, "rewriter": self.rewrite, "reranker": self.rerank, "agent": self.agent, "output": self.output}

    def run(self, parameters: dict, queries: dict[str, str] | None = None) -> Batch:
        if queries is None:
            queries = {r["qid"]: r["qstring"] for r in files.read_queries(self.spark, parameters["queryFilePath"]).collect()}
        batch = Batch(queries)
        for key, task in parameters.items():
            if key.startswith("task_"):
                name = key.partition(":")[2].strip().lower()
                if name not in self.tasks:
                    raise ValueError(f"unknown task {key!r}")
                self.tasks[name](batch, task)
        return batch

    def _queries(self, batch: Batch) -> DataFrame:
        return self.spark.createDataFrame(list(batch.queries.items()), "qid string, qstring string")

    def rank(self, batch: Batch, p: dict) -> None:
        kind, k = p["type"], p.get("outputLength", 1000)
        if kind == "inRankFile":
            run = files.read_run(self.spark, p["inRankFile:Path"])
            batch.ranking = run.join(F.broadcast(self._queries(batch)), "qid", "left_semi").select("qid", "rank", "ext_id", "score")
        elif kind == "dense":
            asked = self._queries(batch).select("qid", self.encode(F.col("qstring")).alias("vector"))
            batch.ranking = reranking.dense_top(asked, self._vectors(), k)
        else:
            model = retrieval.Model(kind, *((float(p["BM25:k_1"]), float(p["BM25:b"])) if kind == "BM25" else ()))
            batch.ranking = retrieval.top(retrieval.evaluate(self.index, batch.queries, model), k)

    def _vectors(self) -> DataFrame:
        return self.vectors if self.vectors is not None else self.index.docs.select("ext_id", self.encode(F.col("body")).alias("vector"))

    def rewrite(self, batch: Batch, p: dict) -> None:
        """Pseudo-relevance feedback; the next ranker's queries are the learned ones."""
        how = "rm3" if str(p.get("prf:algorithm", "okapi")).lower() == "rm3" else "okapi"
        terms = feedback.feedback_terms(self.index, batch.ranking, how, p.get("prf:numDocs", 0), p.get("prf:numTerms", 0), p.get("prf:expansionFieldIn", "body"))
        new = feedback.expanded(self._queries(batch), terms, how, float(p.get("prf:rm3:origWeight", 0.0)), p.get("prf:expansionFieldOut", "body"))
        batch.queries = {r["qid"]: r["qstring"] for r in new.collect()}  # a row for each query of the batch
        if p.get("prf:expansionQueryFile"):
            files.query_lines(self._queries(batch)).orderBy("qid").select("line").coalesce(1).write.mode("overwrite").text(p["prf:expansionQueryFile"])

    def rerank(self, batch: Batch, p: dict) -> None:
        kind, depth = str(p["type"]).lower(), p.get("rerankDepth", 1000)
        head = batch.ranking.where(F.col("rank") <= depth)
        if kind == "rankfusion":
            second = files.read_run(self.spark, p["rankfusion:secondaryRankPath"])
            batch.ranking = reranking.fuse(head, second, p.get("rankfusion:method", "interleave"), p.get("rankfusion:maxInputRank"), p.get("rankfusion:maxOutputRank", 1000))
            return
        if kind == "ltr":
            scores = self._ltr(batch, head, p)
        elif kind == "bertrr":
            made = self._passages(head, p, "bertrr:").select("qid", "ext_id", F.posexplode("passages").alias("psg_no", "passage"))
            scored = made.join(F.broadcast(self._queries(batch)), "qid").select("qid", "ext_id", "psg_no", self.pair_score(F.col("qstring"), F.col("passage")).alias("score"))
            scores = reranking.passage_scores(scored, p.get("bertrr:scoreAggregation", "firstp"))
        else:
            raise ValueError(f"unknown reranker {kind!r}")
        batch.ranking = reranking.merge_reranked(batch.ranking, retrieval.top(scores, depth))

    def _passages(self, head: DataFrame, p: dict, prefix: str) -> DataFrame:
        get = lambda name, default: p.get(prefix + name, default)
        title = F.col("title") if "title" in self.index.docs.columns else F.lit("")
        made = P.passages(title, F.col("body"), get("psgLen", 0), get("psgStride", 0), get("psgCnt", 1), get("maxTitleLength", 0))
        return head.join(self.index.docs.select("ext_id", made.alias("passages")), "ext_id")

    def _ltr(self, batch: Batch, head: DataFrame, p: dict) -> DataFrame:
        off = ltr.disabled_features(p.get("ltr:featureDisable"))
        use = tuple(n for n in ltr.ALL_FEATURES if n not in off)
        args = {"disabled": off, "k1": p.get("ltr:BM25:k_1", 1.2), "b": p.get("ltr:BM25:b", 0.75), "mu": p.get("ltr:QL:mu", 2500.0)}
        svm = str(p.get("ltr:toolkit", "RankLib")).lower() == "svmrank"
        trainer = "svmrank" if svm else {4: "coordinate_ascent", 7: "listnet"}.get(p.get("ltr:RankLib:model"), "coordinate_ascent")
        asked = {r["qid"]: bag_of_words(r["qstring"]) for r in files.read_queries(self.spark, p["ltr:trainingQueryFile"]).collect()}
        qrels = files.read_qrels(self.spark, p["ltr:trainingQrelsFile"]).where(F.col("qid").isin(list(asked)))
        judged = ltr.features(self.index, asked, qrels.select("qid", "ext_id").distinct(), **args)
        found = ltr.features(self.index, {q: bag_of_words(t) for q, t in batch.queries.items()}, head.select("qid", "ext_id"), **args)
        if svm:
            judged, found = ltr.minmax(judged, use), ltr.minmax(found, use)
        extra = {"c": p.get("ltr:svmRankParamC", 0.001)} if svm else {}
        weights = ltr.TRAINERS[trainer](ltr.training_rows(judged, qrels), use, **extra)
        return ltr.linear_scores(found, weights, use)

    def agent(self, batch: Batch, p: dict) -> None:
        depth = p.get("agentDepth", 1)
        if depth <= 0:
            raise ValueError("agentDepth must be positive")
        asked = F.broadcast(self._queries(batch))
        rows = self._passages(batch.ranking.where(F.col("rank") <= depth), p, "rag:").join(asked, "qid")
        scores = F.transform("passages", lambda x: P.dot(self.encode(x), self.encode(F.col("qstring"))))
        best = rows.select("qid", "qstring", "rank", P.best_passage(F.col("passages"), scores).alias("passage"))
        context = best.groupBy("qid", "qstring").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]).alias("context"))
        batch.prompts = context.select("qid", P.capped_prompt(F.col("qstring"), F.col("context"), p.get("rag:prompt", 1)).alias("prompt"))
        if p.get("rag:promptPath"):
            files.prompt_lines(batch.prompts).orderBy("qid").select("line").coalesce(1).write.mode("overwrite").text(p["rag:promptPath"])
        batch.answers = context.select("qid", cleaned_reply(self.reply(F.col("qstring"), F.col("context"))).alias("answer"))

    def output(self, batch: Batch, p: dict) -> None:
        kind, queries = p["type"], self._queries(batch)
        if kind == "trec_eval":
            rows = files.run_lines(queries, batch.ranking, p.get("outputLength", 1000)).orderBy("qid", "rank").select(F.col("line").alias("value"))
        elif kind == "triviaqa_evaluation":
            rows = files.answers_json(queries, batch.answers)
        else:
            raise ValueError(f"unknown output {kind!r}")
        batch.outputs.append(rows)
        if p.get("outputPath"):
            rows.coalesce(1).write.mode("overwrite").text(p["outputPath"])


def evaluate(batch: Batch, qrels: DataFrame) -> DataFrame:
    return evaluation.run_metrics(batch.ranking, qrels)
