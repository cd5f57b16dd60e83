"""Evaluation of query batches: one relational plan for all queries of a batch.

The trees of a batch are flattened to a small table of nodes. One scan gives the postings of all terms;
positional operators and then score operators are folded level by level, each level one equi-join
with the (broadcast) nodes and one aggregation by query, node and document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import proximity
from ..plans.language import Node, default_query, parse, scored
from .index import Index

MODELS = ("UnrankedBoolean", "RankedBoolean", "BM25")
_ALLOWED = {"UnrankedBoolean": {"score", "and", "or"}, "RankedBoolean": {"score", "and", "or"}, "BM25": {"score", "sum", "wsum"}}
NODE_SCHEMA = "qid string, node int, parent int, arg int, level int, op string, weight double, distance int, field string, term string, n_args int"
#: Queries of one plan; longer batches are evaluated in several.
BATCH = 2000


@dataclass
class Model:
    name: str = "BM25"
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.name not in MODELS:
            raise ValueError(f"unknown retrieval model {self.name!r}")


@dataclass
class _Flat:
    rows: list = field(default_factory=list)

    def add(self, qid: str, node: Node, parent: int, arg: int, weight: float) -> int:
        me = len(self.rows)
        self.rows.append(None)
        levels = [self.add(qid, a, me, i, node.weights[i] if node.weights else 1.0) for i, a in enumerate(node.args)]
        level = 1 + max(levels, default=-1)
        self.rows[me] = (qid, me, parent, arg, level, node.op, float(weight), node.distance, node.field, node.term, len(node.args))
        return level


def compile_batch(queries: dict[str, str], model: Model, index: Index) -> list[tuple]:
    """Node rows of all queries; queries without any term have none."""
    flat = _Flat()
    for qid, text in queries.items():
        tree = scored(parse(default_query(text, model.name), index.analyzer))
        if tree is not None:
            _check(tree, model)
            flat.add(qid, tree, -1, 0, 1.0)
    return flat.rows


def _check(node: Node, model: Model) -> None:
    if node.op in ("score", "and", "or", "sum", "wsum"):
        if node.op not in _ALLOWED[model.name]:
            raise ValueError(f"#{node.op} isn't defined for {model.name}")
        for a in node.args:
            _check(a, model)


def evaluate(index: Index, queries: dict[str, str], model: Model) -> DataFrame:
    """qid, ext_id, score of every match."""
    spark = index.docs.sparkSession
    items = list(queries.items())
    out = None
    for at in range(0, max(len(items), 1), BATCH):
        rows = compile_batch(dict(items[at : at + BATCH]), model, index)
        part = _evaluate(index, rows, model) if rows else spark.createDataFrame([], "qid string, ext_id string, score double")
        out = part if out is None else out.unionByName(part)
    return out


def _evaluate(index: Index, rows: list[tuple], model: Model) -> DataFrame:
    spark = index.docs.sparkSession
    made = lambda keep: F.broadcast(spark.createDataFrame([r for r in rows if keep(r)], NODE_SCHEMA))
    leaf = made(lambda r: r[5] == "term")
    postings = index.postings(leaf, {(r[8], r[9]) for r in rows if r[5] == "term"})
    readers = lambda kept: {(r[0], r[2]) for r in kept}
    # frames of each level stay apart, each with the nodes that read it, so that a level reads only its arguments
    lists = [(readers(r for r in rows if r[5] == "term"), leaf.join(postings, ["field", "term"]).select("qid", "node", "parent", "arg", "ext_id", "positions"))]
    levels = sorted({r[4] for r in rows})
    # positional operators, from the terms up
    for level in levels:
        here = [r for r in rows if r[4] == level and r[5] in ("syn", "near", "window")]
        if not here:
            continue
        nodes = made(lambda r, here=here: r in here).select("qid", F.col("node").alias("op_node"), "op", "distance", "n_args", F.col("parent").alias("up"), F.col("arg").alias("up_arg"))
        below = _read(lists, here).withColumnRenamed("parent", "op_node").join(nodes, ["qid", "op_node"])
        grouped = below.groupBy("qid", "op_node", "op", "distance", "n_args", "up", "up_arg", "ext_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("arg", "positions"))), lambda x: x["positions"]).alias("args"))
        grouped = grouped.where((F.col("op") == "syn") | (F.size("args") == F.col("n_args")))
        kinds = {r[5] for r in here}
        places = F.lit(None).cast("array<int>")
        for kind, fold in (("window", lambda: proximity.window(F.col("args"), F.col("distance"))), ("near", lambda: proximity.near(F.col("args"), F.col("distance"))), ("syn", lambda: proximity.synonyms(F.col("args")))):
            if kind in kinds:
                places = F.when(F.col("op") == kind, fold()).otherwise(places)
        found = grouped.select("qid", F.col("op_node").alias("node"), F.col("up").alias("parent"), F.col("up_arg").alias("arg"), "ext_id", places.alias("positions")).where(F.size("positions") > 0)
        lists.append((readers(here), found))
    score_nodes = made(lambda r: r[5] == "score").select("qid", F.col("node").alias("op_node"), "field", "weight", F.col("parent").alias("up"), F.col("arg").alias("up_arg"))
    leaves = [r for r in rows if r[5] == "score"]
    hits = _read(lists, leaves).withColumnRenamed("parent", "op_node").join(score_nodes, ["qid", "op_node"]).select("qid", "op_node", "field", "weight", "up", "ext_id", F.size("positions").cast("double").alias("tf"))
    scores = hits.select("qid", F.col("op_node").alias("node"), F.col("up").alias("parent"), "weight", "ext_id", score(index, hits, model).alias("score")) if model.name != "BM25" else bm25(index, hits, model)
    scores = [(readers(leaves), scores)]
    # score operators
    for level in levels:
        here = [r for r in rows if r[4] == level and r[5] in ("and", "or", "sum", "wsum")]
        if not here:
            continue
        nodes = made(lambda r, here=here: r in here).select("qid", F.col("node").alias("op_node"), "op", "n_args", F.col("parent").alias("up"), F.col("weight").alias("up_weight"))
        below = _read(scores, here).withColumnRenamed("parent", "op_node").join(nodes, ["qid", "op_node"])
        grouped = below.groupBy("qid", "op_node", "op", "n_args", "up", "up_weight", "ext_id").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.sum("score").alias("total"), F.sum(F.col("weight") * F.col("score")).alias("weighted"))
        value = F.when(F.col("op") == "and", F.col("least")).when(F.col("op") == "or", F.col("most")).when(F.col("op") == "sum", F.col("total")).otherwise(F.col("weighted"))
        grouped = grouped.where((F.col("op") != "and") | (F.col("n") == F.col("n_args")))
        scores.append((readers(here), grouped.select("qid", F.col("op_node").alias("node"), F.col("up").alias("parent"), F.col("up_weight").alias("weight"), "ext_id", value.alias("score"))))
    return _read(scores, [(q, -1) for q in {r[0] for r in rows}]).where("parent = -1").select("qid", "ext_id", "score")


def _read(frames: list[tuple[set, DataFrame]], nodes: list[tuple]) -> DataFrame:
    """The frames that hold arguments of some nodes (qid, node, ...), together."""
    wanted, out = {(n[0], n[1]) for n in nodes}, None
    for by, frame in frames:
        if by & wanted:
            out = frame if out is None else out.unionByName(frame)
    return out


def score(index: Index, hits: DataFrame, model: Model):
    """Boolean scores of a positional node's match."""
    return F.lit(1.0) if model.name == "UnrankedBoolean" else F.col("tf")


def bm25_weight(tf, df, length, mean, n_docs, k1: float, b: float):
    """Term weight: inverse document frequency over all documents, saturated term frequency."""
    return F.log((n_docs + 1) / (df + F.lit(0.5))) * tf / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / mean))


def bm25(index: Index, hits: DataFrame, model: Model) -> DataFrame:
    """Scores of positional nodes; a composite node's document frequency is that of its own matches."""
    df = F.broadcast(hits.groupBy("qid", "op_node").agg(F.count("*").alias("df")))  # a row for each node of the batch
    lengths = index.lengths()
    stats = F.broadcast(index.stats(lengths))  # a row for each field
    rows = hits.join(df, ["qid", "op_node"]).join(lengths.select("field", "ext_id", "len"), ["field", "ext_id"]).join(stats, "field")
    value = bm25_weight(F.col("tf"), F.col("df"), F.col("len"), F.col("sum_len") / F.col("doc_count"), F.col("n_docs"), model.k1, model.b)
    return rows.select("qid", F.col("op_node").alias("node"), F.col("up").alias("parent"), "weight", "ext_id", value.alias("score"))


def weighted_terms(index: Index, terms: DataFrame, model: Model) -> DataFrame:
    """qid, ext_id, score of queries given as a table (qid, field, term, weight): a weighted sum whose terms may come from data."""
    wanted = terms.groupBy("qid", "field", "term").agg(F.sum("weight").alias("weight"))
    hits = index.postings(wanted).join(F.broadcast(wanted), ["field", "term"])
    df = hits.groupBy("field", "term").agg(F.count_distinct("ext_id").alias("df"))
    lengths = index.lengths()
    rows = hits.join(df, ["field", "term"]).join(lengths.select("field", "ext_id", "len"), ["field", "ext_id"]).join(F.broadcast(index.stats(lengths)), "field")
    value = bm25_weight(F.col("tf"), F.col("df"), F.col("len"), F.col("sum_len") / F.col("doc_count"), F.col("n_docs"), model.k1, model.b)
    return rows.groupBy("qid", "ext_id").agg(F.sum(F.col("weight") * value).alias("score"))


def top(scores: DataFrame, k: int = 1000, digits: int | None = None) -> DataFrame:
    """qid, rank, ext_id, score: by score, then by external id, the first ``k`` of each query."""
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ext_id"))
    return scores.select("qid", rank.alias("rank"), "ext_id", "score").where(F.col("rank") <= k)
