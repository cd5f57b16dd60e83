"""Learning to rank: twenty features, normalization, training and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .retrieval import bm25_weight

ALL_FEATURES = tuple(range(1, 21))
#: The features of each field: BM25, query likelihood, overlap.
FIELD_FEATURES = {"body": (5, 6, 7), "title": (8, 9, 10), "url": (11, 12, 13), "inlink": (14, 15, 16)}
#: Positions that count as the beginning of a body.
BEGINNING = 100
#: Judged rows that a model is fitted on at most; more is an error, not a silent sample.
MOST_ROWS = 2_000_000


def features(index: Index, queries: dict[str, str], candidates: DataFrame, disabled: tuple = (), k1: float = 1.2, b: float = 0.75, mu: float = 2500.0) -> DataFrame:
    """qid, ext_id, f1 to f20 of each candidate (qid, ext_id); a feature that a document has no data for is null.

    ``queries`` maps ids to bag-of-words strings. Stored attributes are columns of the index's documents:
    ``spam_score``, ``raw_url``, ``page_rank``; absent ones leave their features null.
    """
    spark = index.docs.sparkSession
    terms, pairs = [], []
    for qid, text in queries.items():
        words = index.analyzer.terms(text)
        terms += [(qid, t) for t in dict.fromkeys(words)]
        pairs += [(qid, i, a, c) for i, (a, c) in enumerate(zip(words, words[1:]))]
    fields = [f for f in FIELD_FEATURES if f in index.fields]
    asked = F.broadcast(spark.createDataFrame([(q, t, f) for q, t in terms for f in fields], "qid string, term string, field string"))
    docs = candidates.select("ext_id").distinct()
    few = Index(index.docs.join(docs, "ext_id", "left_semi"), index.fields, index.analyzer)
    lengths, lex = few.lengths(), index.lexicon().join(F.broadcast(asked.select("field", "term").distinct()), ["field", "term"], "left_semi")
    stats = F.broadcast(index.stats())
    # every (candidate, query term, field), with the term's frequency there, 0 if absent
    grid = candidates.select("qid", "ext_id").join(asked, "qid").join(F.broadcast(stats), "field").join(lengths, ["field", "ext_id"]).join(F.broadcast(lex), ["field", "term"], "left")
    grid = grid.join(few.postings(asked), ["field", "term", "ext_id"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    has = F.col("indexed") > 0
    mean = F.col("sum_len") / F.col("doc_count")
    weight = F.when((F.col("tf") > 0) & (F.col("doc_count") > 0) & (mean > 0), bm25_weight(F.col("tf"), F.col("df"), F.col("len"), mean, F.col("n_docs"), k1, b)).otherwise(0.0)
    prob = (F.col("tf") + mu * F.coalesce("ctf", F.lit(0)) / F.col("sum_len")) / (F.col("len") + mu)
    per_field = grid.groupBy("qid", "ext_id", "field").agg(
        F.first(has).alias("has"), F.sum(weight).alias("bm25"), F.count_if(F.col("tf") > 0).cast("double").alias("overlap"),
        F.when((F.max("tf") > 0) & (F.min(prob) > 0), F.exp(F.avg(F.log(F.when(prob > 0, prob))))).otherwise(0.0).alias("ql"),
        (F.sum("tf") / F.first("len")).alias("density"), F.count_if(F.exists("positions", lambda p: p < BEGINNING)).cast("double").alias("early"),
    )
    made = []
    for f, (x, y, z) in FIELD_FEATURES.items():
        at = (F.col("field") == f) & F.col("has")
        made += [F.max(F.when(at, F.col(c))).alias(f"f{n}") for n, c in ((x, "bm25"), (y, "ql"), (z, "overlap"))]
        if f == "body":
            made += [F.max(F.when(at, F.col("density"))).alias("f17"), F.max(F.when(at, F.col("early"))).alias("f20"), F.max(F.when(at, F.lit(True))).alias("has_body")]
    wide = per_field.groupBy("qid", "ext_id").agg(*made)
    # adjacent query terms at adjacent places of the body
    n_pairs = F.broadcast(spark.createDataFrame([(q, sum(p[0] == q for p in pairs)) for q in queries], "qid string, n_pairs int"))
    if pairs:
        two = F.broadcast(spark.createDataFrame(pairs, "qid string, i int, a string, c string"))
        bodies = few.postings(spark.createDataFrame([("body", t) for p in pairs for t in p[2:]], "field string, term string")).select("ext_id", "term", "positions")
        left, right = (bodies.select("ext_id", F.col("term").alias(t), F.col("positions").alias(f"p{t}")) for t in "ac")
        joined = candidates.select("qid", "ext_id").join(two, "qid").join(left, ["ext_id", "a"]).join(right, ["ext_id", "c"])
        phrases = joined.where(F.arrays_overlap(F.transform("pa", lambda p: p + 1), F.col("pc"))).groupBy("qid", "ext_id").agg(F.count("*").alias("phrases"))
    else:
        phrases = spark.createDataFrame([], "qid string, ext_id string, phrases long")
    attributes = {"f1": "spam_score", "raw_url": "raw_url", "f4": "page_rank"}
    stored = few.docs.select("ext_id", *((F.col(c) if c in index.docs.columns else F.lit(None)).cast("string" if n == "raw_url" else "double").alias(n) for n, c in attributes.items()))
    out = candidates.select("qid", "ext_id").join(wide, ["qid", "ext_id"], "left").join(stored, "ext_id", "left").join(phrases, ["qid", "ext_id"], "left").join(n_pairs, "qid", "left")
    url = F.col("raw_url")
    out = out.withColumn("f2", (F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))).cast("double")).withColumn("f3", F.contains(F.lower(url), F.lit("wikipedia.org")).cast("double"))
    out = out.withColumn("f18", F.when(F.col("has_body"), F.when(F.col("n_pairs") > 0, F.coalesce("phrases", F.lit(0)) / F.col("n_pairs")).otherwise(0.0)))
    strong = [n for n in (5, 8, 11, 14) if n not in disabled]
    out = out.withColumn("f19", sum((F.coalesce((F.col(f"f{n}") > 0).cast("double"), F.lit(0.0)) for n in strong), F.lit(0.0)) / 4)
    return out.select("qid", "ext_id", *((F.lit(None).cast("double") if n in disabled else F.col(f"f{n}").cast("double")).alias(f"f{n}") for n in ALL_FEATURES))


def disabled_features(value) -> tuple:
    """Ids from a comma-separated string, a number or a list."""
    if value is None or value == "":
        return ()
    if isinstance(value, (list, tuple)):
        return tuple(int(x) for x in value)
    return tuple(int(x) for x in str(value).split(",") if x.strip())


def minmax(vectors: DataFrame, features: tuple = ALL_FEATURES) -> DataFrame:
    """Each feature scaled to 0..1 within its query; missing values and constant features become 0."""
    w = Window.partitionBy("qid")

    def scaled(n: int):
        c = F.col(f"f{n}")
        least, most = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce(F.when(most > least, (c - least) / (most - least)), F.lit(0.0)).alias(f"f{n}")

    return vectors.select(*(c for c in vectors.columns if c not in {f"f{n}" for n in features}), *map(scaled, features))


def training_rows(vectors: DataFrame, qrels: DataFrame) -> DataFrame:
    """Vectors of judged documents with their label; negative judgments count as 0."""
    return vectors.join(qrels.select("qid", "ext_id", F.greatest("rel", F.lit(0)).cast("int").alias("label")), ["qid", "ext_id"])


def preference_pairs(rows: DataFrame, features: tuple = ALL_FEATURES) -> DataFrame:
    """qid, better, worse and feature differences of the judged pairs of a query with different labels."""
    a, b = (rows.select("qid", F.col("ext_id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label"), *(F.col(f"f{n}").alias(f"{s}{n}") for n in features)) for s in "ab")
    both = a.join(b, "qid").where("a_label > b_label")
    return both.select("qid", F.col("a_id").alias("better"), F.col("b_id").alias("worse"), *((F.coalesce(f"a{n}", F.lit(0.0)) - F.coalesce(f"b{n}", F.lit(0.0))).alias(f"d{n}") for n in features))


def _judged(rows: DataFrame, features: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = rows.select("qid", "ext_id", "label", *(F.coalesce(f"f{n}", F.lit(0.0)).alias(f"f{n}") for n in features)).limit(MOST_ROWS + 1).toPandas().sort_values(["qid", "ext_id"])
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} judged rows")
    return found["qid"].to_numpy(), found["label"].to_numpy(float), found[[f"f{n}" for n in features]].to_numpy(float)


def _groups(q: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(q == x) for x in dict.fromkeys(q.tolist())]


def train_ranksvm(rows: DataFrame, features: tuple = ALL_FEATURES, c: float = 0.001, rounds: int = 200) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + c * sum of hinge losses of the preference pairs, by subgradient steps."""
    q, y, x = _judged(rows, features)
    w = np.zeros(len(features))
    groups = _groups(q)
    for t in range(1, rounds + 1):
        slope = w.copy()
        for g in groups:
            s = x[g] @ w
            bad = (y[g][:, None] > y[g][None, :]) & (s[:, None] - s[None, :] < 1)
            slope -= c * (bad.sum(1) @ x[g] - bad.sum(0) @ x[g])
        w -= slope / (1 + t / 10)
    return w


def mean_average_precision(q: np.ndarray, y: np.ndarray, s: np.ndarray) -> float:
    out = []
    for g in _groups(q):
        rel = y[g][np.argsort(-s[g], kind="stable")] > 0
        if rel.any():
            out.append((np.cumsum(rel) / np.arange(1, len(rel) + 1))[rel].mean())
    return float(np.mean(out)) if out else 0.0


def train_coordinate_ascent(rows: DataFrame, features: tuple = ALL_FEATURES, rounds: int = 5, steps: tuple = (0.05, 0.2, 0.8)) -> np.ndarray:
    """Weights, one changed at a time, while mean average precision rises."""
    q, y, x = _judged(rows, features)
    w = np.full(len(features), 1.0 / max(len(features), 1))
    best = mean_average_precision(q, y, x @ w)
    for _ in range(rounds):
        before = best
        for i in range(len(w)):
            for step in (s * d for s in steps for d in (1, -1)):
                tried = w.copy()
                tried[i] += step
                value = mean_average_precision(q, y, x @ tried)
                if value > best + 1e-12:
                    best, w = value, tried
        if best <= before:
            break
    return w


def train_listnet(rows: DataFrame, features: tuple = ALL_FEATURES, rounds: int = 300, speed: float = 0.1) -> np.ndarray:
    """Weights that bring the softmax of the scores near that of the labels, by gradient steps."""
    q, y, x = _judged(rows, features)
    w = np.zeros(len(features))
    groups = _groups(q)
    soft = lambda v: (e := np.exp(v - v.max())) / e.sum()
    for _ in range(rounds):
        slope = sum(x[g].T @ (soft(x[g] @ w) - soft(y[g])) for g in groups)
        w -= speed * slope / max(len(groups), 1)
    return w


TRAINERS = {"svmrank": train_ranksvm, "coordinate_ascent": train_coordinate_ascent, "listnet": train_listnet}


def linear_scores(vectors: DataFrame, weights, features: tuple = ALL_FEATURES) -> DataFrame:
    """qid, ext_id, score: weighted sums of the features, missing ones as 0."""
    value = sum((F.coalesce(f"f{n}", F.lit(0.0)) * float(w) for n, w in zip(features, weights)), F.lit(0.0))
    return vectors.select("qid", "ext_id", value.alias("score"))
