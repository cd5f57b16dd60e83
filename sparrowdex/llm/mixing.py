"""Mixing sources to target weights with soft domains (operator 3).

A multinomial naive Bayes classifier, fitted on documents of a labelled table, gives each document a
posterior over domains; its tokens count towards all domains in these shares. Projected gradient
descent then finds nonnegative rates r, one for each document, for which the expected domain totals

    T_k = sum over documents of r * tokens * posterior_k

meet the targets in the least squares of relative errors, starting from rate 1 and so staying near
it. Steps are taken in the metric of tokens, so that documents of equal posterior move equally. A round
needs only the K domain totals: each document's rate is its own fold over the rounds' step
vectors. Everything runs in SQL functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the classifier is fitted on at most: those with the least hashes of their ids.
SAMPLE = 5_000
#: Least share of the labelled tokens of a word with probabilities of its own; others share one entry.
SHARE = 1e-4
#: A document's evidence counts as that of so many words at most, which keeps memberships soft.
EVIDENCE = 6.0
#: Rounds of projected gradient at most, and the relative error at which they end.
ROUNDS, NEAR = 60, 1e-6
#: Where the best step lowers the errors by less than this share they are the least; lengths of the scaled step.
SETTLED, LENGTHS = 1e-4, (1.0, 0.5, 0.25, 0.1, 0.02)
WORDS = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Words of a text in lower case; none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def fit(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, sample: int = SAMPLE) -> tuple[list[str], dict, DataFrame]:
    """Domains, their log priors and default log probabilities, and a table word, lp (log probability by domain).

    ``labelled`` holds ids and domains; null ones are left out, and an id with several domains takes the least.
    """
    spark = docs.sparkSession
    chosen = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(id_col).agg(F.min(F.col(domain_col).cast("string")).alias("__domain"))
    chosen = common.checkpoint(chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample))
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most ``sample`` ids
    counts = rows.select("__domain", F.explode(words(F.col(text_col))).alias("word")).groupBy("word").pivot("__domain", domains := sorted(r[0] for r in chosen.select("__domain").distinct().collect())).count().fillna(0) if chosen.count() else None
    if counts is None:
        return [], {}, spark.createDataFrame([], "word string, lp array<double>")
    counts = common.checkpoint(counts)
    names = [F.col(f"`{d}`") for d in domains]
    totals = np.array(counts.agg(*(F.sum(n) for n in names)).first(), dtype=float)
    every = sum(names[1:], names[0])
    found = counts.where(every >= SHARE * float(np.nansum(totals))).orderBy(F.desc(every), "word").limit(int(1 / SHARE)).collect()
    totals = np.nan_to_num(totals)
    table = np.array([r[1:] for r in found], float).reshape(-1, len(domains))
    other = totals - table.sum(0)
    mass = totals + len(found) + 1
    lp = np.log(table + 1) - np.log(mass)
    prior = {r[0]: r[1] for r in chosen.groupBy("__domain").count().collect()}
    prior = np.array([prior[d] for d in domains], float)
    model = {"prior": np.log(prior / prior.sum()).tolist(), "other": (np.log(other + 1) - np.log(mass)).tolist()}
    return domains, model, spark.createDataFrame([(r[0], v.tolist()) for r, v in zip(found, lp)], "word string, lp array<double>")


def memberships(docs: DataFrame, domains: list[str], model: dict, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, tokens, p (posterior by domain) for each document, where ``row`` tells rows apart by id and text."""
    k = len(domains)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), words(F.col(text_col)).alias("w"))
    # the sums of a document's words are made in the task that reads it, before anything is moved
    each = rows.select("row", F.explode_outer("w").alias("word")).join(F.broadcast(table), "word", "left")  # at most 1 / SHARE words
    sums = each.groupBy("row").agg(F.count("word").alias("n"), F.count("lp").alias("known"), *(F.sum(F.element_at("lp", i + 1)).alias(f"s{i}") for i in range(k)))
    same = docs.groupBy(F.xxhash64(id_col, text_col).alias("row")).agg(F.count("*").alias("same"))
    sums = sums.join(same, "row")
    logs = F.array(*(F.lit(model["prior"][i]) + (F.coalesce(f"s{i}", F.lit(0.0)) + (F.col("n") - F.col("known")) * model["other"][i]) / F.greatest(F.lit(1.0), F.col("n") / EVIDENCE) for i in range(k)))
    soft = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    p = F.transform(soft, lambda x: x / F.aggregate(soft, F.lit(0.0), lambda s, y: s + y))
    return sums.select("row", (F.col("n") / F.col("same")).cast("long").alias("tokens"), "same", p.alias("p"))


def moved(r: Column, step: Column) -> Column:
    """A rate less the step along the document's posterior, but never below 0."""
    return F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(step, F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))


def _array(step) -> Column:
    return F.array(*(F.lit(float(x)) for x in step))


def rate(steps: list[list[float]]) -> Column:
    """A document's rate after the rounds, from 1."""
    return F.aggregate(F.array(*map(_array, steps)), F.lit(1.0), moved) if steps else F.lit(1.0)


def solve(members: DataFrame, target: np.ndarray) -> list[list[float]]:
    """The step vectors of projected gradient descent on the squared relative errors of the expected totals.

    A round scales the gradient by the second derivatives over the documents that may move (rate above 0, or
    drawn up), as a least squares problem of the domains' size. One query tries this step in several lengths and the plain
    gradient, with the step that its largest eigenvalue allows; the best is taken.
    """
    k = len(target)
    tokens = F.col("tokens") * F.col("same")
    p = [F.element_at("p", i + 1) for i in range(k)]
    at = [(i, j) for i in range(k) for j in range(i, k)]
    positive = np.where(target > 0, target, max(target.sum(), 1.0))
    rows = lambda steps: members.select(tokens.alias("t"), rate(steps).alias("r"), "p")

    def second(steps: list[list[float]], pull) -> np.ndarray:
        """Second derivatives by domains over the documents that may move."""
        free = F.col("t") * ((F.col("r") > 0) | (F.aggregate(F.zip_with(_array(pull), F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) < 0)).cast("double")
        out = np.zeros((k, k))
        for (i, j), v in zip(at, rows(steps).agg(*(F.sum(free * p[i] * p[j]) for i, j in at)).first()):
            out[i, j] = out[j, i] = v or 0.0
        return out

    def errors(steps: list[list[float]], tries: list) -> np.ndarray:
        """Relative errors of the totals after each of some further steps."""
        sums = [F.sum(F.col("t") * moved(F.col("r"), _array(x)) * e) for x in tries for e in p]
        found = np.array([x or 0.0 for x in rows(steps).agg(*sums).first()]).reshape(len(tries), k)
        return (found - target) / positive

    gram = second([], np.zeros(k))
    top = float(np.linalg.eigvalsh(gram / np.outer(positive, positive)).max())
    steps: list[list[float]] = []
    if top <= 0:
        return steps
    error = errors(steps, [np.zeros(k)])[0]
    for n in range(ROUNDS):
        if np.abs(error).max() < NEAR:
            break
        pull = error / positive
        active = second(steps, pull) if n else gram
        scaled = np.linalg.lstsq(active / positive[:, None], error, rcond=1e-7)[0]
        tries = [*(part * scaled for part in LENGTHS), pull / top]
        found = errors(steps, tries)
        best = int(np.argmin(np.linalg.norm(found, axis=1)))
        if np.linalg.norm(found[best]) > (1 - SETTLED) * np.linalg.norm(error):  # the least that rates reach
            break
        steps, error = steps + [tries[best].tolist()], found[best]
    return steps


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep_all: bool = False) -> DataFrame:
    """``docs`` with tokens, domain_p (map of domain to posterior), rate and copies.

    ``weights`` are the wanted shares of the domains (0 where absent); ``total`` is the wanted number of tokens, by
    default as many as there are. With ``keep_all`` it is raised until no domain must shrink, so that every
    document keeps a rate of about 1 or more. ``copies`` is the rate's whole part, and one more for the share of
    documents, by a hash of the row, that its fraction says; with ``keep_all`` at least one. A null text has no
    tokens and the prior as posterior. Repeated rows have equal rates. Columns of the same names are replaced.
    """
    domains, model, table = fit(docs, labelled, id_col, text_col, domain_col)
    if not domains:
        domains, model = sorted(weights), {"prior": [-np.log(len(weights))] * len(weights), "other": [0.0] * len(weights)}
    members = common.checkpoint(memberships(docs, domains, model, table, id_col, text_col))
    now = np.array([x or 0.0 for x in members.agg(*(F.sum(F.col("tokens") * F.col("same") * F.element_at("p", i + 1)) for i in range(len(domains)))).first()])
    share = np.array([max(weights.get(d, 0.0), 0.0) for d in domains])
    share = share / share.sum() if share.sum() else np.full(len(domains), 1 / len(domains))
    wanted = float(now.sum()) if total is None else float(total)
    if keep_all:
        wanted = max([wanted, *(n / s for n, s in zip(now, share) if s > 0)])
    steps = solve(members, wanted * share)
    rates = members.select("row", "tokens", F.map_from_arrays(F.array(*(F.lit(d) for d in domains)), F.col("p")).alias("domain_p"), rate(steps).alias("rate"))
    drawn = F.pmod(F.xxhash64("row", F.lit("copies")), F.lit(1_000_003)) / 1_000_003.0
    copies = F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("long")
    rates = rates.withColumn("copies", F.greatest(copies, F.lit(1)) if keep_all else copies)
    keyed = docs.drop("tokens", "domain_p", "rate", "copies").withColumn("__mixed", F.xxhash64(id_col, text_col))
    return keyed.join(rates.withColumnRenamed("row", "__mixed"), "__mixed").drop("__mixed")


#: Target shares of the query's and the pipeline's domains.
WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def labelled_languages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The documents, and the languages of those that the table of labels names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    return docs, docs.select("doc_id", "lang").join(ids, "doc_id", "left_semi")


def op3_mixing(spark, sf_dir):
    docs, labelled = labelled_languages(spark, sf_dir)
    return mix(docs.select("doc_id", "text"), labelled, WEIGHTS).select("doc_id", "tokens", "domain_p", "rate", "copies")
