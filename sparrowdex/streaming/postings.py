"""Documents that arrive as a stream: their postings, and standing queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer


def stream_postings(docs: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """ext_id, term, tf, positions of each arriving document (ext_id, body); no state is kept, so it runs in append mode."""
    tokens = F.transform(analyzer.tokens(F.col("body")), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    terms = F.array_distinct(F.transform(F.filter(tokens, lambda x: analyzer.is_indexed(x["t"])), lambda x: x["t"]))
    found = docs.select("ext_id", tokens.alias("k"), F.explode(terms).alias("term"))
    positions = F.transform(F.filter("k", lambda x: x["t"] == F.col("term")), lambda x: x["i"])
    return found.select("ext_id", "term", F.size(positions).alias("tf"), positions.alias("positions"))


def standing_matches(docs: DataFrame, queries: dict[str, list[str]], analyzer: Analyzer = Analyzer()) -> DataFrame:
    """qid, ext_id, hits: arriving documents that hold all terms of a standing query."""
    words = analyzer.tokens(F.col("body"))
    asked = F.array(*(F.struct(F.lit(q).alias("qid"), F.array(*map(F.lit, t)).alias("terms")) for q, t in queries.items()))
    rows = docs.select("ext_id", words.alias("words"), F.explode(asked).alias("q"))
    hits = F.size(F.filter("words", lambda w: F.array_contains(F.col("q.terms"), w)))
    return rows.where(F.size(F.array_except("q.terms", "words")) == 0).select("q.qid", "ext_id", hits.alias("hits"))
