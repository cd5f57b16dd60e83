"""The positional inverted index as DataFrames, and its inspection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Analyzer


#: Terms that a filter may list.
KNOWN = 1000


@dataclass
class Index:
    """Documents with fields, and how to analyze them.

    ``docs`` has ``ext_id`` (string) and a string column for each name of ``fields``; other columns are stored
    attributes. Postings are derived when asked for: with ``terms`` (a small table of field and term) only theirs
    are made, so a query never groups the whole vocabulary.
    """

    docs: DataFrame
    fields: tuple[str, ...] = ("body",)
    analyzer: Analyzer = Analyzer()

    def tokens(self) -> DataFrame:
        """ext_id, field, tokens (all, stopwords included)."""
        stack = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), self.analyzer.tokens(F.col(f)).alias("tokens")) for f in self.fields)))
        return self.docs.select("ext_id", stack.alias("x")).select("ext_id", "x.field", "x.tokens")

    def occurrences(self) -> DataFrame:
        """ext_id, field, pos, term for every indexed token; positions count the stopwords between."""
        rows = self.tokens().select("ext_id", "field", F.posexplode("tokens").alias("pos", "term"))
        return rows.where(self.analyzer.is_indexed(F.col("term")))

    def postings(self, terms: DataFrame | None = None, known: set[tuple[str, str]] | None = None) -> DataFrame:
        """field, term, ext_id, tf, positions.

        ``known`` states the same terms as (field, term) where the driver has them: other tokens then never leave their array.
        """
        if known is not None and len(known) <= KNOWN:
            found = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: x["term"].isin(*sorted({t for _, t in known})))
            rows = self.tokens().where(F.col("field").isin(*sorted({f for f, _ in known}))).select("ext_id", "field", F.explode(found).alias("x")).select("ext_id", "field", "x.pos", "x.term")
            rows = rows.where(self.analyzer.is_indexed(F.col("term")))
        else:
            rows = self.occurrences()
        if terms is not None:
            rows = rows.join(F.broadcast(terms.select("field", "term").distinct()), ["field", "term"], "left_semi")
        rows = rows.groupBy("field", "term", "ext_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
        return rows.select("field", "term", "ext_id", F.size("positions").alias("tf"), "positions")

    def lengths(self) -> DataFrame:
        """field, ext_id, len (all tokens), pos_len (up to the last indexed one), indexed (number of indexed ones)."""
        keep = F.filter(F.transform(F.col("tokens"), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: self.analyzer.is_indexed(x["t"]))
        return self.tokens().select("field", "ext_id", F.size("tokens").alias("len"), F.coalesce(F.array_max(F.transform(keep, lambda x: x["i"])) + 1, F.lit(0)).alias("pos_len"), F.size(keep).alias("indexed"))

    def stats(self, lengths: DataFrame | None = None) -> DataFrame:
        """field, doc_count (documents with an indexed token), sum_len (indexed tokens), n_docs."""
        rows = (lengths if lengths is not None else self.lengths()).groupBy("field").agg(F.count_if(F.col("indexed") > 0).alias("doc_count"), F.sum("indexed").alias("sum_len"), F.count("*").alias("n_docs"))
        return rows

    def lexicon(self) -> DataFrame:
        """field, term, df, ctf of the whole vocabulary: documents are summed first where they are read."""
        per_doc = self.occurrences().groupBy("field", "term", "ext_id").agg(F.count("*").alias("tf"))
        return per_doc.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))

    def term_vector(self, ext_ids: list[str] | None = None) -> DataFrame:
        """ext_id, field, term, tf, positions of some documents, or of all."""
        few = Index(self.docs if ext_ids is None else self.docs.where(F.col("ext_id").isin(ext_ids)), self.fields, self.analyzer)
        return few.postings().select("ext_id", "field", "term", "tf", "positions")

    def save(self, path: str, buckets: int = 64) -> None:
        """Write postings, lengths and documents; postings by field, sorted by term, so that scans of a term skip files."""
        postings = self.postings()
        postings.repartitionByRange(buckets, "field", "term", "ext_id").sortWithinPartitions("field", "term", "ext_id").write.partitionBy("field").mode("overwrite").parquet(f"{path}/postings")
        self.lengths().write.partitionBy("field").mode("overwrite").parquet(f"{path}/lengths")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")


class SavedIndex(Index):
    """An index read from the tables that ``save`` wrote."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = ("body",), analyzer: Analyzer = Analyzer()):
        super().__init__(spark.read.parquet(f"{path}/docs"), fields, analyzer)
        self._postings, self._lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")

    def postings(self, terms: DataFrame | None = None, known: set[tuple[str, str]] | None = None) -> DataFrame:
        rows = self._postings.select("field", "term", "ext_id", "tf", "positions")
        if known is not None and len(known) <= KNOWN:  # reaches the files: partitions by field, row groups by term
            rows = rows.where(F.col("field").isin(*sorted({f for f, _ in known})) & F.col("term").isin(*sorted({t for _, t in known})))
        return rows if terms is None else rows.join(F.broadcast(terms.select("field", "term").distinct()), ["field", "term"], "left_semi")

    def lexicon(self) -> DataFrame:
        return self._postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))

    def lengths(self) -> DataFrame:
        return self._lengths.select("field", "ext_id", "len", "pos_len", "indexed")


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """External ids that more than one document has."""
    return docs.groupBy("ext_id").agg(F.count("*").alias("n")).where("n > 1")


def html_text(html: Column) -> Column:
    """Text of markup: tags become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def documents_index(spark: SparkSession, sf_dir: str, analyzer: Analyzer = Analyzer()) -> Index:
    """The table documents as one-field documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Index(docs.select(F.col("doc_id").cast("string").alias("ext_id"), F.col("text").alias("body")), ("body",), analyzer)


def pages_index(spark: SparkSession, sf_dir: str, analyzer: Analyzer = Analyzer()) -> Index:
    """The table pages as documents of five fields, with the raw address as attribute."""
    html = F.col("html")
    part = lambda tag: html_text(F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("string").alias("ext_id"), part("article").alias("body"), part("title").alias("title"),
        F.col("url").alias("url"), part("h1").alias("keywords"), part("nav").alias("inlink"), F.col("url").alias("raw_url"), F.length("html").cast("double").alias("page_rank"),
    )
    return Index(docs, ("body", "title", "url", "keywords", "inlink"), analyzer)
