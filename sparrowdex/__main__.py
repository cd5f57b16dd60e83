"""Command line: inspect an index, or run an experiment.

    python -m sparrowdex TABLES stats | terms | fields | docids | postings TERM[.FIELD] [N] | termvector ID [FIELD] | doc ID | attribute ID NAME
    python -m sparrowdex TABLES run PARAMETERS.json

TABLES is a folder with documents.parquet and pages.parquet; ``--pages`` takes the documents of five fields.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.index import Index, documents_index, pages_index
from .plans.language import FIELDS
from .plans.runner import Runner
from .sources.files import read_parameters


def inspect(index: Index, command: str, *args: str) -> DataFrame:
    """The table that an inspection command shows."""
    spark = index.docs.sparkSession
    if command == "stats":
        return index.stats().withColumn("avg_len", F.col("sum_len") / F.col("doc_count")).orderBy("field")
    if command == "terms":
        return index.lexicon().orderBy("field", "term")
    if command == "fields":
        return spark.createDataFrame([(f, f in index.fields) for f in FIELDS], "field string, indexed boolean")
    if command == "docids":
        return index.docs.select("ext_id").orderBy("ext_id")
    if command == "postings":
        term, _, field = args[0].partition(".")
        rows = index.postings(spark.createDataFrame([(field or "body", term)], "field string, term string")).orderBy("ext_id")
        return rows.limit(int(args[1])) if len(args) > 1 else rows
    if command == "termvector":
        rows = index.term_vector([args[0]])
        return (rows.where(F.col("field") == args[1]) if len(args) > 1 else rows).orderBy("field", "term")
    if command == "doc":
        return index.docs.where(F.col("ext_id") == args[0])
    if command == "attribute":
        return index.docs.where(F.col("ext_id") == args[0]).select(args[1])
    raise ValueError(f"unknown command {command!r}")


def main(args: list[str]) -> int:
    pages = "--pages" in args
    args = [a for a in args if a != "--pages"]
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("sparrowdex").getOrCreate()
    index = (pages_index if pages else documents_index)(spark, args[0])
    if args[1] == "run":
        Runner(spark, index).run(read_parameters(args[2]))
    else:
        inspect(index, *args[1:]).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
