"""A corpus pipeline of five operators: every stage's output is written as Parquet and read as the next one's documents.

Every stage takes documents (doc_id, text, source, and any others, whatever their names) of any number, none included. All but
the last return the columns that they were given. What each does with nulls, empty texts, ties and repeated rows stands
with it; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import common, content_sort, line_rules, personal_data, prefix_join, size_packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go; lines that too many texts of a source share are removed from the others.

    Null and empty texts have too few words and go. A null source is one with those whose source is empty. Equal texts of a
    source have the same fate, repeated rows as well; null ids are ids like any other.
    """
    return line_rules.clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    A null text counts as empty, a null id comes last, and of rows that repeat id and text one stays.
    """
    return content_sort.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at 80 % the smallest doc_id stays.

    Texts without words link with nothing and stay; a null id comes last. Rows that repeat both id and text of a survivor
    stay together: exact dedup has left one of them.
    """
    return prefix_join.one_of_each(docs, 5, 80, 100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; every document stays, null and empty texts as they are."""
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    Null and empty texts have one row without a bin; repeated rows are packed each for itself.
    """
    return size_packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("PII", redact), ("best-fit packing", pack)]

#: The trees of the PII stage can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
