"""From raw documents to packed training sequences: five stages, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.linededup import without_recurring_lines
from strandline.llm.neardup import one_of_each
from strandline.llm.packing import pack
from strandline.llm.quality import good_documents
from strandline.llm.secret_scan import redact_secrets
from strandline.runtime import Scratch, table


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null, empty and wordless texts are rejected; repeated rows are judged alike; a null id changes nothing; an empty
    table stays empty; very long texts are judged whole.
    """
    return good_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; a document that loses its last word goes.

    Null and empty texts stay as they are; rows that share an id are one document; rows with a null id are left alone;
    an empty table stays empty; very long texts and lines are parsed whole; other columns may have any name.
    """
    names, dropped = docs.columns, "_dropped"
    while dropped in map(str.lower, names):
        dropped = "_" + dropped
    out = without_recurring_lines(spark, docs, count_col=dropped)
    return _measured(out.filter((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*names))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %), that with the smallest id.

    A document is an id with a text: rows that repeat both are one, rows that share only the id are judged apart.
    Null, empty and wordless texts and rows with a null id group with nothing and stay; an empty table stays empty;
    very long texts are compared whole; other columns may have any name.
    """
    return one_of_each(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark; no document goes.

    Null stays null, empty stays empty; repeated rows are treated alike; an empty table stays empty; very long texts are
    scanned whole.
    """
    return _measured(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is the end token alone; repeated rows are packed each; a null id is passed on; an empty table
    gives no pieces; a very long text is cut into pieces of 1024 tokens.
    """
    return pack(spark, docs)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: Line templates, near duplicates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "stages")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
