"""A training corpus from raw documents, in stages that each read all that is left.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written
and read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeclerk.llm.bpe import encode_documents
from lakeclerk.llm.decontam import drop_leaking_rows
from lakeclerk.llm.langid import fit, held_out, relabel
from lakeclerk.llm.neardup import drop_near_rows
from lakeclerk.llm.queries import RANKS, table
from lakeclerk.llm.scratch import written
from lakeclerk.llm.secret_scan import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the predicted language; texts of no language go.

    Those are null texts and texts without a letter. The model is fitted as for
    operator 4, and every row is judged by its own text.
    """
    docs = docs.select(*COLUMNS)
    return relabel(docs, fit(docs.where(~held_out(F.col("doc_id"))), order=F.col("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least key.

    Rows are judged one by one, also those that have no key or share one.
    """
    return drop_near_rows(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, row by row."""
    return drop_leaking_rows(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and ``n_chars`` follows; every document stays."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digests that show the round trip."""
    return encode_documents(docs, RANKS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("token_ids", token_ids),
]

#: The stages' models and sketches cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
