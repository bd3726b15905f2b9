"""Corpus pipeline: each stage takes what its predecessor kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import byte_bpe, decontamination, jaccard, secrets, toxicity
from headway.llm.common import read
from headway.llm.queries import VOCABULARY
from headway.session import save_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores as toxic go. The classifier sees no label of the held-out fold.

    A null text is scored as an empty one and stays null; repeated rows and null ids are judged each.
    """
    held_out = toxicity.fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"), held_out)
    scored = toxicity.score(docs, model, docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets the one with the least id stays.

    Texts without words (null, empty) belong to no group; of repeated rows one stays.
    """
    return jaccard.one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go; others stay as they are."""
    spans = decontamination.find_spans(docs, read(spark, sf_dir, "benchmark"), docs.columns)
    return decontamination.judged(spans).where(~F.col("contaminated")).select(*docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret found becomes one mark, and n_chars follows the new text.

    A null text stays null with the n_chars it has; repeated rows and null ids stay as they are.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    marked = docs.withColumn("__null", F.col("text").isNull()).withColumn("__chars", F.col("n_chars"))
    found = secrets.scan_secrets(marked, [*rest, "__null", "__chars"], clean=True)
    text = F.when(~F.col("__null"), F.col("clean_text"))
    size = F.when(F.col("__null"), F.col("__chars")).otherwise(F.length("clean_text")).cast("long")
    return found.withColumn("n_chars", size).withColumn("text", text).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the end of each token in bytes of its text.

    A null or empty text has no ids; repeated rows and null ids are encoded each.
    """
    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", scan_secrets),
    ("byte_level_bpe", tokenize),
]

#: The classifier of the first stage has no SQL form; a plain version in tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save_table(docs, f"pipeline-{name}")
    return docs
