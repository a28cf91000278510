"""A training corpus from raw documents: five stages, each one operator of ``tierwalk.llm``.

Each stage gets what the stage before kept and is written as Parquet before the next one reads it. All but the last
return the columns of ``documents``; ``n_chars`` is counted anew where a text was cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.llm import decontam, minhash, ordinal, phrases, sampling
from tierwalk.llm.queries import graded, table
from tierwalk.llm.ship import ship
from tierwalk.workspace import Workspace

#: Helper columns start like this, so that they clash with none of the documents'.
OWN = "_tierwalk_"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is at least as likely as not."""
    model = ordinal.fit(docs, graded(table(spark, sf_dir, "labels")), n_grades=3)
    return ordinal.score(docs, model, prefix=OWN).where(F.col(f"{OWN}p_ge_2") >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each component of near-duplicates; documents without words all stay."""
    ship(spark)
    found = minhash.near_duplicates(docs, size=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that recur; untouched ones keep their bytes."""
    ship(spark)
    cut = phrases.cut_repeats(docs, window=35, prefix=OWN)
    touched = F.col(f"{OWN}n_removed") > 0
    new = {"text": F.when(touched, F.col(f"{OWN}kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length(f"{OWN}kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(touched, length).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), hits=f"{OWN}hits")
    return found.where(F.size(f"{OWN}hits") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, text_sha256): a reproducible sampled segmentation of each text, and the digest of the text
    that the ids decode to."""
    ship(spark)
    tokens = sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=f"{OWN}text")
    n_pieces = F.size("ids").cast("long").alias("n_pieces")
    return tokens.select("doc_id", n_pieces, "ids", F.sha2(f"{OWN}text", 256).alias("text_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]

#: None, as a trained classifier has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{space.path}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
