"""From raw documents to tokens: quality, repeated lines, near copies, the mix of sources, byte-level BPE.

Each stage takes the documents that the one before has kept, written as Parquet and read again, and returns documents of the
same columns; the last returns token ids. A stage that finds an empty table returns one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, jaccard, mixing, quality, templates
from weft.llm.common import read, same
from weft.llm.queries import RANKS
from weft.llm.workers import ship
from weft.sources.workspace import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold; the model learns from all labels outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.score(docs, model, "_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that loses its last line with words goes."""
    out = templates.drop_template_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(mixing.WORD)
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of like documents the one with the smallest doc_id; null doc_ids stay."""
    found = jaccard.similar_documents(docs.select("doc_id", "text"))
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    copies = mixing.mix_sources(docs.select("doc_id", "source", "text")).where("copies > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    sized = docs.withColumn("_size", mixing.word_count(F.col("text")))
    taken = sized.join(copies, same([F.col("doc_id").cast("long"), F.col("source"), F.col("_size")],
                                    [F.col("_d"), F.col("_s"), F.col("_z")]))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the byte offsets from which the text can be cut again."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    out = bpe.encode(docs.select("doc_id", "source", "text"), ranks)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("byte_level_bpe", tokenize),
]

#: SQL has neither the classifier nor the drawing of the mix; tests hold each stage against a plain version of it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/weft/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
