"""From raw documents to token ids: toxicity, line dedup, near duplicates, source mixing, byte-level BPE.

Each stage gets what its predecessor kept, as a table read back from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import byte_bpe, line_dedup, mixing, near_dup, toxicity
from palisade.llm.shared import forget, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold, unchanged; labels of all documents teach the detector."""
    detector = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=None)
    scored = toxicity.score(docs, detector, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return scored.filter("predicted = 0").select(COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least 10 documents hold; n_chars follows the text.

    Lines of white space alone stay: they hold paragraphs apart.  A text that
    loses nothing stays as it is, a null too.
    """
    kept = line_dedup.drop_common_lines(docs, keep=("text", "lang", "source", "n_chars"))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) one row, of the smallest id."""
    return near_dup.one_of_each(docs, keep=tuple(c for c in COLUMNS if c not in ("doc_id", "text"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, as often as the mix takes them: up to twice, some never."""
    return mixing.in_training_order(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that came through, with the bytes at which tokens start."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, path, keep=("lang", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the detector nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        following = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        forget(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
