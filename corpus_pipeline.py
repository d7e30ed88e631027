"""Corpus pipeline: quality, line dedup, near-dedup, decontamination and mixing of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
rows to the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from sparkloom.llm.common import cut, read_table

#: Bits of the near-dedup fingerprint; documents link at 0.8 or more equal bits.
FINGERPRINT_BITS, SIMILARITY, TABLES = 256, 0.8, 246
#: Lines of so many code points found in so many documents stay only where they come first.
MIN_LINE_CHARS, MIN_LINE_DOCS = 20, 10
#: Lines of so many words stay only where they come first from the second document on. They go once
#: whole near copies have gone, of which they would leave fragments otherwise.
MIN_PASSAGE_WORDS = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that repeat across documents."""
    maps = line_dedup.keep_bitmaps(docs, min_chars=MIN_LINE_CHARS, min_docs=MIN_LINE_DOCS, keep_first=True)
    return line_dedup.drop_lines(docs, maps).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id. Of long lines that repeat
    across the documents left all but the first go."""
    found = simhash.labelled(docs, words=5, max_bits=int(FINGERPRINT_BITS * (1 - SIMILARITY)), bits=FINGERPRINT_BITS, tables=TABLES)
    kept = cut(simhash.keep_one(docs, found), "kept")
    maps = line_dedup.keep_bitmaps(kept, min_docs=2, keep_first=True, min_words=MIN_PASSAGE_WORDS)
    return line_dedup.drop_lines(kept, maps).withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample of calibrated probabilities, with each document's probability."""
    found = mixing.mixed(mixing.measured(docs))
    cell, probability, kept = (F.col(x) for x in found.columns[-3:])
    more = [x.alias(mixing.fresh(docs, name)) for name, x in (("topic", cell.getField("topic")), ("probability", probability))]
    return found.filter(kept).select(*docs.columns, *more)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Fitted models and components are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
