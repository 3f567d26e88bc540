"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it
kept, and returns the columns of ``documents``, but for the last, which returns the
packed pieces. ``run`` writes each stage's rows to the shared folder and reads them
again, so a later stage never recomputes an earlier one.

1. toxicity: documents at or above their language's calibrated threshold go.
2. line_dedup: blocks of lines that an earlier document has go; a document that
   had text and has none left goes with them.
3. near_duplicates: of each group at five-word Jaccard similarity 0.8 or more, the
   document with the smallest doc_id stays.
4. mixing: sources meet their target words; a document comes as often as its copies.
5. packing: sequences of at most 1024 tokens.

Empty and null texts pass stages 1 to 3 and are taken zero times by the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoframe.llm import jaccard, lines, mixing, packing, toxicity
from ethoframe.llm.common import WORD, stage, table

#: SQL can't express trained models, alignments or packing.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, net)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(docs)
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = left.where((F.col("n_removed") == 0) | has_words)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, similarity=0.8, width=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, most=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, size=1024, digest=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, make in STAGES[:-1]:
        docs = stage(make(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
