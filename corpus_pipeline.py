"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage works on all that the one before kept, and gives the columns of ``documents``; the last gives packed pieces.
``run`` writes every stage to the shared folder and reads it again, so that a lost executor never costs more than one
stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import shared_folder, unused
from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.lines import dedup_lines
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import fit_quality, score_quality
from lodestar.llm.queries import table, tokenizer_file
from lodestar.llm.simhash import one_of_each_group

#: Near-duplicates: words of a shingle, 64-bit lanes of a fingerprint, differing bits of all lanes, shingle minima, Jaccard
#: similarity. Each different shingle votes once, so texts that share 0.8 of their shingles differ in 39 of 256 bits on
#: average, with a standard deviation of 6; one in 10 million lies beyond the radius, of texts of 4 or 5 shingles one in 10,000.
NEAR = {"words": 5, "lanes": 4, "radius": 72, "minima": 8, "similarity": 0.8}
CUT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text counts as empty; rows without an id, or that share one, are judged each by its text."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), cut=CUT)
    (score,) = unused(docs.columns, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= CUT).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; n_chars follows the text. A null text becomes an empty one."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; documents without an id stay."""
    return one_of_each_group(docs, **NEAR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null texts and rows without an id stay unless their text holds one."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096 tokens at most, packed. A null text is its end id alone; rows without an id are packed as well."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", benchmark_free), ("packing", packing)]

#: The classifier and the tokenizer cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; their tables stay under the shared folder, for the caller to remove."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
