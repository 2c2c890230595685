"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Quality rules reject documents, line dedup takes boilerplate lines out of texts, the n-gram
Jaccard join keeps one document of each group, mixing puts the rest in the order of the target
weights, and SentencePiece encodes it in that order. Every stage but the last returns the columns of its
input; a column with any name passes through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendscope.llm.line_dedup import line_stage
from trendscope.llm.mixing import in_file_order, mixing_stage
from trendscope.llm.ngram_join import near_duplicate_stage
from trendscope.llm.quality import quality_stage
from trendscope.llm.queries import executors_ready
from trendscope.llm.scratch import Scratch
from trendscope.llm.sentencepiece_nbest import encode_stage



def _ready(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with executors that can import the operators."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        executors_ready(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _ready(stage)) for name, stage in (
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
)]

# The last stage's segmentation can't be written in SQL: tested against a plain Python version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows come in the mixed order."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        after = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return in_file_order(docs)
