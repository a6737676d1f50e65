"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept and returns documents of the same columns;
the last returns the pieces of the packed sequences. Stages are written and read again in
between, so a lost executor costs one stage at most. ``python corpus_pipeline.py`` is not
needed: ``run`` is registered as the query ``pipeline``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialtrace.llm.line_dedup import line_dedup
from dialtrace.llm.ngram_join import drop_near_copies
from dialtrace.llm.packing import pack
from dialtrace.llm.perplexity import keep_good
from dialtrace.llm.pseudonyms import pseudonymise, session_key
from dialtrace.llm.registry import tokenizer_file
from dialtrace.session import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many pages of a source share are cut out."""
    return line_dedup(docs).drop("n_lines", "n_dropped")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id."""
    return drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms under the session's key."""
    return pseudonymise(docs, session_key(spark)).drop("n_pii", "pii_kinds")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens are packed into sequences; one row per piece."""
    return pack(docs, tokenizer_file())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("private", private), ("packing", packing)]

#: A language model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
