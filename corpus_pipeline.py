"""The corpus pipeline: documents in, packed token sequences out; see ordermill/llm for the operators.

Every stage but the last returns the columns of its input. Nulls, empty texts, repeated rows and empty tables go through
as each operator defines it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.llm import gam, mixing, order_minhash, packing, queries, suffix_levels
from ordermill.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the additive model accepts."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return order_minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier, too."""
    return counted(suffix_levels.without_repeats(docs), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of four fifths of all words, each document at most once."""
    rows = mixing.mixed(docs, queries.document_levels(), queries.WEIGHTS, 0.8, 1, 17)
    return counted(mixing.cut_texts(rows), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return queries.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


def counted(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows with n_chars, where there is such a column, of the texts as they are now."""
    if "n_chars" not in like.columns:
        return rows
    return rows.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("source_mix", source_mix), ("packed", packed)]
#: No stage of the pipeline can be expressed in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
