"""The corpus pipeline: quality, lines, near duplicates, benchmark, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` has the columns of ``documents``, and so has what
every stage but the last returns. ``run`` writes each result as Parquet and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import queries
from tallyweave.llm.decontamination import decontaminate
from tallyweave.llm.lines import dedup_lines
from tallyweave.llm.near_duplicates import one_of_each
from tallyweave.llm.packing import pack
from tallyweave.llm.quality import keep_quality
from tallyweave.session import written

#: Near duplicates here: five-word shingles, similarity 0.8.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough; the model is that of the query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, "text", queries.quality_model(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one up to an edit; those of which no text
    is left go, and ``n_chars`` follows the text."""
    cleaned = dedup_lines(docs, "doc_id", "text").where(
        "n_removed = 0 or text rlike '[^\\\\s]'")
    cut = F.col("n_removed") > 0
    columns = {"text": F.when(cut, F.col("text")).otherwise(F.col("row.text")),
               "n_chars": F.when(cut, F.length("text")).otherwise(F.col("row.n_chars"))}
    return cleaned.select(*[columns.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType)
                            .alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Rows without an id
    are grouped like any other, and of repeated rows one stays."""
    return one_of_each(docs, "doc_id", "text", SHINGLE_WORDS, SIMILAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or hardly any of one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, "text", items, "item_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in windows of 4096 tokens."""
    return pack(docs, "doc_id", "text", public_tokenizers.path(queries.TOKENIZER),
                queries.END_ID).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("line dedup", lines),
          ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark),
          ("packing", packing)]

ORACLE_SQL = None  # neither the classifier nor the tokenizer can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
