"""One registered query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import oracles
from tallyweave.llm.alignment import align
from tallyweave.llm.decontamination import contamination
from tallyweave.llm.html_text import extract_text, page_weights
from tallyweave.llm.language import Dictionaries, identify, sample_texts
from tallyweave.llm.lines import dedup_lines
from tallyweave.llm.near_duplicates import near_duplicates
from tallyweave.llm.neighbours import nearest
from tallyweave.llm.packing import pack
from tallyweave.llm.quality import VoteModel, fit_votes, quality_scores
from tallyweave.llm.resampling import resample
from tallyweave.llm.sharding import shard_records
from tallyweave.llm.substrings import remove_repeats
from tallyweave.llm.suffix_tree import fit_tree, score_texts

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, with a checksum of their ids."""
    pieces = pack(_table(spark, sf_dir, "documents"), "doc_id", "text",
                  public_tokenizers.path(TOKENIZER), END_ID)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length",
                         F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left when runs of 13 words from smaller ids are removed."""
    cleaned = remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                          F.sha2("kept_text", 256).alias("kept_sha256"))


def _fold(column: str, n: int):
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def quality_model(docs: DataFrame, labels: DataFrame) -> VoteModel:
    """Votes learnt from the labelled documents outside the held-out fifth."""
    train = labels.where(_fold("doc_id", 5) != 0).select(F.col("doc_id").alias("id"),
                                                         F.col("quality").alias("label"))
    return fit_votes(docs, "doc_id", "text", train)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth is held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    return quality_scores(docs, "doc_id", "text", model).select(
        F.col("id").alias("doc_id"), (_fold("id", 5) == 0).alias("held_out"), "score", "predicted")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third is held out."""
    docs = _table(spark, sf_dir, "documents")
    learnt = Dictionaries(sample_texts(docs.where(_fold("doc_id", 3) != 1), "text", "lang",
                                       "doc_id"))
    return identify(docs, "doc_id", "text", learnt).select(
        F.col("id").alias("doc_id"), (_fold("id", 3) == 1).alias("held_out"), "lang_pred", "score",
        "confident")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line up to one edit."""
    cleaned = dedup_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return cleaned.select(F.col("id").alias("doc_id"), "text", "n_lines", "n_removed")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                   lambda i: i % 20 == 0).withColumnRenamed("id", "vec_id")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    found = extract_text(pages, "page_id", "html", page_weights(pages, "page_id", "html"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in 13-word windows of the benchmark."""
    judged = contamination(_table(spark, sf_dir, "documents"), "doc_id", "text",
                           _table(spark, sf_dir, "benchmark"), "item_id", "text")
    return judged.select(F.col("id").alias("doc_id"), "n_words", "n_hit",
                         F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         "contaminated")


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 40 equal shards, and its shard among 41."""
    return shard_records(_table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: 3-word shingles, similarity 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), "doc_id",
                           "text").withColumnRenamed("id", "doc_id")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and pair counts of every document's tokens by two tokenizers."""
    return align(_table(spark, sf_dir, "documents"), "doc_id", "text",
                 public_tokenizers.path(ALIGNED_A),
                 public_tokenizers.path(ALIGNED_B)).withColumnRenamed("id", "doc_id")


def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight towards the benchmark and score of every document; a tenth is drawn."""
    return resample(_table(spark, sf_dir, "documents"), "doc_id", "text",
                    _table(spark, sf_dir, "benchmark"), "text", seed=2024, percent=10,
                    least_words=20).withColumnRenamed("id", "doc_id")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; a seventh is held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 7) == 2, F.lit(False))
    tree = fit_tree(docs.where(~held_out), "text")
    return score_texts(docs, "doc_id", "text", tree).withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


QUERIES = {
    "op1_packing": (packing, None),
    "op2_substring_dedup": (substring_dedup, oracles.SUBSTRINGS),
    "op3_line_dedup": (line_dedup, oracles.LINES),
    "op4_html_extraction": (html_extraction, None),
    "op5_language_id": (language_id, None),
    "op6_nearest_neighbours": (nearest_neighbours, None),
    "op7_quality_classifier": (quality_classifier, None),
    "op8_decontamination": (decontamination, oracles.BENCHMARK),
    "op9_sharding": (sharding, None),
    "op10_minhash_dedup": (minhash_dedup, oracles.NEAR_COPIES),
    "op11_tokenizer_alignment": (alignment, None),
    "op12_importance_resampling": (resampling, oracles.RESAMPLING),
    "op13_lm_scoring": (lm_scoring, None),
}
