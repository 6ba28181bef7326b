"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
documents; the last returns the pieces of documents with their sequences and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.llm import line_dedup, mixing, packing, quality, similar
from inkwell.llm.common import prepare, stash, table
from inkwell.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and documents of which nothing is left; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of those that links of a five-word Jaccard of 0.8 or more connect,
    found by SimHash."""
    return similar.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per time that the mix takes a document, in the order of training."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents, packed span by span, so that sequences in order of their number follow the order of training."""
    return packing.pack_in_order(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the tokenizer or the hashes; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
