"""From raw documents to packed training sequences, one operator per stage.

Each stage gets what the one before it kept, written as Parquet and read again, so a
lost executor costs a stage's tasks at most. All stages but the last return the columns
of ``documents``; a changed text brings its ``n_chars`` up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.llm import packing, quality, secrets, simhash, substrings
from lakemart.llm.common import col, small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[col(c) for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    small_batches(spark)
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier go; documents stay, whatever is left of them."""
    small_batches(spark)
    # without the count that is made anew: all steps then share one shuffle of the documents
    cut = substrings.remove_repeats(
        docs.drop("n_chars"), alias="repeats" if "repeats" not in docs.columns else "_repeats"
    )
    name = cut.columns[-1]
    return _with_text(cut.withColumn("text", F.col(f"{name}.kept")), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked; what everyone copies stays."""
    return _with_text(secrets.mask_secrets(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its token ids and its place in a sequence."""
    small_batches(spark)
    return packing.pack_ids(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

# The votes of the first stage are weighed by an iteration, which SQL doesn't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
