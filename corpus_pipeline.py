"""A training-data pipeline over `documents`: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads again
for the next.  Every stage but the last returns the columns of its input.  A stage writes short tables of keys first and drops rows by these:
texts stay where they lie while the keys are few.  run() writes each stage's rows, deletes whatever else the stage wrote, and the rows of the stage before: only its result stays.  Rows are judged by their
text, so a null id is treated like any other; of rows with one id and one text, one stays; a null text
fails the base quality rules; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import decontaminate, lines, packing, quality, simhash, tokens
from helixlake.llm.tables import dropped, settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the learned decision list."""
    return quality.of_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines from its texts; n_chars follows the text.  Copies count once: near-duplicate removal comes after."""
    found = lines.without_boilerplate(docs, copies_once=True)
    return found.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of texts with 0.8 or more of five-word shingles in common."""
    return simhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item (or all of a shorter one)."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096."""
    return packing.pack(docs, cache=tokens.SMALL_CACHE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL can't express the learned rules, the fingerprints' keys or the tokens: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, settled(stage)(spark, docs, sf_dir)
        dropped(before)
    return docs
