"""Reading the given tables, and dropping rows by tables of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import FEW_ROWS, beside, dropped, settled, shared_dir, unused, written

__all__ = ["FEW_ROWS", "beside", "dropped", "settled", "shared_dir", "table", "text_key", "unused", "without", "written"]

#: Rows of an Arrow batch where the session names no other number than Spark's own, 10,000: texts are long, and the JVM and its workers hold whole batches.
BATCH_ROWS, _ROWS_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs; a null text has a key of its own."""
    return [F.xxhash64(text), F.xxhash64(text, F.lit("2"))]


def without(docs: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of docs whose keys are not among the rows of `gone`, a written table.  Nulls are equal."""
    found = gone.toDF(*(unused(docs.columns, f"gone_{i}") for i in range(len(gone.columns))))
    on = [k.eqNullSafe(found[c]) for k, c in zip(keys, found.columns)]
    return docs.join(beside(found), on, "left_anti")
