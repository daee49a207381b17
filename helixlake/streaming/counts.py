"""K-mer counts of read files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kmers import kmers_ordered
from ..operators.counts import READ_CAP, countable
from ..operators.store import MOST_RUNS, KmerTable


def stream_reads(spark: SparkSession, path: str, seq: str = "seq", files_at_once: int = 1) -> DataFrame:
    """Reads of Parquet files put into a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path).select(F.col(seq).alias("seq"))


def incremental_counts(reads: DataFrame, k: int, length: int = 0, cap: int = READ_CAP) -> DataFrame:
    """A streaming table (kmer, cov): state is one row for each k-mer seen; the cap comes after the sum."""
    found = kmers_ordered(countable(reads, k, length).withColumn("strand_id", F.lit(0)), k)
    return found.groupBy("kmer").agg(F.least(F.count("*"), F.lit(cap)).cast("int").alias("cov"))


def merge_into_store(reads: DataFrame, k: int, store: str, checkpoint: str, length: int = 0, most_runs: int = MOST_RUNS, told: Callable[[int, Row], None] | None = None) -> StreamingQuery:
    """Adds each batch's counts to a stored table as a run under the batch's number: a batch that is run again after its run was committed changes nothing, and one that
    failed before is written again.  Runs are compacted as they become many.  told: is given each batch's number, and the table's summary after it."""

    def add(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, countable(batch, k, length)
        try:
            table = KmerTable(spark, store)
        except ValueError:
            table = KmerTable.create(spark, store, k, own)
        table.add(own, number, most_runs)
        if told:
            told(number, table.summary().first())

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """(kmer, n): raw counts over all batches."""
    return KmerTable(spark, store).rows()
