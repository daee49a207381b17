"""Coverage profiles of strands along their whole paths, and batch quality control."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import first_invalid, trim
from ..functions.kmers import ROWS_AT_ONCE, Paths, as_text
from .counts import READ_CAP
from .graph import clean_query, query_status
from .recovery import ratios_of, reduced


def path_coverage(strands: DataFrame, counts, k: int) -> DataFrame:
    """(strand_id, pos, kmer, cov): a row for each strand that has k-mers; arrays over every position of its path, repeats included.  counts: a table (kmer, cov), a
    stored one, or the reads (seq) themselves, which are then counted where they are looked up."""
    return Paths(strands, counts, k, READ_CAP, every=True).rows()


def sequence_summary(path: DataFrame) -> DataFrame:
    """(strand_id, kmer_count, observed, missing, complete, min_cov, max_cov, mean_cov, max_ratio) of strands that have k-mers."""

    def of(cov: np.ndarray, at: np.ndarray) -> list:
        start, size = at[:-1], np.diff(at)
        observed = np.add.reduceat((cov > 0).astype(np.int64), start)
        low, high = np.minimum.reduceat(cov, start), np.maximum.reduceat(cov, start)
        ratio = np.maximum.reduceat(np.nan_to_num(ratios_of(cov, at), nan=-1.0), start)
        return [size, observed, size - observed, low > 0, low.astype(np.int32), high.astype(np.int32), np.add.reduceat(cov, start) / size, np.where(size > 1, ratio, 1.0)]

    return reduced(path, "kmer_count long, observed long, missing long, complete boolean, min_cov int, max_cov int, mean_cov double, max_ratio double", of)


def batch_qc(strands: DataFrame, counts, k: int, front: int = 0, back: int = 0) -> DataFrame:
    """A row for each strand: raw and analyzed length, status (skipped: too short; error: an invalid base; ok), a message, and the summary's
    columns where ok."""
    own = strands.select("strand_id", F.length("seq").alias("raw_length"), trim(F.col("seq"), front, back).alias("seq"))
    own = own.withColumn("analyzed_length", F.length("seq")).withColumn("invalid", first_invalid(F.col("seq")))
    status = F.when(F.col("analyzed_length") < k, "skipped").when(F.col("invalid").isNotNull(), "error").otherwise("ok")
    message = F.when(status == "skipped", F.lit("shorter than k")).when(status == "error", F.concat(F.lit("invalid base at "), F.col("invalid").cast("string")))
    rows = own.withColumn("status", status).withColumn("message", message)
    found = sequence_summary(path_coverage(rows.where("status = 'ok'").select("strand_id", "seq"), counts, k))
    return rows.drop("seq", "invalid").join(found, "strand_id", "left")


def batch_totals(qc: DataFrame) -> DataFrame:
    """One row: strands by status, and complete and broken paths among those that are ok."""
    ok = F.col("status") == "ok"
    return qc.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(ok & F.col("complete")).alias("complete"),
        F.count_if(ok & ~F.col("complete")).alias("broken"),
    )


def sequence_profile(strands: DataFrame, counts, k: int) -> DataFrame:
    """(strand_id, pos, kmer, canonical, cov, ratio, error): every position with its k-mer as read.  A strand that is shorter than k or has a
    letter that is no base has one row, with the error."""
    seqs = strands.select("strand_id", clean_query(F.col("seq")).alias("seq")).withColumn("error", query_status(F.col("seq"), k))
    valid = seqs.where("error IS NULL").select("strand_id", "seq")
    paths = path_coverage(valid, counts, k)
    id_type = paths.schema["strand_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("cov").value_lengths().to_numpy().astype(np.int64)
            at = np.append(0, np.cumsum(size))
            pos, kmer, cov = (batch.column(c).flatten().to_numpy() for c in ("pos", "kmer", "cov"))
            following = np.append(ratios_of(cov.astype(np.int64), at)[1:], np.nan)
            texts = np.frombuffer("".join(batch.column("seq").to_pylist()).encode("latin-1", "replace"), np.uint8)
            begin = np.append(0, np.cumsum(pc.utf8_length(batch.column("seq")).to_numpy()))[:-1]
            owner = np.repeat(np.arange(batch.num_rows), size)
            for low in range(0, len(cov), ROWS_AT_ONCE):
                own = slice(low, low + ROWS_AT_ONCE)
                letters = texts[(begin[owner[own]] + pos[own])[:, None] + np.arange(k)]
                read = pa.LargeStringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int64) * k), pa.py_buffer(letters)).cast(pa.string())
                ratio = pa.array(following[own], mask=np.isnan(following[own]))
                yield pa.RecordBatch.from_arrays([batch.column("strand_id").take(pa.array(owner[own])), pa.array(pos[own]), read, as_text(kmer[own], k), pa.array(cov[own]), ratio], names=["strand_id", "pos", "kmer", "canonical", "cov", "ratio"])

    own = paths.join(valid, "strand_id").select("strand_id", "pos", "kmer", "cov", "seq")
    rows = own.mapInArrow(run, f"strand_id {id_type}, pos int, kmer string, canonical string, cov int, ratio double").withColumn("error", F.lit(None).cast("string"))
    return rows.unionByName(seqs.where("error IS NOT NULL").select("strand_id", "error"), allowMissingColumns=True)
