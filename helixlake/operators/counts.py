"""K-mer count tables and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import truncate
from ..functions.kmers import count_histogram, kmer_occurrences, merged

#: The largest count of a k-mer over reads, and over strands.
READ_CAP, STRAND_CAP = 2**14 - 1, 2**10 - 1


def countable(reads: DataFrame, k: int, length: int = 0) -> DataFrame:
    """Reads of k bases or more, cut to the bases that are counted."""
    return reads.where(F.length("seq") >= k).select(truncate(F.col("seq"), length, k).alias("seq"))


def raw_counts(reads: DataFrame, k: int, length: int = 0) -> DataFrame:
    """(kmer, n): occurrences over all reads, without a cap, so that tables of several inputs can be added."""
    return kmer_occurrences(countable(reads, k, length), k)


def capped(raw: DataFrame, cap: int = READ_CAP) -> DataFrame:
    """(kmer, cov)."""
    return raw.select("kmer", F.least("n", F.lit(cap)).cast("int").alias("cov"))


def kmer_counts(reads: DataFrame, k: int, length: int = 0, text: bool = False) -> DataFrame:
    """(kmer, cov): occurrences over all reads, repeats within a read included, up to READ_CAP.  text: k-mers as text, not packed."""
    return capped(kmer_occurrences(countable(reads, k, length), k, text=text))


def merged_counts(tables: list[DataFrame]) -> DataFrame:
    """One raw table of several; caps come after the sum.  Rows travel as sorted lists, which buckets add up."""
    return merged(reduce(DataFrame.unionByName, (t.select("kmer", "n") for t in tables)))


def strand_membership(strands: DataFrame, k: int) -> DataFrame:
    """(kmer, n): in how many strands each k-mer is, up to STRAND_CAP."""
    return kmer_occurrences(strands, k, once=True).select("kmer", F.least("n", F.lit(STRAND_CAP)).cast("int").alias("n"))


def membership_histogram(strands: DataFrame, k: int) -> DataFrame:
    """(n, kmers): how many k-mers are in so many strands, up to STRAND_CAP; no row for each k-mer is made on the way."""
    return count_histogram(strands, k, STRAND_CAP, once=True).groupBy(F.col("n").cast("int").alias("n")).agg(F.sum("kmers").alias("kmers"))


def spectrum(counts: DataFrame) -> DataFrame:
    """(cov, kmers): how many k-mers have each coverage."""
    return counts.groupBy("cov").agg(F.count("*").alias("kmers"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """(cov, at_least): k-mers with that coverage or more.  The histogram has a row for each coverage up to the cap."""
    return histogram.select("cov", F.sum("kmers").over(Window.orderBy(F.desc("cov"))).alias("at_least"))


def summary(counts: DataFrame, k: int, length: int = 0, files: int = 1) -> DataFrame:
    """One row: different k-mers, total coverage (of capped counts), and the settings."""
    return counts.agg(F.count("*").alias("distinct_kmers"), F.coalesce(F.sum("cov"), F.lit(0)).cast("long").alias("total_coverage")).select("*", F.lit(k).alias("k"), F.lit(length).alias("read_length"), F.lit(files).alias("files"))
