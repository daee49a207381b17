"""Strand recovery: coverage of strands by read k-mers, and the metric grid over cutoffs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kmers
from ..sources.scratch import settled
from .counts import READ_CAP, countable


def coverage_lookup(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """keys with their coverage, 0 for k-mers that are not counted."""
    return keys.join(counts.select("kmer", "cov"), "kmer", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))


def targets_in_reads(targets: DataFrame, counts: DataFrame) -> DataFrame:
    return targets.select("kmer").distinct().join(counts, "kmer", "left_semi")


def noise_kmers(targets: DataFrame, counts: DataFrame) -> DataFrame:
    return counts.join(targets.select("kmer").distinct(), "kmer", "left_anti")


def target_sets(targets: DataFrame, counts: DataFrame, cutoff: int = 0) -> DataFrame:
    """(kmer, set): shared, lost (a target below the cutoff) or noise (in reads only), at coverages above the cutoff."""
    own = targets.select("kmer").distinct().withColumn("t", F.lit(True))
    above = counts.where(F.col("cov") > cutoff).select("kmer").withColumn("r", F.lit(True))
    kind = F.when(F.col("t") & F.col("r"), "shared").when(F.col("t"), "lost").otherwise("noise")
    return own.join(above, "kmer", "full").select("kmer", kind.alias("set"))


def compared_sets(strands: DataFrame, reads: DataFrame, k: int, cutoff: int = 0) -> DataFrame:
    """(kmer, cov, set): target_sets() of sequences (seq), counted and compared in one step; cov: the reads' count, null where it isn't above the cutoff."""
    kind = F.when(~F.col("t"), "noise").when(F.col("cov").isNull(), "lost").otherwise("shared")
    return kmers.compared(countable(reads, k), strands, k, READ_CAP, cutoff).select("kmer", "cov", kind.alias("set"))


def strand_paths(strands: DataFrame, counts, k: int) -> DataFrame:
    """(strand_id, pos, kmer, cov): a row for each strand that has k-mers; arrays of its different k-mers in the order of their first positions.  counts: a table
    (kmer, cov), a stored one, or the reads (seq) themselves, which are then counted where they are looked up."""
    return kmers.Paths(strands, counts, k, READ_CAP).rows()


def covered_kmers(strands: DataFrame, counts, k: int) -> DataFrame:
    """(strand_id, kmer, pos, cov): a row for each of a strand's different k-mers."""
    return strand_paths(strands, counts, k).select("strand_id", F.explode(F.arrays_zip("kmer", "pos", "cov")).alias("x")).select("strand_id", "x.kmer", "x.pos", "x.cov")


def packed(covered: DataFrame) -> DataFrame:
    """strand_paths() of a table that has a row for each k-mer; others as they are."""
    if covered.schema["cov"].dataType.typeName() == "array":
        return covered
    rows = covered.groupBy("strand_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kmer", "cov"))).alias("x"))
    return rows.select("strand_id", "x.pos", "x.kmer", "x.cov")


def ratios_of(cov: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each entry of runs the ratio of the greater to the lesser of it and the one before; nan at the start of a run."""
    out = np.full(len(cov), np.nan)
    low, high = np.minimum(cov[1:], cov[:-1]), np.maximum(cov[1:], cov[:-1])
    out[1:] = np.where(low > 0, high / np.maximum(low, 1), np.where(high == 0, 1.0, 0.0))
    out[at[:-1]] = np.nan
    return out


def reduced(paths: DataFrame, fields: str, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(strand_id, *fields): what `of` makes of the coverages of whole batches of strands, and of where each begins, and the end."""
    kind = paths.schema["strand_id"].dataType.simpleString()
    names = ["strand_id", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("cov")
                at = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)
                columns = of(lists.flatten().to_numpy().astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([batch.column("strand_id"), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=names)

    return paths.select("strand_id", "cov").mapInArrow(run, f"strand_id {kind}, {fields}")


def listed_ratios(covered: DataFrame) -> DataFrame:
    """(strand_id, ratios, cov): arrays; the ratio of each different k-mer, in order of first occurrence, to the one before, one less than k-mers."""

    def of(cov: np.ndarray, at: np.ndarray) -> list:
        ratios = ratios_of(cov, at)
        kept = np.delete(ratios, at[:-1])
        return [pa.ListArray.from_arrays(pa.array((at - np.arange(len(at))).astype(np.int32)), pa.array(kept)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(cov.astype(np.int32)))]

    return reduced(packed(covered), "ratios array<double>, cov array<int>", of)


def strand_stats(strands: DataFrame, covered: DataFrame, skip: int = 0) -> DataFrame:
    """(strand_id, min_cov, max_ratio) of every strand: null without k-mers.  max_ratio leaves out the first `skip` ratios, and is 0 where a
    coverage is."""

    def of(cov: np.ndarray, at: np.ndarray) -> list:
        ratios = ratios_of(cov, at)
        place = np.arange(len(cov)) - np.repeat(at[:-1], np.diff(at))
        ratios[(place <= skip) | np.isnan(ratios)] = 0.0
        least = np.minimum.reduceat(cov, at[:-1])
        return [least.astype(np.int32), np.where(least == 0, 0.0, np.maximum.reduceat(ratios, at[:-1]))]

    return strands.select("strand_id").join(reduced(packed(covered), "min_cov int, max_ratio double", of), "strand_id", "left")


def ratio_ranges(covered: DataFrame) -> DataFrame:
    """(i, min_ratio, max_ratio): over strands, at each place.  A task sends a row for each place of its longest strands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(0), np.zeros(0)
        for batch in batches:
            lists = batch.column("cov")
            size = lists.value_lengths().to_numpy().astype(np.int64)
            at = np.append(0, np.cumsum(size))
            ratios = ratios_of(lists.flatten().to_numpy().astype(np.int64), at) if len(size) else np.zeros(0)
            place = np.arange(at[-1]) - np.repeat(at[:-1], size)
            more = max(0, int(size.max(initial=0)) - len(low))
            low, high = np.append(low, np.full(more, np.inf)), np.append(high, np.full(more, -np.inf))
            keep = place > 0
            np.minimum.at(low, place[keep], ratios[keep])
            np.maximum.at(high, place[keep], ratios[keep])
        there = np.flatnonzero(low < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(low[there]), pa.array(high[there])], names=["i", "low", "high"])

    return packed(covered).select("cov").mapInArrow(run, "i int, low double, high double").groupBy("i").agg(F.min("low").alias("min_ratio"), F.max("high").alias("max_ratio"))


def target_histogram(covered: DataFrame) -> DataFrame:
    """(cov, kmers): different target k-mers of each coverage, zero included."""
    rows = packed(covered).select(F.explode(F.arrays_zip("kmer", "cov")).alias("x")).select("x.kmer", "x.cov")
    return rows.distinct().groupBy("cov").agg(F.count("*").alias("kmers"))


def strand_histogram(strands: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """target_histogram() of strands and reads (seq), from the tasks that count them: no row for each k-mer leaves those."""
    return kmers.Paths(strands, countable(reads, k), k, READ_CAP, histograms=True).histogram(kmers.TARGET_HISTOGRAM)


def grid_ratios(low: float, high: float, step: float) -> list[float]:
    """Ratio cuts from low to high, by repeated addition."""
    if high <= 0 or high < low:
        high = low
    if high > low and step <= 0:
        raise ValueError("the step between ratios must be positive")
    out = [low]
    while high > low and out[-1] + step <= high + 0.001:
        out.append(out[-1] + step)
    return out


def _sum_of(rows: Column, value: str, fits=None) -> Column:
    """The sum of a field over an array of structs, where fits(struct)."""
    rows = rows if fits is None else F.filter(rows, fits)
    return F.aggregate(rows, F.lit(0).cast("long"), lambda total, x: total + x[value])


def metric_grid(stats: DataFrame, targets: DataFrame, reads: DataFrame, ratios: list[float], cutoffs: list[int]) -> DataFrame:
    """The ten-column grid.  stats: strand_stats(); targets and reads: histograms (cov, kmers).

    Strands and k-mers are counted by cell first, which leaves three short arrays, (cutoffs + 2) x (ratios + 1) long at most, in one row; the grid's cells are
    evaluated on those."""
    most = max(cutoffs) + 1
    bucket = F.lit(len(ratios))
    for place, cut in reversed(sorted(enumerate(ratios), key=lambda x: x[1])):
        bucket = F.when(F.col("max_ratio") <= cut, place).otherwise(bucket)
    # the least cut that a strand's ratio is not above
    strands = stats.select(F.least(F.coalesce("min_cov", F.lit(-1)), F.lit(most)).alias("cov"), bucket.alias("bucket")).groupBy("cov", "bucket").agg(F.count("*").alias("n"))
    strands = strands.agg(F.collect_list(F.struct("cov", "bucket", "n")).alias("strands"))

    def counted(histogram: DataFrame, name: str) -> DataFrame:
        small = histogram.groupBy(F.least("cov", F.lit(most)).alias("cov")).agg(F.sum("kmers").alias("kmers"))
        return small.agg(F.collect_list(F.struct("cov", "kmers")).alias(name))

    one = strands.join(counted(targets, "targets"), how="cross").join(counted(reads, "reads"), how="cross")
    cells = F.array(*(F.struct(F.lit(float(r)).alias("ratio"), F.lit(int(c)).alias("coverage")) for r in ratios for c in cutoffs))
    cells = one.select("*", F.explode(cells).alias("cell")).select("*", "cell.ratio", "cell.coverage")
    least_cut = F.array(*(F.lit(float(r)) for r in [*ratios, float("inf")]))
    fits = lambda x: (x["cov"] > F.col("coverage")) & ((F.col("ratio") <= 1.0) | (least_cut[x["bucket"]] <= F.col("ratio")))
    above = lambda x: x["cov"] > F.col("coverage")
    out = cells.select(
        "ratio",
        "coverage",
        _sum_of(F.col("strands"), "n").alias("total"),
        _sum_of(F.col("strands"), "n", fits).alias("paths"),
        _sum_of(F.col("targets"), "kmers", above).alias("exist"),
        _sum_of(F.col("targets"), "kmers").alias("all"),
        _sum_of(F.col("reads"), "kmers", above).alias("seen"),
    )
    lost, noise = F.col("all") - F.col("exist"), F.col("seen") - F.col("exist")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    measures = part(F.col("paths"), F.col("total")).alias("sm"), part(lost, F.col("all")).alias("kd"), part(noise, F.col("exist")).alias("kn")
    return out.select("ratio", "coverage", "total", "paths", noise.alias("noise"), "exist", lost.alias("lost"), *measures)


@settled
def strand_recovery(strands: DataFrame, reads: DataFrame, k: int, cutoffs: range | list[int] = (0,), ratios: tuple[float, float, float] = (0.0, 0.0, 0.2), skip: int = 0, length: int = 0) -> DataFrame:
    """The whole job: count the reads' k-mers, look up the strands' where they are counted, and evaluate the grid.  cutoffs: of coverage; ratios: low, high,
    step.  Of the reads' k-mers only the numbers by coverage leave the tasks that count them."""
    found = kmers.Paths(strands, countable(reads, k, length), k, READ_CAP, histograms=True)
    stats = strand_stats(strands, found.rows("cov"), skip)
    return metric_grid(stats, found.histogram(kmers.TARGET_HISTOGRAM), found.histogram(kmers.READ_HISTOGRAM), grid_ratios(*ratios), list(cutoffs))
