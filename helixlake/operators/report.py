"""The quality report: cross-links, entanglement and the headline of the metric grid in one row, and verdicts on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kmers
from ..functions.dna import checked_k
from ..sources.scratch import settled
from .counts import READ_CAP, STRAND_CAP, countable
from .links import cross_links, entanglement, screen_totals


@settled
def qc_report(strands: DataFrame, reads: DataFrame, k: int = 31, link_m: int = 1, screen_m: int = 0, primer: int = 18, cutoff: int = 0, length: int = 0) -> DataFrame:
    """One row.  Cross-links count untrimmed strands; passed leaves out skipped strands, which have a column of their own.

    Strands and reads meet once, where all of it is counted; strands without primers are screened there too, others in a step of their own."""
    checked_k(k)
    if screen_m < 0 or primer < 0:
        raise ValueError("m and primer must not be negative")
    found = kmers.surveyed(strands, countable(reads, k, length), k, STRAND_CAP, READ_CAP, screen_m, cutoff)

    def histogram(kind: int, value: str) -> DataFrame:
        return found.where(F.col("kind") == kind).groupBy(F.col("value").alias(value)).agg(F.sum("n").alias("kmers"))

    def above(kind: int, name: str) -> DataFrame:
        kmers_above = F.sum(F.when(F.col("cov") > cutoff, F.col("kmers")))
        return histogram(kind, "cov").agg(F.coalesce(kmers_above, F.lit(0)).alias(name), F.coalesce(F.sum("kmers"), F.lit(0)).alias(f"{name}_all"))

    has_kmers = F.coalesce(F.rlike("seq", F.lit(f"[ACGTUacgtu]{{{k}}}")), F.lit(False))
    totals = strands.agg(F.count("*").alias("strands"), F.count_if(F.coalesce(F.length("seq"), F.lit(0)) < k).alias("skipped"), F.count_if(has_kmers).alias("with_kmers"))
    marks = found.where(F.col("kind") == kmers.STRANDS).groupBy("n").agg(F.bit_or("value").alias("value"))
    marked = marks.agg(F.count_if(F.col("value").bitwiseAND(kmers.LINKED) > 0).alias("entangled"), F.count_if(F.col("value").bitwiseAND(kmers.BROKEN) > 0).alias("broken"))
    one = totals.join(marked, how="cross")
    if primer:
        screen = screen_totals(entanglement(strands, k, screen_m, primer)).select("passed", F.col("filtered").alias("entangled"), "skipped")
        one = one.drop("entangled", "skipped").join(screen, how="cross")
    else:
        one = one.withColumn("passed", F.col("strands") - F.col("skipped") - F.col("entangled"))
    one = cross_links(histogram(kmers.MEMBERS, "n"), link_m).join(one, how="cross").join(reads.agg(F.count("*").alias("reads")), how="cross")
    one = one.join(above(kmers.TARGETS, "exist"), how="cross").join(above(kmers.READS, "seen"), how="cross")
    paths, lost, noise = F.col("with_kmers") - F.col("broken"), F.col("exist_all") - F.col("exist"), F.col("seen") - F.col("exist")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    measures = part(paths, F.col("strands")).alias("sm"), part(lost, F.col("exist_all")).alias("kd"), part(noise, F.col("exist")).alias("kn")
    return one.select("cross_links", "strands", "passed", "entangled", "skipped", "reads", paths.alias("paths"), "exist", lost.alias("lost"), noise.alias("noise"), *measures)


def verdicts(report: DataFrame) -> DataFrame:
    """(metric, value, verdict) of a report row: ok, warn or bad, by fixed thresholds."""
    share = F.when(F.col("strands") > 0, F.col("entangled") / F.col("strands")).otherwise(F.lit(0.0))
    no_reads = F.col("reads") == 0

    def graded(value, good, fair):
        return F.when(no_reads, "warn").when(good, "ok").when(fair, "warn").otherwise("bad")

    rules = {
        "entangled": (F.col("entangled"), F.when(F.col("entangled") == 0, "ok").when(share > 0.1, "bad").otherwise("warn")),
        "cross_links": (F.col("cross_links"), F.when(F.col("cross_links") == 0, "ok").otherwise("warn")),
        "sm": (F.col("sm"), graded(F.col("sm"), F.col("sm") >= 0.95, F.col("sm") >= 0.8)),
        "kd": (F.col("kd"), graded(F.col("kd"), F.col("kd") <= 0.05, F.col("kd") <= 0.2)),
        "kn": (F.col("kn"), F.when(no_reads | F.isnan("kn"), "warn").when(F.col("kn") <= 0.5, "ok").when(F.col("kn") <= 2, "warn").otherwise("bad")),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), verdict.alias("verdict")) for m, (v, verdict) in rules.items())))
    return report.select(rows.alias("r")).select("r.*")
