"""K-mers that strands share: cross-links and the entanglement filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import checked_k, trim
from ..functions.kmers import most_shared
from ..sources.scratch import unused
from .counts import STRAND_CAP, membership_histogram


def cross_links(histogram: DataFrame, m: int = 1) -> DataFrame:
    """One row: the sum of (strands - 1) over k-mers in more than m strands.  histogram: (n, kmers)."""
    return histogram.where(F.col("n") > m).agg(F.coalesce(F.sum((F.col("n") - 1) * F.col("kmers")), F.lit(0)).cast("long").alias("cross_links"))


def cross_link_count(strands: DataFrame, k: int = 31, m: int = 1, primer: int = 0) -> DataFrame:
    checked_k(k)
    own = strands.select("strand_id", trim(F.col("seq"), primer, primer).alias("seq")) if primer else strands
    return cross_links(membership_histogram(own, k), m)


def max_strand_links(strands: DataFrame, k: int) -> DataFrame:
    """(strand_id, links): the most other strands that one of the strand's k-mers is in."""
    return most_shared(strands, k, STRAND_CAP).groupBy("strand_id").agg((F.max("n") - 1).alias("links"))


def entanglement(strands: DataFrame, k: int = 31, m: int = 0, primer: int = 18) -> DataFrame:
    """strands (whose own columns links and status, if any, are replaced) with (links, status): passed with m links or fewer (and where no k-mer is valid), else filtered; skipped where less than k bases
    are left after primers."""
    checked_k(k)
    if m < 0 or primer < 0:
        raise ValueError("m and primer must not be negative")
    own = strands.select("strand_id", trim(F.col("seq"), primer, primer).alias("seq"))
    name = unused(strands.columns, "most")
    short = unused([*strands.columns, name], "short")
    # told before the join, so that sequences which no one asks for aren't moved
    told = strands.withColumn(short, F.greatest(F.length("seq") - 2 * primer, F.lit(0)) < k)
    found = told.join(max_strand_links(own, k).withColumnRenamed("links", name), "strand_id", "left")
    links = F.coalesce(name, F.lit(0))
    status = F.when(F.col(short), "skipped").when(links <= m, "passed").otherwise("filtered")
    return found.select(*(c for c in strands.columns if c.lower() not in ("links", "status")), links.cast("int").alias("links"), status.alias("status"))


def screen_totals(screened: DataFrame) -> DataFrame:
    """One row: strands by status."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return screened.agg(F.count("*").alias("total"), of("passed"), of("filtered"), of("skipped"))


def entangled_names(screened: DataFrame, limit: int = 1000) -> DataFrame:
    """(strand_id, truncated): the first `limit` filtered strands, and whether there are more."""
    bad = screened.where("status = 'filtered'")
    return bad.orderBy("strand_id").limit(limit).select("strand_id").join(bad.agg((F.count("*") > limit).alias("truncated")), how="cross")
