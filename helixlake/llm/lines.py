"""Line dedup by frequency within a site.

Pages are grouped by host.  A line's ratio is the number of a host's pages that contain it, over the number of the host's
pages; lines above the ratio that are on enough pages are boilerplate there, and dropped.  A page is a row with a text.  With copies_once, pages of a host with
equal text count as one, so that copies of one page don't make its lines boilerplate.  At most (mean distinct lines of a host's pages / ratio) lines of a host
can be above the ratio, so each host has a short list.  The lists are written, counted and joined to the pages by host: broadcast where
all of them together have few lines, else by a merge of two plain exchanges, whose pages of a large host adaptive execution splits among tasks.

Cases: a null text stays null, and is no page; an empty text is a page of one empty line; empty lines are never dropped; null hosts
are one host, that of the empty name; repeated rows are pages of their own (one page with copies_once), each row treated alike; a text may lose all its lines and is then
empty; empty tables give empty results; other columns of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import FEW_ROWS, table, unused, written

RATIO, MIN_PAGES = 0.1, 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line), F.xxhash64(line, F.lit("2")))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, drop): for each host that has any, the keys of its boilerplate lines."""
    text = F.col(text_col).cast("string")
    pages = docs.where(text.isNotNull()).select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"), _key(text).alias("page"))
    n_pages = F.count_distinct("page") if copies_once else F.count("*")
    totals = pages.groupBy("host").agg(n_pages.alias("pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where("line <> ''")
    on = lines.select("host", "page", _key(F.col("line")).alias("line")).groupBy("host", "line").agg(n_pages.alias("n")).where(F.col("n") >= min_pages)
    return on.join(totals, "host").where(F.col("n") / F.col("pages") > ratio).groupBy("host").agg(F.collect_list("line").alias("drop"))


def without_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """docs with the boilerplate lines of each row's host dropped from its text, and one more column, an array of two counts (lines, dropped
    lines), named lines_dropped (with underscores in front where docs has that name)."""
    found = written(boilerplate(docs, host_col, text_col, ratio, min_pages, copies_once))
    host, drop, kept = (unused(docs.columns, n) for n in ("host", "drop", "kept"))
    # a list is shorter than its host's mean page, divided by the ratio
    few = found.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0] + found.count() <= FEW_ROWS
    found = found.select(F.col("host").alias(host), F.col("drop").alias(drop))
    joined = docs.join(F.broadcast(found) if few else found.hint("merge"), F.coalesce(docs[host_col].cast("string"), F.lit("")) == found[host], "left")
    text, drop_, kept_ = (F.col(f"`{c}`") for c in (text_col, drop, kept))
    lines = _lines(text.cast("string"))
    out = joined.withColumn(kept, F.when(drop_.isNull(), lines).otherwise(F.filter(lines, lambda x: (x == "") | ~F.array_contains(drop_, _key(x)))))
    counts = F.array(F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(lines) - F.size(kept_), F.lit(0)))
    counts = F.when(text.isNull(), F.array(F.lit(0), F.lit(0))).otherwise(counts)
    columns = [F.when(text.isNotNull(), F.array_join(kept_, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, counts.alias(unused(docs.columns, "lines_dropped")))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("lines_dropped")[0].cast("long").alias("n_lines"), F.col("lines_dropped")[1].cast("long").alias("n_dropped"))


OP2_SQL = f"""
WITH doc AS (SELECT doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS l FROM documents),
total AS (SELECT host, count(*) AS pages FROM doc WHERE text IS NOT NULL GROUP BY host),
line AS (SELECT host, unnest(list_distinct(l)) AS x FROM doc WHERE text IS NOT NULL),
drops AS (SELECT host, list(x) AS d FROM (SELECT host, x, count(*) AS n FROM line WHERE x <> '' GROUP BY host, x) JOIN total USING (host) WHERE n >= {MIN_PAGES} AND n / pages > {RATIO} GROUP BY host),
kept AS (SELECT doc_id, source, text, l, CASE WHEN d IS NULL THEN l ELSE [x FOR x IN l IF x = '' OR NOT list_contains(d, x)] END AS k FROM doc LEFT JOIN drops USING (host))
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(k, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS BIGINT) AS n_lines, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(l) - len(k) END AS BIGINT) AS n_dropped
FROM kept
"""
