"""The driver's tables as DNA: strands, reads and alignments, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import enc

K, K_SHORT, READ_LENGTH = 31, 8, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out anew where the scan has fewer partitions than the cluster has cores (one small file, or a gzip one), before
    sequences are cut into many more rows.  Large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def strands(spark: SparkSession, sf_dir: str, other: str = "") -> DataFrame:
    """(strand_id, name, seq) of the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("strand_id"), F.concat(F.lit("strand"), F.col("item_id").cast("string")).alias("name"), enc(F.col("text"), other).alias("seq"))


def reads(spark: SparkSession, sf_dir: str, other: str = "") -> DataFrame:
    """(read_id, seq) of the documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("read_id"), enc(F.col("text"), other).alias("seq"))


def pool(spark: SparkSession, sf_dir: str, other: str = "") -> DataFrame:
    """The documents as strands, with their copies."""
    return reads(spark, sf_dir, other).select(F.col("read_id").alias("strand_id"), F.concat(F.lit("doc"), F.col("read_id").cast("string")).alias("name"), "seq")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq): a strand of 60 bases for each part, from its number and name."""
    word = F.concat(F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.translate(F.substring(F.concat(F.md5(word), F.md5(F.reverse(word))), 1, 60), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAF columns of an alignment for each line item: to its part, with a substitution, a deletion and an insertion."""
    key = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity").cast("int").alias("q")
    lines = table(spark, sf_dir, "lineitem").select(*key).distinct()  # before anything is made of them: four numbers are moved, and no texts
    q, n = F.col("q"), F.col("l_linenumber").cast("int")
    cs = F.concat(F.lit(":"), (q % 20 + 1).cast("string"), F.lit("*ac:"), (n + 4).cast("string"), F.lit("-gt:"), (q % 7 + 1).cast("string"), F.lit("+a*tg:"), (n % 3 + 1).cast("string"))
    tags = F.create_map(F.lit("tp"), F.when(q % 11 == 0, "S").otherwise("P"), F.lit("cs"), F.when(q % 13 != 0, cs))
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), q.cast("string")).alias("row_id"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("target"),
        (q % 5).alias("target_start"),
        (q + 30).alias("matches"),
        (q + 30 + n * 2).alias("block_length"),
        (q % 60).alias("mapq"),
        tags.alias("tags"),
    )


def simulated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, name, seq): a read for each line item, a piece of its part's strand whose place and length follow from the quantity."""
    q = F.col("l_quantity").cast("int")
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), q.cast("string")).alias("read_id"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("name"), q.alias("q"))
    return lines.join(targets(spark, sf_dir), "name").select("read_id", "name", F.substring(F.col("seq"), 1 + F.col("q") % 5 * 6, 31 + F.col("q") % 30).alias("seq"))


SQL_SIMULATED = """simulated AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || q AS read_id, name, substr(seq, 1 + q % 5 * 6, 31 + q % 30) AS seq
  FROM (SELECT *, 'part' || l_partkey AS name, CAST(l_quantity AS INTEGER) AS q FROM lineitem) JOIN targets USING (name))"""


_ENC = "regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '{}', 'g')"


def sql_strands(other: str = "") -> str:
    return f"strands AS (SELECT item_id AS strand_id, 'strand' || item_id AS name, {_ENC.format(other)} AS seq FROM benchmark)"


def sql_reads(other: str = "") -> str:
    return f"reads AS (SELECT doc_id AS read_id, {_ENC.format(other)} AS seq FROM documents)"


def sql_pool(other: str = "") -> str:
    return f"strands AS (SELECT doc_id AS strand_id, 'doc' || doc_id AS name, {_ENC.format(other)} AS seq FROM documents)"


SQL_TARGETS = "targets AS (SELECT 'part' || p_partkey AS name, translate(substr(md5(p_partkey || '|' || p_name) || md5(reverse(p_partkey || '|' || p_name)), 1, 60), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part)"
SQL_ALIGNMENTS = """alignments AS (
  SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || q AS row_id, 'part' || l_partkey AS target, q % 5 AS target_start, q + 30 AS matches, q + 30 + n * 2 AS block_length, q % 60 AS mapq,
    CASE WHEN q % 11 = 0 THEN 'S' ELSE 'P' END AS tp,
    CASE WHEN q % 13 <> 0 THEN ':' || (q % 20 + 1) || '*ac:' || (n + 4) || '-gt:' || (q % 7 + 1) || '+a*tg:' || (n % 3 + 1) END AS cs
  FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, CAST(l_linenumber AS INTEGER) AS n FROM lineitem))"""


def sql_kmers(source: str, key: str, k: int, name: str, seq: str = "seq") -> str:
    """A common table (key, pos, kmer): canonical k-mers as text, at each valid position.  Sequences are cut into pieces of 200 windows first, as substr() walks from the
    start of its text."""
    return f"""{name} AS (
  SELECT {key}, first + p - 1 AS pos, least(s, translate(reverse(s), 'ACGT', 'TGCA')) AS kmer
  FROM (SELECT {key}, first, p, substr(part, p, {k}) AS s FROM (SELECT {key}, first, part, unnest(generate_series(1, length(part) - {k} + 1)) AS p FROM (
    SELECT {key}, q - 1 AS first, substr({seq}, q, {200 + k - 1}) AS part FROM (SELECT {key}, {seq}, unnest(generate_series(1, length({seq}) - {k} + 1, 200)) AS q FROM {source} WHERE length({seq}) >= {k}))))
  WHERE NOT regexp_matches(s, '[^ACGT]'))"""


def sql_counts(k: int, length: int = 0, other: str = "") -> str:
    """Common tables reads, cut, read_kmers and counts (kmer, cov)."""
    cut = f"substr(seq, 1, {max(length, k)})" if length else "seq"
    return f"""{sql_reads(other)}, cut AS (SELECT read_id, {cut} AS seq FROM reads WHERE length(seq) >= {k}),
{sql_kmers("cut", "read_id", k, "read_kmers")},
counts AS MATERIALIZED (SELECT kmer, CAST(least(count(*), 16383) AS INTEGER) AS cov FROM read_kmers GROUP BY kmer)"""
