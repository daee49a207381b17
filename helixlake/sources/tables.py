"""Strands, alignments and results in line-based text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import numbered
from .sequences import as_strands, scan_sequences

QC_ROW = "index int, name string, rawLength int, analyzedLength int, status string, message string, summary struct<length:int,k:int,kmerCount:int,observed:int,missing:int,complete:boolean,minCoverage:int,maxCoverage:int,meanCoverage:double,maxAdjacentRatio:double>"
GRID = "ratio double, coverage int, total long, paths long, noise long, exist long, lost long, sm double, kd double, kn double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): line grows along a block, which is a split of a file."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def tab_strand(line: Column) -> tuple[Column, Column]:
    """(name, seq) of a tab-separated line: the sequence is the last column of DNA letters only; the name the first, unless that is the
    sequence.  Null where there is no sequence."""
    columns = F.split(line, "\t", -1)
    columns = F.transform(columns, lambda c: F.trim(c))
    dna = F.filter(F.transform(columns, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: F.rlike(x["c"], F.lit("^[ACGTNacgtn]+$")))
    last = F.when(F.size(dna) > 0, F.element_at(dna, -1))
    name = F.when(last["i"] > 0, F.regexp_replace(columns[0], r"\s+", "_"))
    return F.nullif(name, F.lit("")), F.upper(last["c"])


def scan_tab_strands(spark: SparkSession, path: str) -> DataFrame:
    """(strand_id, name, seq); lines without a sequence are left out, and a strand without a name is seqN, N its number from 1."""
    name, seq = tab_strand(F.col("value"))
    rows = _lines(spark, path).select("file", "block", "line", name.alias("name"), seq.alias("seq")).where("seq IS NOT NULL")
    own = numbered(rows, ["file", "block"], "line", "strand_id").select("strand_id", "name", "seq")
    return own.withColumn("name", F.coalesce("name", F.concat(F.lit("seq"), (F.col("strand_id") + 1).cast("string"))))


def scan_tab_simple(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of two tab-separated columns, without header lines."""
    rows = spark.read.csv(path, sep="\t", schema="name string, seq string")
    return rows.where(~F.lower("name").isin("head-index", "name", "id") & F.col("seq").isNotNull()).select("name", F.upper("seq").alias("seq"))


def normalize_reference(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the second column's DNA letters, in upper case, without the first line and empty sequences."""
    rows = spark.read.csv(path, sep="\t", schema="name string, seq string", header=True, enforceSchema=True)
    return rows.select("name", F.upper(F.regexp_replace("seq", "[^ACGTNacgtn]", "")).alias("seq")).where("seq <> ''")


def detect_format(spark: SparkSession, path: str) -> str:
    """fasta, fastq or tab, by the first line that isn't blank."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    sign = first["value"].lstrip()[:1] if first else ""
    return {">": "fasta", "@": "fastq"}.get(sign, "tab")


def scan_strands(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    kind = detect_format(spark, path) if kind == "auto" else kind
    return scan_tab_strands(spark, path) if kind == "tab" else as_strands(scan_sequences(spark, path))


def parse_paf(lines: DataFrame) -> DataFrame:
    """(line, fields, query, query_length, ..., mapq, tags) of PAF lines (line, value); rows of fewer than twelve fields have nulls.  tags: by their two
    letters, the first of a name."""
    f = F.split("value", "\t", -1)
    tag = F.filter(F.slice(f, 13, F.greatest(F.size(f) - 12, F.lit(0))), lambda t: (F.length(t) >= 6) & (F.substring(t, 3, 1) == ":"))
    pairs = F.transform(tag, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value")))
    once = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.create_map(p["key"], p["value"]))))
    text = {"query": 0, "strand": 4, "target": 5}
    numbers = {"query_length": 1, "query_start": 2, "query_end": 3, "target_length": 6, "target_start": 7, "target_end": 8, "matches": 9, "block_length": 10, "mapq": 11}
    long_enough = F.size(f) >= 12
    cols = {i: F.when(long_enough, f[i]).alias(c) for c, i in text.items()} | {i: F.when(long_enough, f[i].try_cast("int")).alias(c) for c, i in numbers.items()}
    return lines.select("line", F.size(f).alias("fields"), *(cols[i] for i in sorted(cols)), F.when(long_enough, once).alias("tags"))


def scan_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(_lines(spark, path))


def scan_qc_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last batch message among lines of JSON."""
    lines = _lines(spark, path).where(F.startswith(F.ltrim("value"), F.lit("{"))).withColumn("at", F.struct("file", "block", "line"))
    # the message is chosen by its place alone, and only then parsed
    last = lines.where(F.from_json("value", "type string")["type"] == "batch").agg(F.max("at").alias("last"))
    kinds = ", ".join(c.replace(" ", ":", 1) for c in QC_ROW.split(", ", 6))
    message = lines.join(F.broadcast(last), F.col("at") == F.col("last")).select(F.from_json("value", f"rows array<struct<{kinds}>>").alias("m"))
    return message.select(F.explode("m.rows").alias("r")).select("r.*")


def scan_metric_grid(spark: SparkSession, path: str) -> DataFrame:
    """GRID of a tab-separated metric table; other lines are left out."""
    f = F.split("value", "\t", -1)
    kinds = [c.split() for c in GRID.split(", ")]
    rows = spark.read.text(path).where(F.size(f) == len(kinds)).where(f[0].try_cast("double").isNotNull())
    return rows.select(*(f[i].try_cast(t).alias(c) for i, (c, t) in enumerate(kinds)))
