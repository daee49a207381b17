"""Results as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recovery import listed_ratios, packed
from .scratch import written

BATCH_COLUMNS = {
    "name": "name", "raw_length": "raw_length", "analyzed_length": "analyzed_length", "status": "status", "observed": "observed_kmers", "kmer_count": "total_kmers",
    "complete": "path_complete", "min_cov": "min_cov", "mean_cov": "mean_cov", "max_cov": "max_cov", "max_ratio": "max_adjacent_ratio",
}


def _number(value: Column, form: str = "%f") -> Column:
    return F.when(F.isnan(value), "nan").otherwise(F.format_string(form, value))


GRID_HEADER = "Ratio\tCoverage\tTotal\tPaths\tNoise\tExist\tLost\tSm\tKd\tKn"


def _grid_line() -> Column:
    cells = [_number(F.col("ratio"), "%.2f"), *(F.col(c).cast("string") for c in ("coverage", "total", "paths", "noise", "exist", "lost")), *(_number(F.col(c)) for c in ("sm", "kd", "kn"))]
    return F.concat_ws("\t", *cells)


def grid_lines(grid: DataFrame) -> DataFrame:
    """(value): tab-separated lines of the metric grid, ratios and measures with fixed decimals."""
    return grid.orderBy("ratio", "coverage").select(_grid_line().alias("value"))


def write_metric_grid(grid: DataFrame, path: str) -> None:
    """One file: a header, and a line for each cell.  The grid has few rows."""
    head = grid.sparkSession.createDataFrame([(None, None, GRID_HEADER)], "ratio double, coverage int, value string")
    cells = grid.select("ratio", "coverage", _grid_line().alias("value"))
    # nulls, and so the header, come first
    head.unionByName(cells).coalesce(1).sortWithinPartitions("ratio", "coverage").select("value").write.text(path)


def _listed(rows: DataFrame, order: str, value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]), " ")


def _named(lists: DataFrame, strands: DataFrame, value: Column) -> DataFrame:
    """(strand_id, value): name, tab, and the values with blanks between them."""
    return strands.select("strand_id", "name").join(lists, "strand_id").select("strand_id", F.concat_ws("\t", "name", F.array_join(value, " ")).alias("value"))


def _coverage_rows(covered: DataFrame, strands: DataFrame) -> DataFrame:
    return _named(packed(covered), strands, F.transform("cov", lambda c: c.cast("string")))


def _ratio_rows(covered: DataFrame, strands: DataFrame) -> DataFrame:
    return _named(listed_ratios(covered).where(F.size("ratios") > 0), strands, F.transform("ratios", lambda r: F.format_string("%.3f", r)))


def coverage_lines(covered: DataFrame, strands: DataFrame) -> DataFrame:
    """(value): name, tab, the coverages of the strand's different k-mers in order; strands without k-mers are left out."""
    return _coverage_rows(covered, strands).select("value")


def ratio_lines(covered: DataFrame, strands: DataFrame) -> DataFrame:
    """(value): name, tab, the ratios between those, for strands of two k-mers or more."""
    return _ratio_rows(covered, strands).select("value")


def write_coverages(covered: DataFrame, strands: DataFrame, path: str) -> None:
    write_lines(written(_coverage_rows(covered, strands)), path)


def write_ratios(covered: DataFrame, strands: DataFrame, path: str) -> None:
    write_lines(written(_ratio_rows(covered, strands)), path)


def range_lines(ranges: DataFrame) -> DataFrame:
    """(value): two lines, the least and the greatest ratio at each place; as long as the longest strand."""
    rows = ranges.agg(_listed(ranges, "i", F.format_string("%.3f", F.col("min_ratio"))).alias("low"), _listed(ranges, "i", F.format_string("%.3f", F.col("max_ratio"))).alias("high"))
    return rows.select(F.explode(F.array("low", "high")).alias("value"))


def write_ranges(ranges: DataFrame, path: str) -> None:
    """One file of two lines: the least ratios, then the greatest."""
    rows = range_lines(ranges).select("value", F.monotonically_increasing_id().alias("line"))
    rows.coalesce(1).sortWithinPartitions("line").select("value").write.text(path)


def fasta_lines(strands: DataFrame) -> DataFrame:
    return strands.select(*(c for c in ["strand_id"] if c in strands.columns), F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files, in the strands' order where there is a strand_id: strands are dealt out by ranges of it, so files follow each other."""
    if "strand_id" in lines.columns:
        lines = lines.repartitionByRange("strand_id").sortWithinPartitions("strand_id")
    lines.select("value").write.text(path)


def write_fasta(strands: DataFrame, path: str) -> None:
    write_lines(fasta_lines(strands), path)


def write_names(strands: DataFrame, path: str) -> None:
    write_lines(strands.select(*(c for c in ["strand_id"] if c in strands.columns), F.col("name").alias("value")), path)


def write_screen(screened: DataFrame, strands_path: str, names_path: str) -> None:
    """Passed strands as FASTA, whole sequences; names of the filtered ones."""
    write_fasta(screened.where("status = 'passed'"), strands_path)
    write_names(screened.where("status = 'filtered'"), names_path)


def batch_rows(qc: DataFrame) -> DataFrame:
    """The batch table as it is written: index from 1, yes or no for complete paths."""
    yes = F.when(F.col("complete"), "yes").when(~F.col("complete"), "no")
    return qc.withColumn("complete", yes).select((F.col("strand_id") + 1).alias("index"), *(F.col(c).alias(n) for c, n in BATCH_COLUMNS.items()))


def write_batch_csv(qc: DataFrame, path: str) -> None:
    """Files in the strands' order, each with a header."""
    batch_rows(qc).repartitionByRange("index").sortWithinPartitions("index").write.csv(path, header=True)


def write_consensus(consensus: DataFrame, table_path: str, fasta_path: str) -> None:
    """The table as CSV and the sequences as FASTA, both in the order of strand_id where there is one, else of the names."""
    order = "strand_id" if "strand_id" in consensus.columns else "name"
    consensus = written(consensus)  # ranges are found by reading it, and it is read for both
    rows = consensus.repartitionByRange(order).sortWithinPartitions(order)
    rows.drop("consensus", "strand_id").write.csv(table_path, header=True)
    write_fasta(consensus.select(F.col(order).alias("strand_id"), "name", F.col("consensus").alias("seq")), fasta_path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)
