"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_open: ContextVar[list[DataFrame] | None] = ContextVar("tables of the innermost settled() function", default=None)


def shared_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, a local session gets a temporary one; a cluster's session is refused,
    as its executors would not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    at = spark._jvm.org.apache.hadoop.fs.Path(base, f"{name}-{uuid.uuid4().hex}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: computed once, and no lineage behind it."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    if (own := _open.get()) is not None:
        own.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the tables behind results of written()."""
    for df in tables:
        if path := getattr(df, "_helix_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a written table up to which it is broadcast; larger ones are joined by a shuffle.
FEW_ROWS = 1 << 20


def beside(small: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written table of short rows, with the hint that suits its size: rows are counted before they are broadcast."""
    return F.broadcast(small) if small.count() <= most else small.hint("merge")


def settled(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is written before it returns, whereupon all other tables that it wrote are deleted."""

    @wraps(f)
    def run(*args, **options) -> DataFrame:
        outer, own = _open.get(), []
        token = _open.set(own)
        try:
            out = written(f(*args, **options))
        finally:
            _open.reset(token)
            dropped(*(df for df in own if "out" not in locals() or df is not out))
        if outer is not None:
            outer.append(out)
        return out

    return run


def unused(columns: list[str], name: str) -> str:
    """A column name like `name` that none of the columns has, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(rows: DataFrame, block: list[str], place: str, name: str) -> DataFrame:
    """rows with one more column, their number from 0 in the order of block and place.  Blocks, such as a file's splits, are counted, and rows numbered
    within their block: only a row for each block is brought into one order."""
    before, n = unused(rows.columns, "before"), unused(rows.columns, "n")
    sizes = rows.groupBy(*block).agg(F.count("*").alias(n))
    earlier = F.sum(n).over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*block, F.coalesce(earlier, F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(place))
    return rows.join(sizes, block).withColumn(name, (F.col(before) + inside - 1).cast("long")).drop(before)
