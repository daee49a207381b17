"""Stored tables of k-mer counts: sorted lists of hashed k-mers by bucket, in runs.

A run is a folder of Parquet files, partitioned by group (the upper bits of a k-mer's bucket, as k-mers are dealt out) and sorted by bucket (its bits, and some of the hash), a list of some ten
thousand k-mers in a row.  Lists are written as differences of sorted k-mers, and counts, by planes of bytes, and compressed: some six bytes a k-mer.
Lookups name the groups and buckets of what they ask for, so that a scan opens those folders and row groups only, and search the lists by bisection.
A run is added by writing its folder, and then a new manifest under the next number, which is renamed into place: what no manifest names doesn't count, and a batch that the
manifest names is not added again.  `compact` merges all runs into one and cuts its lists anew; what is left of older runs is deleted after that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import canonical, pack, unpack
from ..functions.kmers import _ODD, BUDGET, LEAST_PIECED, STORED, ROWS_AT_ONCE, Deal, added, as_text, buckets, counted_lists, occurrences_near, occurrences_of, read_list, stored_list, turned, undone
from ..sources.scratch import beside, shared_dir, written
from .counts import READ_CAP

#: Bits of groups at most, and those of a bucket beyond those that lists are exchanged by.
GROUP_BITS, FINER_BITS = 10, 6
#: Runs after which `add` compacts.
MOST_RUNS = 8
#: K-mers, or prefixes, that a scan looks for at once; more are looked for in several scans.
ASKED_AT_ONCE = 1 << 18
#: Buckets up to which a scan skips row groups that have none of them; of more it knows the range (Spark makes a nest of conditions of them).
MOST_PUSHED = 200
ROW_GROUP_BYTES = 1 << 20
#: K-mers with a prefix that a task finds before it keeps the first of each.
HITS_AT_ONCE = 1 << 21
_PUSHED = "spark.sql.parquet.pushdown.inFilterThreshold"
_SCHEMA = "bucket int, keys binary, counts binary, run string, group int"


__all__ = ["KmerTable", "Nearby", "Reads", "near", "stored", "turned"]


class _Searched:
    """What prefixes are searched for in: `spark`, `k`, and _searched(run, schema), which runs over (k-mers, counts) of all lists."""

    @staticmethod
    def _few(different: DataFrame) -> list | None:
        """The values of a column of different ones, or None if they are more than a scan looks for."""
        values = different.limit(ASKED_AT_ONCE + 1).toArrow().column(0).to_pylist()
        return values if len(values) <= ASKED_AT_ONCE else None

    def starting_with(self, prefixes: DataFrame, most: int | None, cap: int = READ_CAP) -> DataFrame:
        """(prefix, kmer, cov): k-mers as text, in either orientation, that start with prefixes (one column) shorter than k; most: the first so many by text of each.

        A prefix is a range of packed k-mers.  Tasks search both orientations of their k-mers in the prefixes' ranges, and keep the first of each; those are merged.  A k-mer that is among
        the first of all is so in each task that has it, so its counts are whole.  Many prefixes are searched for in several scans."""
        name = prefixes.columns[0]
        different = prefixes.where(F.col(name).isNotNull()).distinct()
        asked = self._few(different)
        if asked is not None:
            out = self._starting_with(asked, most)
        else:
            different = written(different)
            times = -(-2 * different.count() // ASKED_AT_ONCE)
            parts = (different.where(F.pmod(F.xxhash64(name), F.lit(times)) == i) for i in range(times))
            out = reduce(DataFrame.unionByName, (self._starting_with(p.toArrow().column(0).to_pylist(), most) for p in parts))
        found = out.groupBy("size", "prefix", "kmer").agg(F.least(F.sum("n"), F.lit(cap)).cast("int").alias("cov"))
        if most is not None:
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("size", "prefix").orderBy("kmer"))).where(F.col("rank") <= most)
        letters = F.expr("substring(translate(lpad(conv(cast(prefix AS string), 10, 4), size, '0'), '0123', 'ACGT'), 1, size)")
        return found.select(letters.alias("prefix"), unpack(F.col("kmer"), self.k).alias("kmer"), "cov")

    def _starting_with(self, asked: list[str], most: int | None) -> DataFrame:
        """(size, prefix, kmer, n), packed.  A task keeps what it found until there is much of it, and then the first of each prefix."""
        k, codes = self.k, {}
        for p in asked:
            if 0 < len(p) <= k and not set(p) - set("ACGT"):
                codes.setdefault(len(p), []).append(int("".join(str("ACGT".index(c)) for c in p), 4))
        codes = {size: np.sort(np.array(c, dtype=np.int64)) for size, c in codes.items()}

        def first(parts: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
            """Sorted k-mers and their sums, the first `most` of each prefix: a k-mer that is among the first of all lists is so in each task's."""
            kmer, n = added([(x.view(np.uint64), c) for x, c in parts] if len(parts) > 1 else [(parts[0][0].view(np.uint64), parts[0][1]), (np.zeros(0, np.uint64), np.zeros(0, np.int64))])
            kmer = kmer.view(np.int64)
            if most is not None and len(kmer):
                code = kmer >> 2 * (k - size)
                start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                keep = np.arange(len(kmer)) - np.repeat(start, np.diff(np.append(start, len(kmer)))) < most
                kmer, n = kmer[keep], n[keep]
            return kmer, n

        def run(lists: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {size: [] for size in codes}
            new = dict.fromkeys(codes, 0)
            last = {size: np.full(len(own), np.iinfo(np.int64).max) for size, own in codes.items()}  # of the first of each prefix so far

            def rows(size: int) -> Iterator[pa.RecordBatch]:
                kmer, n = first(held[size], size)
                for low in range(0, len(kmer), ROWS_AT_ONCE):
                    own = kmer[low : low + ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), size, np.int32)), pa.array(own >> 2 * (k - size)), pa.array(own), pa.array(n[low : low + ROWS_AT_ONCE])], names=["size", "prefix", "kmer", "n"])

            for kmer, n in lists:
                other = turned(kmer, k)
                both, counts = np.concatenate([kmer, other[other != kmer]]), np.concatenate([n, n[other != kmer]])
                for size, own in codes.items():
                    code = both >> 2 * (k - size)
                    at = np.minimum(np.searchsorted(own, code), len(own) - 1)
                    hit = np.flatnonzero((own[at] == code) & (both <= last[size][at]))
                    if len(hit):
                        held[size].append((both[hit], counts[hit]))
                        new[size] += len(hit)
                    if new[size] > HITS_AT_ONCE:
                        if most is None:
                            yield from rows(size)
                            held[size] = []
                        else:
                            held[size] = [first(held[size], size)]
                            found = held[size][0][0]
                            code = found >> 2 * (k - size)
                            full = np.flatnonzero(code[most - 1 :] == code[: len(code) - most + 1]) if 0 < most <= len(code) else np.zeros(0, np.int64)
                            last[size][np.searchsorted(own, code[full])] = found[full + most - 1]
                        new[size] = 0
            for size in codes:
                if held[size]:
                    yield from rows(size)

        schema = "size int, prefix long, kmer long, n long"
        return self._searched(run, schema) if codes else self.spark.createDataFrame([], schema)


class KmerTable(_Searched):
    """A stored table; `k`, `runs`, `batches` (numbers of batches that are in it), `coarse` and `fine` (bits of buckets, as exchanged and as stored)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._scanned = spark, path, None
        found = [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")]
        if not found:
            raise ValueError(f"no table in {path}")
        self.version = max(found)
        text = spark.read.text(f"{path}/manifest/{self.version}.json", wholetext=True).first()[0]
        self.__dict__.update(json.loads(text))

    @classmethod
    def create(cls, spark: SparkSession, path: str, k: int, source: DataFrame) -> KmerTable:
        """An empty table whose buckets suit the size of a source: reads (seq), or a table (kmer, n or cov)."""
        table = cls.__new__(cls)
        coarse = Deal(source).bits
        table.spark, table.path, table.version, table._scanned = spark, path, -1, None
        table.__dict__.update(k=k, runs=[], batches=[], coarse=coarse, fine=coarse + FINER_BITS)
        table._commit(table.runs, table.batches, table.coarse, table.fine)
        return table

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(at(folder))] if fs.exists(at(folder)) else []

    def _commit(self, runs: list[str], batches: list[int], coarse: int, fine: int) -> None:
        """Writes the next manifest beside its place, and renames it."""
        fs, at = self._fs()
        number, state = self.version + 1, dict(k=self.k, runs=runs, batches=batches, coarse=coarse, fine=fine)
        out = fs.create(at(f"manifest/{number}.tmp"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(at(f"manifest/{number}.tmp"), at(f"manifest/{number}.json")):
            raise RuntimeError(f"another job has written version {number} of {self.path}")
        self.version, self._scanned = number, None
        self.__dict__.update(state)

    @property
    def deal(self) -> Deal:
        return Deal(None, self.coarse)

    @property
    def lists(self) -> DataFrame:
        """(bucket, asks, keys, counts) of all runs, by the buckets that lists are exchanged by."""
        return self._scan().select(F.shiftright("bucket", self.fine - self.coarse).alias("bucket"), F.lit(STORED).alias("asks"), "keys", "counts")

    @staticmethod
    def _stored_buckets(keys: np.ndarray, bucket: np.ndarray, coarse: int, fine: int) -> np.ndarray:
        """Buckets that lists are stored by, of hashed k-mers and the buckets that they are exchanged by: the upper bits of the hash, which cut a bucket's sorted k-mers evenly."""
        return bucket << (fine - coarse) | (keys >> np.uint64(64 - fine + coarse)).astype(np.int64)

    def _scan(self) -> DataFrame:
        """The lists of the runs.  Their files are listed once for each version of the table."""
        if not self.runs:
            return self.spark.createDataFrame([], _SCHEMA)
        if self._scanned is None:
            folders = [f"{self.path}/data/run={run}" for run in self.runs]
            self._scanned = self.spark.read.schema(_SCHEMA).option("basePath", f"{self.path}/data").parquet(*folders)
        return self._scanned

    def _write(self, lists: DataFrame, coarse: int, fine: int, run: str, cut: int | None = None) -> None:
        """Merges lists by bucket and writes them as a run, cut to `fine` bits.  lists: by buckets of `coarse` bits; cut: how many of the stored bits are of the buckets of k-mers."""
        group_bits, k = min(coarse, GROUP_BITS), self.k
        dealt_out = Deal(None, cut or coarse)

        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, keys, n, _ in buckets(batches, k):
                bucket = np.full(len(keys), own, np.int64) if dealt_out.bits == coarse else dealt_out.of(keys, k)
                bucket = KmerTable._stored_buckets(keys, bucket, dealt_out.bits, fine)
                order = np.argsort(bucket, kind="stable")
                full, first = np.unique(bucket[order], return_index=True)
                at = np.append(first, len(order))
                for low in range(0, len(full), 64):
                    lists = [stored_list(keys[order[at[i] : at[i + 1]]], n[order[at[i] : at[i + 1]]]) for i in range(low, min(low + 64, len(full)))]
                    part = full[low : low + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary()), pa.array((part >> (fine - group_bits)).astype(np.int32))], names=["bucket", "keys", "counts", "group"])

        own = F.shiftright("bucket", coarse - group_bits)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = lists.repartition(n, own).sortWithinPartitions(own, "bucket")
        rows = dealt.mapInArrow(merge, "bucket int, keys binary, counts binary, group int")
        options = {"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.enable.dictionary": "false", "compression": "zstd"}
        rows.write.options(**options).partitionBy("group").mode("overwrite").parquet(f"{self.path}/data/run={run}")

    def add(self, source: DataFrame, batch: int | None = None, most_runs: int = MOST_RUNS) -> None:
        """Adds the counts of reads (seq), or a table (kmer, n or cov).  A batch that is in the table already is left out; one whose run was written, but not
        committed, is written again."""
        if batch is not None and batch in self.batches:
            return
        run = f"c{self.version + 1}" if batch is None else f"b{batch}"
        self._write(Deal(None, self.coarse).counted(source, self.k), self.coarse, self.fine, run)
        self._commit([*self.runs, run], self.batches if batch is None else [*self.batches, batch], self.coarse, self.fine)
        if len(self.runs) > most_runs:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one, with as many buckets as its k-mers ask for, and deletes what no manifest names."""
        keys = self._scan().agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
        coarse = max(self.coarse, (2 * keys // BUDGET).bit_length())
        fine, run = max(self.fine, coarse + FINER_BITS), f"c{self.version + 1}"
        self._write(self.lists, self.coarse, fine, run, coarse)
        self._commit([run], self.batches, coarse, fine)
        fs, at = self._fs()
        for name in self._names("data"):
            if name != f"run={run}" and not name.startswith("_"):
                fs.delete(at(f"data/{name}"), True)

    def rows(self, text: bool = False) -> DataFrame:
        """(kmer, n): counts over all runs, without a cap."""
        k = self.k

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, keys, n, _ in buckets(batches, k):
                kmer = undone(keys)
                yield pa.RecordBatch.from_arrays([as_text(kmer, k) if text else pa.array(kmer), pa.array(n)], names=["kmer", "n"])

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lists = self.lists.repartition(n, "bucket").sortWithinPartitions("bucket") if len(self.runs) > 1 else self.lists
        return lists.mapInArrow(run, f"kmer {'string' if text else 'long'}, n long")

    def lists_for(self, keys: np.ndarray) -> DataFrame:
        """The lists that can hold hashed keys, by folders and row groups of their buckets."""
        own = np.unique(self._stored_buckets(keys, self.deal.of(keys, self.k), self.coarse, self.fine))
        groups = np.unique(own >> (self.fine - min(self.coarse, GROUP_BITS)))
        if int(self.spark.conf.get(_PUSHED, "10")) < MOST_PUSHED:
            self.spark.conf.set(_PUSHED, str(MOST_PUSHED))
        if not len(own):
            return self._scan().limit(0).select("keys", "counts")
        listed = lambda column, values: f"{column} IN ({', '.join(map(str, values))})"  # noqa: E731  (as one text; a Column for each value takes a call to the JVM)
        return self._scan().where(f"{listed('group', groups)} AND {listed('bucket', own)}").select("keys", "counts")

    def counts_of(self, kmers: DataFrame, cap: int = READ_CAP) -> DataFrame:
        """(kmer, cov) of those packed canonical k-mers (one column) that are in the table, with a hint to broadcast them: they are ASKED_AT_ONCE rows at most.  Where more are
        asked for, most lists are read anyway, and the whole table is joined to them, without a hint."""
        name = kmers.columns[0]
        different = kmers.where(F.col(name).isNotNull()).distinct()
        asked = self._few(different)
        if asked is None:
            found = self.rows().join(different.withColumnRenamed(name, "kmer"), "kmer", "left_semi")
            return found.select("kmer", F.least("n", F.lit(cap)).cast("int").alias("cov"))
        keys = np.sort(np.array(asked, dtype=np.int64).view(np.uint64) * _ODD)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own, n = read_list(batch, i)
                    wanted = keys[np.searchsorted(keys, own[0]) : np.searchsorted(keys, own[-1], side="right")]
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    hit = own[at] == wanted
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(undone(wanted[hit])), pa.array(n[at[hit]])], names=["kmer", "n"])

        if not len(keys) or not self.runs:
            return self.spark.createDataFrame([], "kmer long, cov int")
        found = self.lists_for(keys).mapInArrow(run, "kmer long, n long")
        return F.broadcast(found.groupBy("kmer").agg(F.least(F.sum("n"), F.lit(cap)).cast("int").alias("cov")))

    def _searched(self, run: Callable, schema: str) -> DataFrame:
        lists = lambda batches: ((undone(keys), n) for batch in batches for keys, n in (read_list(batch, i) for i in range(batch.num_rows)))
        return self._scan().select("keys", "counts").mapInArrow(lambda batches: run(lists(batches)), schema)

    def summary(self) -> DataFrame:
        """One row: different k-mers, and their total coverage (of capped counts)."""

        k = self.k

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            different = total = 0
            for _, keys, n, _ in buckets(batches, k):
                different, total = different + len(keys), total + int(np.minimum(n, READ_CAP).sum())
            yield pa.RecordBatch.from_arrays([pa.array([different]), pa.array([total])], names=["distinct_kmers", "total_coverage"])

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = self.lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "distinct_kmers long, total_coverage long")
        return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns))


def stored(source: DataFrame | KmerTable, k: int, path: str | None = None) -> KmerTable:
    """A table of the counts of reads (seq), or of a table (kmer, n or cov), in the shared folder if no path is given; a stored table as it is."""
    if isinstance(source, KmerTable):
        return source
    spark = source.sparkSession
    table = KmerTable.create(spark, path or shared_dir(spark, "kmers"), k, source)
    table.add(source)
    return table


class Nearby:
    """The counts (kmer, n), written, of what can be asked for, in place of a table of all k-mers."""

    def __init__(self, counts: DataFrame):
        self.counts = beside(counts)

    def counts_of(self, kmers: DataFrame, cap: int = READ_CAP) -> DataFrame:
        """(kmer, cov) of those packed canonical k-mers, and others."""
        return self.counts.select("kmer", F.least("n", F.lit(cap)).cast("int").alias("cov"))


class Reads(_Searched):
    """Reads (seq) in place of a stored table, where they are asked once or twice: many k-mers are counted in buckets that hear what is asked for, and prefixes are searched for by tasks in what they read."""

    def __init__(self, reads: DataFrame, k: int):
        self.spark, self.reads, self.k = reads.sparkSession, reads.select("seq"), k

    def _searched(self, run: Callable, schema: str) -> DataFrame:
        k = self.k
        return self.reads.mapInArrow(lambda batches: run(counted_lists(batches, k)), schema)

    def counts_of(self, kmers: DataFrame, cap: int = READ_CAP) -> DataFrame:
        """(kmer, cov), written, of those packed canonical k-mers (one column) that occur."""
        name = kmers.columns[0]
        asked = kmers.where(F.col(name).isNotNull()).distinct().select(unpack(F.col(name), self.k).alias("seq"))
        return written(occurrences_of(self.reads, asked, self.k).select("kmer", F.least("n", F.lit(cap)).cast("int").alias("cov")))


def near(nodes: DataFrame, source: DataFrame | KmerTable | Nearby, k: int, steps: int) -> KmerTable | Nearby | Reads:
    """What nodes (kmer, direction; better written) and all k-mers within so many steps of them are looked up in.

    All that is reached from a k-mer in `steps` steps keeps its first, or last, k - steps bases.  So reads (seq), or a table (kmer, n or cov), are read once, and only k-mers that hold those bases
    are counted, which are few and are written.  Nodes that have more than ASKED_AT_ONCE different such parts, or too short ones, ask the reads in buckets for one step, and for more a stored table of all
    k-mers."""
    if not isinstance(source, DataFrame):
        return source
    size = k - steps
    if size >= LEAST_PIECED:
        part = F.when(F.col("direction") == "up", F.substring("kmer", 1, size)).otherwise(F.expr(f"right(kmer, {size})"))
        asked = KmerTable._few(nodes.select(pack(canonical(part)).alias("core")).where("core IS NOT NULL").distinct())
        if asked is not None:
            return Nearby(written(occurrences_near(source, np.array(asked, dtype=np.int64), k, steps)))
    return Reads(source, k) if steps == 1 and "seq" in source.columns else stored(source, k)
