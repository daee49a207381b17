"""Best-fit packing planned on a histogram of lengths.

Texts become token ids with an end id; longer ones are cut into pieces of `size` tokens.  Best fit decreasing runs on the
driver over counts of lengths (at most `size` numbers, whatever the input), treating equal sequences as one group, and yields a
plan of slots by rank within length (a few rows for each length).  A piece's rank is its number among those of its
length in its task plus those in earlier tasks, so no length is sorted or gathered in one place.

Cases: null and empty texts have the end id alone; a text of more than `size` tokens fills whole sequences and leaves a
rest; repeated rows are packed each; ties of length are interchangeable; a null id is kept; empty tables give no pieces; other columns of
the input are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table, written
from .tokens import CACHE, TOKENIZER, encoder
from .words import buffers, chunks

SIZE = 4096
END = 1


def token_pieces(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, end: int = END, tokenizer: str = TOKENIZER, cache: int = CACHE) -> DataFrame:
    """(id, piece, start, length, crc, part, local): the pieces of each text, and each one's number among those of its length in
    its task."""
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        encode = encoder(tokenizer, cache).ids
        for batch in chunks(batches):
            data, at = buffers(batch.column("text"))
            data, rows = data.tobytes(), []
            for k in range(batch.num_rows):
                ids = encode(data[at[k] : at[k + 1]]) + last
                for piece, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start : start + 4 * size]
                    n = len(own) // 4
                    rows.append((k, piece, start // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            k, piece, start, length, crc, local = (np.array(c, dtype=np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(k), part)), pa.array(local)], names=["id", "piece", "start", "length", "crc", "part", "local"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long, part long, local long")


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """The plan: rows (length, first rank, end rank, first sequence, in each, offset).  The pieces of a length with ranks from
    first to end go to sequences one after the other, `in each` of them to a sequence, from the offset on.

    Best fit decreasing: the longest first, each into the fullest sequence that has room.  Sequences that are alike are one group:
    (first sequence, how many).  As equal pieces go on into the same sequence while it has room, a length splits one group at
    most."""
    groups: dict[int, list[tuple[int, int]]] = {}
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in sorted(r for r in groups if r >= length):
            fits, rest = room // length, []
            for first, many in groups.pop(room):
                for bins, each in ((min(many, left // fits), fits), (1, left % fits)):
                    # the second only once fewer are left than one sequence takes
                    if not bins or not each or not many or left < each or each < fits and left != each:
                        continue
                    plan.append((length, rank, rank + bins * each, first, each, size - room))
                    groups.setdefault(room - each * length, []).append((first, bins))
                    first, many, left, rank = first + bins, many - bins, left - bins * each, rank + bins * each
                if many:
                    rest.append((first, many))
            if rest:
                groups.setdefault(room, []).extend(rest)
            if not left:
                break
        fits = size // length
        for bins, each in ((left // fits, fits), (1, left % fits)):
            if bins and each:
                plan.append((length, rank, rank + bins * each, sequences, each, 0))
                groups.setdefault(size - each * length, []).append((sequences, bins))
                sequences, rank = sequences + bins, rank + bins * each
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, tokenizer: str = TOKENIZER, cache: int = CACHE) -> DataFrame:
    """A row for each piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset).  cache: pieces of text that a worker keeps the ids of."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, id_col, text_col, size, end, tokenizer, cache))
    by_task = pieces.groupBy("length", "part").count()
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("length", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    # at most `size` rows
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit(counts, size), "length long, from long, to long, first long, each long, at long")
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    # a few rows for each of at most `size` lengths
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= from AND rank < to")
    inside = F.col("rank") - F.col("from")
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        (F.col("first") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + inside % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
