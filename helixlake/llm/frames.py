"""Token ids in files of independent zstandard frames with a seek table.

A file is a row of zstandard frames, each of whole documents, and a skippable frame at the end: the seek table of the public
seekable format, with compressed and decompressed size and a checksum (low 32 bits of XXH64) for each frame.  A frame's
content is: number of documents (u64), then for each its id (i64), whether it has one (u8) and its number of tokens (u32), then
all ids (u32); all little-endian.  The files' names and frames are listed in a manifest, a Parquet table with a row for each frame
and its first and last document.  Readers take the places and checksums of frames from the seek table at a file's end, and fetch and decompress
the frames that they need only: `read_documents` those of all rows of a manifest, `read_wanted` those that hold the documents asked for.

Tasks write under names of their own attempt, and the manifest is committed by Spark: what a lost or repeated attempt leaves is never read.

Cases: ids are integers (others are refused); null and empty texts have the end id alone; null document ids come first; repeated ids keep a row each, ordered by
text; a text longer than a frame makes one frame; empty tables give an empty manifest; other columns of the input are not touched.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .tables import shared_dir, table, written
from .tokens import TOKENIZER, encoder
from .words import buffers, chunks

END = 2
#: A frame is closed once it has so many ids.
FRAME_TOKENS = 1 << 16
#: Frames that one task reads.
FRAMES_A_TASK = 64
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part long, frame int, path string, offset long, size long, content long, checksum long, docs long, tokens long, first_id long, last_id long"


def packed_frame(ids: list[int | None], tokens: list[bytes]) -> bytes:
    n = len(ids)
    numbers = np.array([i or 0 for i in ids], dtype="<i8").tobytes()
    known = np.array([i is not None for i in ids], dtype="u1").tobytes()
    lengths = np.array([len(t) // 4 for t in tokens], dtype="<u4").tobytes()
    return struct.pack("<Q", n) + numbers + known + lengths + b"".join(tokens)


def unpacked_frame(content: bytes) -> tuple[list[int | None], np.ndarray, bytes]:
    """Document ids, numbers of tokens, and all tokens."""
    (n,) = struct.unpack_from("<Q", content)
    numbers = np.frombuffer(content, "<i8", n, 8)
    known = np.frombuffer(content, "u1", n, 8 + 8 * n)
    lengths = np.frombuffer(content, "<u4", n, 8 + 9 * n)
    return [int(i) if k else None for i, k in zip(numbers, known)], lengths, content[8 + 13 * n :]


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The trailing frame for (compressed size, decompressed size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, decompressed size, checksum) of each frame of an open file, from its end alone."""
    end = file.size()
    file.seek(end - 9)
    count, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or descriptor != 0x80:
        raise ValueError("no seek table with checksums at the end of the file")
    file.seek(end - 9 - 12 * count)
    sizes = [struct.unpack_from("<III", entries, 12 * k) for entries in [file.read(12 * count)] for k in range(count)]
    starts = np.cumsum([0, *(s[0] for s in sizes)])
    return [(int(a), *s) for a, s in zip(starts, sizes)]


def read_frame(file, offset: int, size: int, checksum: int) -> bytes:
    file.seek(offset)
    content = zstandard.ZstdDecompressor().decompress(file.read(size))
    if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
        raise ValueError(f"a frame at {offset} does not have its checksum")
    return content


def write_frames(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, tokenizer: str = TOKENIZER, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Writes all documents in ascending id order to files below `folder`, a URI, and returns the manifest, which is a table there."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is no integer")
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, encode = task.partitionId(), encoder(tokenizer).ids
        uri = f"{folder}/frames/{part:06d}-{task.taskAttemptId()}.zst"
        file, rows, at = None, [], 0
        ids: list[int | None] = []
        tokens: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal at, ids, tokens, size
            content = packed_frame(ids, tokens)
            frame = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(content)
            file.write(frame)
            rows.append((part, len(rows), uri, at, len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF, len(ids), size, ids[0], ids[-1]))
            at, ids, tokens, size = at + len(frame), [], [], 0

        for batch in chunks(batches):
            if file is None:
                system, path = pa.fs.FileSystem.from_uri(uri)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                file = system.open_output_stream(path, compression=None)
            data, start = buffers(batch.column("text"))
            data = data.tobytes()
            for k, doc in enumerate(batch.column("id").to_pylist()):
                ids.append(doc)
                tokens.append(encode(data[start[k] : start[k + 1]]) + last)
                size += len(tokens[-1]) // 4
                if size >= frame_tokens:
                    flush()
        if file is not None:
            if ids:
                flush()
            file.write(seek_table([(r[4], r[5], r[6]) for r in rows]))
            file.close()
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), f"{folder}/manifest")


class Files:
    """Opens one file after the other, and reads its seek table once."""

    def __init__(self):
        self.path, self.file, self.table = None, None, []

    def frame(self, path: str, number: int) -> bytes:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            system, inner = pa.fs.FileSystem.from_uri(path)
            self.path, self.file = path, system.open_input_file(inner)
            self.table = read_seek_table(self.file)
        offset, size, _, checksum = self.table[number]
        return read_frame(self.file, offset, size, checksum)


def read_documents(manifest: DataFrame) -> DataFrame:
    """(part, frame, place, id, n_tokens, tokens): each document of the frames listed, tokens as bytes (u32); `manifest` may be filtered
    to the frames that are wanted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths, tokens = unpacked_frame(files.frame(row["path"], row["frame"]))
                n = len(ids)
                at = np.append(0, np.cumsum(lengths.astype(np.int64) * 4)).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int64()), pa.array([row["frame"]] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(lengths.astype(np.int64)), texts], names=["part", "frame", "place", "id", "n_tokens", "tokens"])

    tasks = -(-manifest.count() // FRAMES_A_TASK)
    dealt = manifest.select("part", "frame", "path").repartitionByRange(max(tasks, 1), "part", "frame").sortWithinPartitions("part", "frame")
    return dealt.mapInArrow(run, "part long, frame int, place int, id long, n_tokens long, tokens binary")


def read_wanted(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, tokens) of the documents whose ids are wanted; of each file only the seek table and the frames that may hold one are read.
    Files follow one another by id, so an id's file is found among their first ids (a row for each task that wrote)."""
    files = manifest.groupBy("part", "path").agg(F.min("first_id").alias("first"), F.max("last_id").alias("last"), F.array_sort(F.collect_list(F.struct("frame", "first_id", "last_id"))).alias("frames"))
    ends = sorted((r["last"], r["part"]) for r in files.where("last IS NOT NULL").select("last", "part").collect())
    last = [e[0] for e in ends]

    @F.arrow_udf("long")
    def part_of(ids: pa.Array) -> pa.Array:
        place = np.searchsorted(last, ids.to_numpy())
        return pa.array([ends[p][1] if p < len(ends) else None for p in place.tolist()], pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Files()
        for batch in batches:
            for row in batch.to_pylist():
                asked = np.unique(row["ids"])
                for frame in row["frames"]:
                    if frame["last_id"] is None or np.searchsorted(asked, frame["last_id"], "right") == np.searchsorted(asked, frame["first_id"] if frame["first_id"] is not None else asked[0]):
                        continue
                    ids, lengths, tokens = unpacked_frame(opened.frame(row["path"], frame["frame"]))
                    at = np.append(0, np.cumsum(lengths.astype(np.int64) * 4))
                    own = [k for k, i in enumerate(ids) if i is not None and asked[min(np.searchsorted(asked, i), len(asked) - 1)] == i]
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in own], pa.int64()), pa.array([int(lengths[k]) for k in own], pa.int64()), pa.array([tokens[at[k] : at[k + 1]] for k in own], pa.binary())], names=["id", "n_tokens", "tokens"])

    own = wanted.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    asked = own.select("id", part_of("id").alias("part")).groupBy("part").agg(F.collect_list("id").alias("ids"))
    return asked.join(files.select("part", "path", "frames"), "part").select("path", "frames", "ids").mapInArrow(run, "id long, n_tokens long, tokens binary")


def starts(manifest: DataFrame) -> DataFrame:
    """(part, frame, before): the ids in all frames before.  Sums of files (one for each task that wrote) are added up in one
    place, frames within their file."""
    files = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    earlier = F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(earlier, F.lit(0)).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.select("part", "frame", F.coalesce(inside, F.lit(0)).alias("inside")).join(files, "part").select("part", "frame", (F.col("base") + F.col("inside")).alias("before"))


def op10_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_frames(table(spark, sf_dir, "documents"), shared_dir(spark))
    docs = read_documents(manifest).select("part", "frame", "place", "id", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
    earlier = F.sum("n_tokens").over(Window.partitionBy("part", "frame").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    # Spark takes what is read from the files to be as small as the manifest, and would broadcast it
    placed = docs.withColumn("inside", F.coalesce(earlier, F.lit(0))).join(starts(manifest).hint("merge"), ["part", "frame"])
    return placed.select(F.col("id").alias("doc_id"), (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
