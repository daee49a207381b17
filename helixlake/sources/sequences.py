"""FASTA and FASTQ, plain or gzip, as a Spark data source.

Plain files are read in byte ranges, each from the first record that begins in it.  So are files of block gzip, by the headers of their members: a record belongs to the range that
the member with its first byte begins in, and its offset is that member's place times 2 ** 16, and the place in it.  Any other gzip file is one range.  Files are reached by
Arrow's file systems, so any store that those know works.  A record whose quality is cut short or as long as no
sequence is marked corrupt, and reading goes on with the next header.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import numbered

SCHEMA = "source_file string, offset long, name string, comment string, seq string, qual string, corrupt boolean"
SPLIT_BYTES = 64 << 20
ROWS = 4096
#: A line of a sequence: letters, gaps and stops.
BASES = re.compile(r"[A-Za-z.*-]*")


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int | None, blocks: bool = False):
        self.uri, self.start, self.end, self.blocks = uri, start, end, blocks


#: The fixed first bytes of a member of block gzip: magic, deflate, an extra field; and the extra field that has the member's size, at the 12th byte.
MEMBER, MEMBER_SIZE, MEMBER_HEADER, MOST_MEMBER = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 18, 1 << 16


def _member(raw, at: int) -> int:
    """The bytes of a member of block gzip that begins there, 0 if none does."""
    raw.seek(at)
    head = raw.read(MEMBER_HEADER)
    ok = len(head) == MEMBER_HEADER and head[:4] == MEMBER and head[12:16] == MEMBER_SIZE
    return int.from_bytes(head[16:18], "little") + 1 if ok else 0


class Members(io.RawIOBase):
    """The text of members of block gzip, from the last one before a byte of the file on."""

    def __init__(self, raw, start: int, end: int, size: int):
        self.raw, self.size, self.at = raw, size, 0
        #: Where members begin in the file and in the text; the text's length is the next one's.
        self.places, self.texts = [self._first(start)], [0]
        while self.places[-1] < start and self._more():
            pass
        self.own = len(self.places) - 1 if self.places[-1] >= start else len(self.places)
        if self.own:
            # what precedes the member before isn't needed
            self.places, self.texts = self.places[self.own - 1 :], [t - self.texts[self.own - 1] for t in self.texts[self.own - 1 :]]
            self.own = min(1, len(self.places))
        while self.places[-1] < end and self._more():
            pass
        self.start = self.texts[self.own] if self.own < len(self.texts) else self.texts[-1]
        self.end = self.texts[next((i for i, p in enumerate(self.places) if p >= end), len(self.places) - 1)]
        self.held, self.text = -1, b""

    def _first(self, start: int) -> int:
        """The first member that begins in the two greatest members' length before a byte: one that is followed by another, or by the end."""
        low = max(0, start - 2 * MOST_MEMBER)
        self.raw.seek(low)
        near = self.raw.read(min(self.size, start + 2 * MOST_MEMBER) - low)
        at = near.find(MEMBER)
        while at >= 0:
            n = _member(self.raw, low + at)
            if n and (low + at + n == self.size or _member(self.raw, low + at + n)):
                return low + at
            at = near.find(MEMBER, at + 1)
        return self.size

    def _more(self) -> bool:
        """Finds where the next member begins, or the end of the file."""
        at = self.places[-1]
        n = _member(self.raw, at) if at < self.size else 0
        if not n:
            return False
        self.raw.seek(at + n - 4)
        self.places.append(at + n)
        self.texts.append(self.texts[-1] + int.from_bytes(self.raw.read(4), "little"))
        return True

    def offset(self, at: int) -> int:
        """The virtual offset of a place in the text."""
        k = bisect_right(self.texts, at) - 1
        return (self.places[k] << 16) + at - self.texts[k]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        self.at = to + (self.at if whence == io.SEEK_CUR else 0)
        return self.at

    def readinto(self, out) -> int:
        while self.texts[-1] <= self.at and self._more():
            pass
        if self.texts[-1] <= self.at:
            return 0
        k = bisect_right(self.texts, self.at) - 1
        if k != self.held:
            self.raw.seek(self.places[k])
            self.held, self.text = k, zlib.decompress(self.raw.read(self.places[k + 1] - self.places[k]), wbits=31)
        part = self.text[self.at - self.texts[k] :][: len(out)]
        out[: len(part)] = part
        self.at += len(part)
        return len(part)


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of a file, or of all files in a folder."""
    system, inner = pa.fs.FileSystem.from_uri(path)
    scheme = path.split(":", 1)[0] + "://" if ":" in path.split("/", 1)[0] else ""
    info = system.get_file_info(inner)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pa.fs.FileSelector(inner, recursive=True)) if info.type == pa.fs.FileType.Directory else [info]
    found = [f for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [(scheme + f.path if scheme else f.path, f.size) for f in sorted(found, key=lambda f: f.path)]


class Lines:
    """Lines of a stream with the byte each begins at, one of which can be put back."""

    def __init__(self, stream: io.BufferedIOBase, at: int):
        self.stream, self.at, self.held = stream, at, None

    def next(self) -> tuple[int, str] | None:
        if self.held is not None:
            line, self.held = self.held, None
            return line
        raw = self.stream.readline()
        if not raw:
            return None
        out = self.at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
        self.at += len(raw)
        return out

    def seek(self, at: int) -> None:
        self.stream.seek(at)
        self.at, self.held = at, None


def _record(lines: Lines) -> tuple | None:
    """(offset, name, comment, seq, qual, corrupt) of the next record: from the next header line on."""
    while (line := lines.next()) is not None and line[1][:1] not in (">", "@"):
        pass
    if line is None:
        return None
    offset, header = line
    name, _, comment = header[1:].replace("\t", " ").partition(" ")
    seq: list[str] = []
    quality: list[str] | None = None
    while (line := lines.next()) is not None:
        text = line[1]
        if text[:1] == "+" and header[0] == "@":
            quality, size, have = [], sum(map(len, seq)), 0
            while have < size and (line := lines.next()) is not None:
                quality.append(line[1])
                have += len(line[1])
            break
        if text[:1] in (">", "@"):
            lines.held = line
            break
        seq.append(text.strip())
    bases = "".join(seq)
    qual = None if quality is None else "".join(quality)
    corrupt = header[0] == "@" and (qual is None or len(qual) != len(bases))
    return offset, name, comment.strip() or None, bases, qual, corrupt


def _kind(stream: io.BufferedIOBase) -> bytes:
    """The first byte of the file's first header: > or @."""
    while (line := stream.readline()) and line[:1] not in (b">", b"@"):
        pass
    return line[:1]


def _is_record(lines: Lines, strict: bool) -> bool:
    """Whether a whole FASTQ record comes next: header, lines of bases, +, quality of the same length, and another header or the end.
    strict: what stands behind + begins the header's text too."""
    header = lines.next()[1]
    size = 0
    while (line := lines.next()) is not None and line[1][:1] != "+":
        if not BASES.fullmatch(line[1].strip()):
            return False
        size += len(line[1].strip())
    if line is None or strict and not header[1:].startswith(line[1][1:].strip()):
        return False
    have = 0
    while have < size and (line := lines.next()) is not None:
        have += len(line[1])
    while (line := lines.next()) is not None and not line[1].strip():
        pass
    return have == size and (line is None or line[1][:1] == "@")


def _synced(lines: Lines, start: int, end: int | None, kind: bytes) -> None:
    """Moves to the first record at or after a byte that may be inside of one.  A quality line may begin with @, > or + as well."""
    if start == 0:
        return
    lines.next()  # what is left of the line before
    first = lines.at
    for strict in (True, False):
        lines.seek(first)
        while (line := lines.next()) is not None and line[0] < end:
            if line[1][:1].encode() != kind:
                continue
            after = lines.at
            lines.seek(line[0])
            if kind == b">" or _is_record(lines, strict):
                lines.seek(line[0])
                return
            lines.seek(after)
    lines.seek(end)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for uri, size in _files(self.path):
            if uri.endswith(".gz"):
                system, path = pa.fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as raw:
                    blocks = bool(_member(raw, 0))
                out += [Range(uri, at, min(at + self.split, size), True) for at in range(0, size, self.split)] if blocks else [Range(uri, 0, None)]
            else:
                out += [Range(uri, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        system, path = pa.fs.FileSystem.from_uri(part.uri)
        with system.open_input_file(path) as raw:
            start, end, offset = part.start, part.end, int
            if part.blocks:
                members = Members(raw, part.start, part.end, raw.size())
                start, end, offset = members.start if part.start else 0, members.end, members.offset
                if start >= end:
                    return
                kind = _kind(io.BufferedReader(Members(raw, 0, 1, raw.size()))) if start else b""
                stream = io.BufferedReader(members, 1 << 16)
            else:
                stream = io.BufferedReader(raw, 1 << 20)
                stream = gzip.open(stream) if part.end is None else stream
                kind = _kind(stream) if start else b""
            back = max(start - 1, 0)
            if start:
                stream.seek(back)
            lines = Lines(stream, back)
            _synced(lines, start, end, kind)
            rows = []
            while (record := _record(lines)) is not None and (end is None or record[0] < end):
                rows.append((part.uri, offset(record[0]), *record[1:]))
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.bool_()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class Sequences(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def scan_sequences(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SCHEMA of a FASTA or FASTQ file, or a folder of them; each file is either.  Multi-line sequences and qualities, blank lines and line ends of
    both kinds are read; text before the first header is left out."""
    spark.dataSource.register(Sequences)
    return spark.read.format("sequences").option("splitBytes", split_bytes).load(path)


def as_strands(records: DataFrame) -> DataFrame:
    """(strand_id, name, seq): numbered from 0 by file and place.  For designed strands; reads need no numbers."""
    rows = records.select("source_file", "offset", F.floor(F.col("offset") / SPLIT_BYTES).alias("block"), "name", "seq")
    return numbered(rows, ["source_file", "block"], "offset", "strand_id").select("strand_id", "name", "seq")


def as_reads(records: DataFrame) -> DataFrame:
    return records.where(~F.col("corrupt")).select(F.concat_ws(":", "source_file", "offset").alias("read_id"), "seq")


def subsample(records: DataFrame, n: int, index: str = "strand_id") -> DataFrame:
    """Every n-th record by its number."""
    return records.where(F.col(index) % n == 0)
