"""Substring dedup: windows of words that start in an earlier document too, found behind a count-min sketch.

First pass: each task sketches the windows of its documents.  A window is counted by its minimizer, the least hash among the
word grams in it; equal windows have equal minimizers, so a minimizer's count is never less than the count of a window
that it stands for, while neighbouring windows share one and only about one gram in eighteen is counted.  The tasks'
sketches are merged segment by segment; what is kept is one bit for each cell, set where the count is two or more.  Its size follows the size of the texts.  Up to
`BROADCAST_BITS` (32 MB) it is broadcast; a larger one stays where it was merged, and the minimizers are sent to its segments instead.
Second pass: windows whose minimizer is counted twice in both
rows of the sketch are grouped exactly by 96 bits of hash, in buckets of even size, whose number follows the size of the texts: tasks exchange lists of different hashes with the least id of each, which buckets
add up to the least ids of what is in more than one document; then lists of hashes, ids and places are held against those, one after the other,
so that a passage that is everywhere takes no more memory than another.  The sketch loses no repeated window; where it is too full, more windows are grouped in vain, and the result
stays the same.

Cases: null and empty texts have no words; texts of fewer words than a window lose none; rows that repeat a document id
don't remove each other's words, but get those of smaller ids removed alike; a row with a null id neither loses words nor makes others lose
them; ids are of any type that has an order; empty tables give empty results; other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written
from .words import PLAIN, Words, chunks, mixed, split_words

WINDOW = 50
#: Words of the grams that stand for windows.
GRAM = 16
#: Cells of a row of the sketch that is broadcast, at most, and of any, as powers of two.
BROADCAST_BITS, MOST_BITS = 27, 40
#: Cells for each minimizer that texts of so many bytes have, about.
ROOM, BYTES_A_MINIMIZER = 4, 100
#: Buckets for each of Spark's shuffle partitions at least, and stretches of repeated windows up to which they are broadcast.
BUCKETS, FEW_STRETCHES = 4, 1 << 21
#: Windows of a bucket that are held before equal ones are added up, and different windows of a bucket at most.
HELD = 1 << 21
#: Cells of a segment of the sketch, as a power of two.
SEGMENT_BITS = 17
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of all runs of words of a given length, by differences of prefix sums."""

    def __init__(self, words: np.ndarray, base: int):
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _powers(base, len(words)), out=self.sums[1:], dtype=np.uint64)
        self.inverse = _powers(pow(base, -1, 1 << 64), len(words))

    def runs(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` values in a row."""
    out, have = values, 1
    while have * 2 <= size:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = size - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def windows(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its text's number, the word it starts at in that, two hashes, and its minimizer."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    one, two = words.hashes()
    first, second = Rolling(one, BASES[0]), Rolling(two, BASES[1])
    gram = min(gram, window)
    least = _sliding_min(mixed(first.runs(gram)), window - gram + 1)
    doc = words.doc_of()[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= words.first[doc + 1])
    doc = doc[at]
    return doc, at - words.first[doc], mixed(first.runs(window)[at]), mixed(second.runs(window)[at]), least[at]


def _cells(minimizers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each minimizer in both rows of the sketch."""
    mask = np.uint64((1 << bits) - 1)
    return minimizers & mask, mixed(minimizers) & mask


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def sketch_bits(size: int) -> int:
    """Bits of the sketch of texts of so many bytes."""
    return min(max((ROOM * size // BYTES_A_MINIMIZER).bit_length(), SEGMENT_BITS), MOST_BITS)


def bucket_bits(size: int, least: int) -> int:
    """Bits of buckets, `least` buckets or more: as many as leave none with more than HELD different windows of texts of so many bytes.  A window begins with a word and a
    blank, two bytes at least; windows are dealt out by their hash, so that buckets are even."""
    return max(1, (max(least, size // 2 // HELD) - 1).bit_length())


def cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes fall into, and where each of those begins, with the end; the work follows the hashes, not the buckets."""
    own = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[starts], np.append(starts, len(own))


def _of_documents(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, minimizer): the different minimizers of each text of a chunk."""
    doc, _, _, _, least = windows(split_words(texts, PLAIN), window, gram)
    order = np.lexsort((least, doc))
    doc, least = doc[order], least[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    return doc[new], least[new]


def sketch(texts: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(segment, bits): the merged sketch of all texts, a bit for each cell, set where its count is two or more; segments of the second row are negative."""
    segment_bits = min(SEGMENT_BITS, bits)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each 32 MB of text or so, capped at two, as lists of cells by segment: twice where counted twice."""

        def out(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for row, cells in enumerate(_cells(np.concatenate(seen), bits)):
                cells = np.sort(cells)
                keep = np.ones(len(cells), dtype=bool)
                keep[2:] = cells[2:] != cells[:-2]
                cells = cells[keep]
                segments = (cells >> np.uint64(segment_bits)).astype(np.int64)
                start = np.flatnonzero(np.append(True, segments[1:] != segments[:-1])) if len(cells) else np.zeros(0, np.int64)
                ends = np.append(start, len(cells)).astype(np.int32) * 4
                inside = (cells & np.uint64((1 << segment_bits) - 1)).astype(np.uint32).tobytes()
                lists = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(inside)])
                yield pa.RecordBatch.from_arrays([pa.array(_segment(segments[start], row)), lists], names=["segment", "cells"])

        seen, size = [], 0
        for batch in chunks(batches):
            # a minimizer counts once for each document
            seen.append(_of_documents(batch.column("text"), window, gram)[1])
            size += len(seen[-1])
            if size > 2_000_000:
                yield from out(seen)
                seen, size = [], 0
        if seen:
            yield from out(seen)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for segment, cells in zip(batch.column("segment").to_pylist(), batch.column("cells")):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, counts = segment, np.zeros(1 << segment_bits, dtype=np.uint8)
                found = np.bincount(np.frombuffer(cells.as_buffer(), np.uint32), minlength=1 << segment_bits)
                counts = np.minimum(counts + np.minimum(found, 2), 2).astype(np.uint8)
        if now is not None:
            yield done()

    counted = texts.select("text").mapInArrow(count, "segment long, cells binary").repartition("segment").sortWithinPartitions("segment")
    return counted.mapInArrow(merge, "segment long, bits binary")


def _segment(number: np.ndarray, row: int) -> np.ndarray:
    return -1 - number if row else number


def _set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def gathered(merged: DataFrame, bits: int) -> list[np.ndarray]:
    """Both rows of a sketch of at most BROADCAST_BITS, a fixed size whatever the input."""
    rows = [np.zeros(max(1 << bits >> 3, 1), dtype=np.uint8) for _ in range(2)]
    size = (1 << min(SEGMENT_BITS, bits)) >> 3
    for segment, found in merged.toLocalIterator():
        at = (segment if segment >= 0 else -1 - segment) * size
        rows[segment < 0][at : at + size] = np.frombuffer(found, np.uint8)
    return rows


def repeated_minimizers(texts: DataFrame, merged: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(id, minimizers): for each row of texts that has any, those that are set in both rows of a sketch, in lists of longs.  Minimizers go to their segment
    of the first row, and what is set there to that of the second: lists for each document and segment, no text."""
    kind = texts.schema["id"].dataType.simpleString()
    segment_bits = min(SEGMENT_BITS, bits)
    low = np.uint64((1 << segment_bits) - 1)

    def by_segment(ids: pa.Array, owner: np.ndarray, least: np.ndarray, row: int) -> pa.RecordBatch:
        segment = _segment((_cells(least, bits)[row] >> np.uint64(segment_bits)).astype(np.int64), row)
        order = np.lexsort((owner, segment))
        owner, least, segment = owner[order], least[order], segment[order]
        start = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(owner)).astype(np.int32)), pa.array(least.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(segment[start]), ids.take(pa.array(owner[start])), lists], names=["segment", "id", "minimizers"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield by_segment(batch.column("id"), *_of_documents(batch.column("text"), window, gram), 0)

    def held(row: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = None
            for batch in batches:
                out_owner, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i, kind_ in enumerate(batch.column("asks").to_pylist()):
                    if not kind_:
                        cells = np.frombuffer(batch.column("bits")[i].as_buffer(), np.uint8)
                        continue
                    least = batch.column("minimizers")[i].values.to_numpy().view(np.uint64)
                    least = least[_set(cells, _cells(least, bits)[row] & low)]
                    out_owner.append(np.full(len(least), i))
                    out.append(least)
                yield by_segment(batch.column("id"), np.concatenate(out_owner), np.concatenate(out), 1)

        return run

    schema = f"segment long, id {kind}, minimizers array<bigint>"
    rows = texts.mapInArrow(ask, schema)
    for row in (0, 1):
        # a segment of the sketch comes before what is asked of it; where it has none, nothing is repeated
        both = merged.select("segment", F.lit(0).alias("asks"), "bits").unionByName(rows.join(merged.select("segment"), "segment", "left_semi").withColumn("asks", F.lit(1)), allowMissingColumns=True)
        rows = both.repartition("segment").sortWithinPartitions("segment", "asks").mapInArrow(held(row), schema)
    return rows.groupBy("id").agg(F.flatten(F.collect_list("minimizers")).alias("minimizers"))


def _ranks(ids: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different ids, which of them each is, and the place of each of them in their order."""
    coded = ids.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), rank


def _least(one: np.ndarray, two: np.ndarray, ids: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Sorted different hashes with the least id of each, and the sum of n."""
    if not len(one):
        return one, two, ids, n
    _, code, rank = _ranks(ids)
    order = np.lexsort((rank[code], two, one))
    one, two = one[order], two[order]
    start = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    return one[start], two[start], ids.take(pa.array(order[start])), np.add.reduceat(n[order], start)


def _binaries(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _listed(row: tuple, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[2].column(column)[row[3]].as_buffer(), kind)


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(bucket, rows): rows are (bucket, asks, batch, place in the batch)."""
    rows = ((bucket, asks, batch, i) for batch in batches for i, (bucket, asks) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("asks").to_pylist())))
    return groupby(rows, key=lambda r: r[0])


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """(id, starts, ends): for each document that has any, the stretches of words in windows that start in a document with a smaller id too."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(texts)
    bits = bits or sketch_bits(size)
    kind = docs.schema[id_col].dataType.simpleString()
    dealt_bits = bucket_bits(size, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = sketch(texts, window, gram, bits)
    if bits <= BROADCAST_BITS:
        shared = spark.sparkContext.broadcast(gathered(merged, bits))
        twice = lambda batch, doc, least: _set(shared.value[0], _cells(least, bits)[0]) & _set(shared.value[1], _cells(least, bits)[1])
    else:
        named = repeated_minimizers(texts, written(merged), window, gram, bits)
        texts = texts.join(named, "id").select("id", "text", "minimizers")

        def twice(batch: pa.RecordBatch, doc: np.ndarray, least: np.ndarray) -> np.ndarray:
            known = batch.column("minimizers")
            owner = np.repeat(np.arange(len(known)), np.diff(known.offsets.to_numpy()))
            pairs = np.unique(np.rec.fromarrays([owner.astype(np.int64), known.flatten().to_numpy()]))
            return np.isin(np.rec.fromarrays([doc.astype(np.int64), least.view(np.int64)]), pairs)

    def lists(batches: Iterable[pa.RecordBatch], asks: int) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            doc, at, one, two, least = windows(split_words(batch.column("text"), PLAIN), window, gram)
            k = np.flatnonzero(twice(batch, doc, least))
            one, two, at, ids = one[k], two[k].astype(np.uint32), at[k].astype(np.int32), batch.column("id").take(pa.array(doc[k]))
            if asks:
                order = np.argsort(one, kind="stable")
                one, two, at, ids = one[order], two[order], at[order], ids.take(pa.array(order))
            else:
                # a window counts once for each document
                order = np.lexsort((doc[k], two, one))
                new = np.ones(len(k), dtype=bool)
                new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (doc[k[order[1:]]] != doc[k[order[:-1]]])
                order = order[new]
                one, two, ids, at = _least(one[order], two[order], ids.take(pa.array(order)), np.ones(len(order), np.int32))
            full, starts = cuts(one, dealt_bits)
            own = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), asks, np.int32)), _binaries(starts, one), _binaries(starts, two), own, _binaries(starts, at.astype(np.int32))], names=["bucket", "asks", "h1", "h2", "ids", "at"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least ids of windows in two documents or more, of each bucket."""
        for bucket, rows in _by_bucket(batches):
            parts, size, sums = [], 0, None
            for row in chain(rows, [None]):
                if row is not None:
                    parts.append((_listed(row, "h1", np.uint64), _listed(row, "h2", np.uint32), row[2].column("ids")[row[3]].values, _listed(row, "at", np.int32)))
                    size += len(parts[-1][0])
                if row is None or size > HELD:
                    one, two, ids, n = zip(*parts)
                    sums = _least(np.concatenate(one), np.concatenate(two), pa.concat_arrays(ids), np.concatenate(n))
                    parts, size = [sums], 0
            k = np.flatnonzero(sums[3] > 1)
            if len(k):
                ends = np.array([0, len(k)])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), _binaries(ends, sums[0][k]), _binaries(ends, sums[1][k]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), sums[2].take(pa.array(k))), pa.nulls(1, pa.binary())], names=["bucket", "asks", "h1", "h2", "ids", "at"])

    def later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of windows whose least id is a smaller one."""
        for _, rows in _by_bucket(batches):
            known = None
            for row in rows:
                one, two, ids = _listed(row, "h1", np.uint64), _listed(row, "h2", np.uint32), row[2].column("ids")[row[3]].values
                if not row[1]:
                    known = one, two, ids
                    continue
                if known is None:
                    continue
                place = np.searchsorted(known[0], one)
                while True:
                    # equal first hashes with other second ones stand side by side
                    at = np.minimum(place, len(known[0]) - 1)
                    other = (known[0][at] == one) & (known[1][at] < two) & (place < len(known[0]))
                    if not other.any():
                        break
                    place = place + other
                k = np.flatnonzero((known[0][at] == one) & (known[1][at] == two))
                k = k[pc.greater(ids.take(pa.array(k)), known[2].take(pa.array(at[k]))).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(_listed(row, "at", np.int32)[k])], names=["id", "at"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of words that the windows cover."""
        for batch in batches:
            lists = batch.column("at")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy()
            order = np.lexsort((at, owner))
            owner, at = owner[order], at[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + window)
            last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
            offsets = pa.array(np.searchsorted(owner[new], np.arange(len(lists) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at[new], at[last] + window))], names=["id", "starts", "ends"])

    schema = f"bucket int, asks int, h1 binary, h2 binary, ids array<{kind}>, at binary"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n, "bucket").sortWithinPartitions("bucket", "asks")
    least = written(dealt(texts.mapInArrow(lambda batches: lists(batches, 0), schema)).mapInArrow(added, schema))
    asked = texts.mapInArrow(lambda batches: lists(batches, 1), schema)
    found = dealt(least.unionByName(asked)).mapInArrow(later, f"id {kind}, at int").groupBy("id").agg(F.collect_list("at").alias("at"))
    return found.mapInArrow(joined, f"id {kind}, starts array<int>, ends array<int>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """For each row of docs: (id_col, text, n_words, n_removed): the words that stay, joined by one space, and how many there were
    and how many went.  bits: of the sketch, where its size should not follow the texts."""
    marks = written(repeated_windows(docs, id_col, text_col, window, gram, bits))
    few = marks.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0] <= FEW_STRETCHES
    marks = F.broadcast(marks) if few else marks.hint("merge")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = split_words(batch.column("text"), PLAIN)
            joined, start, end = words.joined()
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            for doc, (starts, ends) in enumerate(zip(batch.column("starts"), batch.column("ends"))):
                if starts.is_valid:
                    gone[starts.values.to_numpy() + words.first[doc]] += 1
                    gone[ends.values.to_numpy() + words.first[doc]] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            removed = np.add.reduceat(np.append(~kept, False).astype(np.int64), words.first[:-1]) * (words.per_doc > 0)
            texts = []
            for doc in range(batch.num_rows):
                a, b = words.first[doc], words.first[doc + 1]
                if removed[doc] == 0:
                    texts.append(joined[start[a] : end[b - 1]] if b > a else b"")
                else:
                    own = kept[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    texts.append(b" ".join(joined[start[a + x] : end[a + y - 1]] for x, y in zip(edge[::2], edge[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words.per_doc.astype(np.int64)), pa.array(removed)], names=["id", "text", "n_words", "n_removed"])

    out = texts.join(marks, "id", "left").mapInArrow(cut, f"id {kind}, text string, n_words long, n_removed long")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
win AS (SELECT doc_id, r, s, md5(array_to_string(w[s : s + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s FROM doc WHERE len(w) >= {WINDOW})),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(generate_series(s, s + {WINDOW - 1})) AS p FROM win JOIN least USING (g) WHERE doc_id > m)),
word AS (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM doc WHERE len(w) > 0),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
