"""Token counts that follow edits: trees of counts over segments of each text, re-encoded only where an edit touches them.

A text is cut after blanks into segments of about `SEGMENT` characters; where tokens never span blanks, a text's count is the sum of its
segments'.  With a tokenizer of which that is not known, a text is one segment, which any edit has encoded again.  The counts are the leaves of a binary tree of sums.  Edits replace ranges of the old text: the segments they touch,
with the following one where the blank between them goes, are put into the first one's place and encoded again, and the sums
on the way to the root are changed; all other segments are neither read nor encoded.

Cases: null and empty texts have one empty segment; edits of a text must not overlap (ValueError), and are cut to its length; an edit without text
deletes; repeated rows have a tree each; rows with a null id take part like others (as one id); empty tables give empty results; other columns
of the input are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written
from .tokens import TOKENIZER, encoder
from .words import chunks

#: Characters after which a segment ends with the next blank.
SEGMENT = 256
BLANK = re.compile("[ \n]")
TREE = "ends array<int>, sums array<int>"


def cut(text: str, segment: int | None = SEGMENT) -> list[int]:
    """Where segments end; without a size of segments, at the text's end alone."""
    ends, at = [], 0
    while segment and len(text) - at > segment:
        m = BLANK.search(text, at + segment - 1)
        if m is None:
            break
        at = m.end()
        ends.append(at)
    if at < len(text) or not ends:
        ends.append(len(text))
    return ends


def tree(counts: list[int]) -> list[int]:
    """Sums in heap order: the root at 1, leaves in the second half."""
    size = 1 << max(len(counts) - 1, 0).bit_length()
    sums = [0] * size + counts + [0] * (size - len(counts))
    for k in range(size - 1, 0, -1):
        sums[k] = sums[2 * k] + sums[2 * k + 1]
    return sums


def edited(text: str, ends: list[int], sums: list[int], edits: list[tuple[int, int, str]], count) -> tuple[list[int], list[int], int]:
    """The tree after edits (start, end, new text), with the ends in the new text, and the number of characters encoded.  count: of tokens
    in a text."""
    edits = sorted((min(s, len(text)), min(max(s, e), len(text)), new) for s, e, new in edits)
    if any(b[0] < a[1] for a, b in zip(edits, edits[1:])):
        raise ValueError("edits of one text overlap")
    sums, leaves = list(sums), len(sums) // 2
    starts, new_sizes = [0, *ends[:-1]], [b - a for a, b in zip([0, *ends[:-1]], ends)]
    encoded, k, leaf = 0, 0, 0
    while k < len(edits):
        while leaf + 1 < len(ends) and ends[leaf] <= edits[k][0]:
            leaf += 1
        first, last, at, parts = leaf, leaf, starts[leaf], []
        while True:
            # all edits that begin in these segments
            while k < len(edits) and (edits[k][0] < ends[last] or last + 1 == len(ends)):
                start, end, new = edits[k]
                parts += [text[at:start], new]
                at, k = end, k + 1
                while last + 1 < len(ends) and ends[last] < at:
                    last += 1
            joined = "".join(parts) + text[at : ends[last]]
            # context: without a blank at its end the last word goes on in the next segment
            if last + 1 == len(ends) or joined == "" or joined[-1] in " \n":
                break
            last += 1
        for j in range(first, last + 1):
            own = count(joined) if j == first else 0
            new_sizes[j] = len(joined) if j == first else 0
            change, node = own - sums[leaves + j], leaves + j
            while node:
                sums[node] += change
                node //= 2
        encoded += len(joined)
        leaf = last
    total, new_ends = 0, []
    for n in new_sizes:
        total += n
        new_ends.append(total)
    return new_ends, sums, encoded


def count_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, page, ends, sums): each text's tree; page is a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in chunks(batches):
            ends, sums = [], []
            for text in batch.column("text").to_pylist():
                at = cut(text, SEGMENT if encode.safe else None)
                ends.append(at)
                sums.append(tree([len(encode.ids(text[a:b].encode())) // 4 for a, b in zip([0, *at], at)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("page"), pa.array(ends, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int32()))], names=["id", "page", "ends", "sums"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, page long, {TREE}")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("page"), text.alias("text"))


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, page, ends, sums, encoded): the trees of edited texts.  edits: (id, page, text, edits), the old text and an array of
    (start, end, new)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in chunks(batches):
            out = []
            for row in batch.to_pylist():
                changes = [(e["start"], e["end"], e["new"] or "") for e in row["edits"]]
                out.append(edited(row["text"], row["ends"], row["sums"], changes, lambda t: len(encode.ids(t.encode())) // 4))
            ends, sums, encoded = zip(*out)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("page"), *(pa.array(c, t) for c, t in zip((ends, sums, encoded), kinds))], names=["id", "page", "ends", "sums", "encoded"])

    kind = trees.schema["id"].dataType.simpleString()
    new = edits.select(F.col("id").alias("i"), F.col("page").alias("p"), "text", "edits").distinct()
    old = trees.dropDuplicates(["id", "page"])
    both = old.join(new, old["id"].eqNullSafe(F.col("i")) & (old["page"] == F.col("p")))
    return both.select("id", "page", "ends", "sums", "text", "edits").mapInArrow(run, f"id {kind}, page long, {TREE}, encoded long")


def number_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 4) -> DataFrame:
    """(id, page, text, edits): a feed of edits that put `[number]` for each run of at least so many digits; texts that have any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(f"[0-9]{{{digits},}}")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
        for batch in chunks(batches):
            found = [[{"start": m.start(), "end": m.end(), "new": "[number]"} for m in pattern.finditer(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=["id", "page", "text", "edits"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = _texts(docs, id_col, text_col).where(F.rlike("text", F.lit(f"[0-9]{{{digits}}}")))
    return texts.mapInArrow(run, f"id {kind}, page long, text string, edits array<struct<start:int,end:int,new:string>>")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and after its long numbers were masked: edits, tokens after them, characters encoded again."""
    docs = table(spark, sf_dir, "documents")
    trees = written(count_trees(docs))
    feed = number_edits(docs)
    after = apply_edits(trees, feed).select(F.col("id").alias("i"), F.col("page").alias("p"), F.col("sums")[1].alias("after"), "encoded", F.element_at("ends", -1).alias("chars"))
    counts = trees.select("id", "page", F.col("sums")[1].alias("before"), F.element_at("ends", -1).alias("old_chars"))
    out = counts.join(after, counts["id"].eqNullSafe(F.col("i")) & (counts["page"] == F.col("p")), "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("before").cast("long").alias("n_tokens"),
        F.coalesce("after", "before").cast("long").alias("n_tokens_after"),
        F.coalesce("chars", "old_chars").cast("long").alias("n_chars_after"),
        F.coalesce("encoded", F.lit(0)).cast("long").alias("n_chars_encoded"),
    )
