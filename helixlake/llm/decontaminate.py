"""Benchmark decontamination with a distributed positional inverted index.

`build_index` cuts the corpus into shards of whole documents and stores, for each shard and term, the sorted positions of the
term on the shard's axis of words (documents are one position apart, so no phrase crosses them), as differences of one, two or four bytes.
Building needs no shuffle: a frequent term has one bounded list in each shard.  The test items get the same index; the two are joined by
term, with the term's frequency in the whole corpus, and each pair of a corpus shard and a block of items is searched in one task
of bounded size: each window is looked up by its rarest term's list, whose positions are moved by the offsets of the other terms and
held against their lists, from the rarest on, for all windows at once.  Windows with a term that the corpus lacks are not looked up.

Cases: null and empty texts have no words and are never hit; an item of fewer words than a window is one window; items
without words have none; rows that repeat an item id count as one item; a null item id counts as the empty string;
repeated documents give a row each, and so do null ids; empty tables give no hits; other columns of the inputs are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import beside, dropped, settled, table, text_key, without, written
from .words import ALNUM_LOWER, chunks, split_words

WINDOW = 10
#: Text bytes of a shard: terms that are in many documents have one list for all of them.
SHARD_BYTES = 4 << 20
#: A proximity match has every term of a window within this many words of an occurrence of its rarest term.
NEAR = 15
#: The list of the documents' first positions is stored as if it were a term; words are never empty.
STARTS = ""
#: Pairs of a window and a position of its rarest term that a task holds at once.
PAIRS_AT_ONCE = 1 << 20
#: Lists of test items that are broadcast; more are joined by a shuffle.
FEW_LISTS = 1 << 16


def coded_lists(at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Sorted lists of positions as bytes: the first in four, then differences in as few as the list's greatest needs.  ends: where each list
    ends; none is empty."""
    size = np.diff(ends, prepend=0)
    starts = ends - size
    step = np.diff(at, prepend=0).astype(np.int64)
    step[starts] = 0
    most = np.maximum.reduceat(step, starts) if len(starts) else step
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    offset = np.append(0, np.cumsum(4 + (size - 1) * width))
    out = np.zeros(offset[-1], dtype=np.uint8)
    out[offset[:-1, None] + np.arange(4)] = at[starts].astype("<i4").view(np.uint8).reshape(-1, 4)
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(at)) - starts[owner]
    for w in (1, 2, 4):
        k = np.flatnonzero((width[owner] == w) & (inside > 0))
        place = offset[owner[k]] + 4 + (inside[k] - 1) * w
        out[place[:, None] + np.arange(w)] = step[k].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(out)])


def decoded_list(data: bytes, n: int) -> np.ndarray:
    first = np.frombuffer(data, "<i4", 1)
    if n == 1:
        return first.astype(np.int64)
    step = np.frombuffer(data, f"<u{(len(data) - 4) // (n - 1)}", n - 1, 4)
    return np.cumsum(np.concatenate([first, step]), dtype=np.int64)


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (shard, term, n, at): the number of positions of each term in each shard, and those; and for each document a row without term
    (shard, ordinal, start, words, id): its number in the shard, the position of its first word, its number of words, and its id."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard long, term string, n int, at binary, ordinal int, start int, words int, id {kind}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in schema.split(", ", 7)]
        for batch in chunks(batches, most=SHARD_BYTES):
            words = split_words(batch.column("text"), ALNUM_LOWER)
            ids, terms = words.ids()
            docs_n = batch.num_rows
            starts = (words.first[:-1] + np.arange(docs_n)).astype(np.int32)
            at = (np.arange(len(words)) + words.doc_of()).astype(np.int32)
            order = np.argsort(ids, kind="stable")
            ends = np.append(np.cumsum(np.bincount(ids, minlength=len(terms))), len(ids) + docs_n).astype(np.int64)
            lists = coded_lists(np.concatenate([at[order], starts]), ends)
            n = len(lists)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), batch.column("id").type)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([*terms, STARTS.encode()], pa.binary()).cast(pa.string()), pa.array(np.diff(ends, prepend=0).astype(np.int32)), lists, *none], names=names)
            own = [pa.array(x.astype(np.int32)) for x in (np.arange(docs_n), starts, words.per_doc)]
            none = [pa.nulls(docs_n, t) for t in (pa.string(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(docs_n, shard)), *none, *own, batch.column("id")], names=names)
            shard += 1

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


def _windows(starts: np.ndarray, words: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first positions, items) of all windows, by size: a shorter item is one window."""
    sizes = np.minimum(words, window)
    for size in np.unique(sizes[sizes > 0]).tolist():
        items = np.flatnonzero(sizes == size)
        many = words[items] - size + 1
        first = np.repeat(starts[items] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        yield size, first, np.repeat(items, many)


class Shard:
    """The lists of a shard's terms, for lookups of many positions at once."""

    def __init__(self, lists: list[np.ndarray], starts: np.ndarray):
        self.size = np.array([len(x) for x in lists])
        self.first = np.append(0, np.cumsum(self.size))
        self.at = np.concatenate(lists)
        self.keys = np.repeat(np.arange(len(lists)), self.size) << 32 | self.at
        self.term = np.full(int(self.at.max()) + 1, -1, dtype=np.int32)
        self.term[self.at] = np.repeat(np.arange(len(lists)), self.size)
        self.starts = starts
        self.ends = np.append(starts[1:] - 1, np.iinfo(np.int32).max)

    def positions(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each of the terms, one list after the other, and which of the terms each is of."""
        many = self.size[terms]
        of = np.repeat(np.arange(len(terms)), many)
        return self.at[np.arange(len(of)) + np.repeat(self.first[terms] - np.append(0, np.cumsum(many)[:-1]), many)], of

    def has(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        ok = (at >= 0) & (at < len(self.term))
        return ok & (self.term[np.where(ok, at, 0)] == terms)

    def has_between(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.keys, terms.astype(np.int64) << 32 | low)
        return (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] <= (terms.astype(np.int64) << 32 | high))

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _found(shard: Shard, terms: np.ndarray, rarity: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur, and where each begins; windows whose terms are close, and where the rarest is.  terms: of each window, a row;
    rarity: of all terms in the corpus."""
    order = np.argsort(rarity[terms], axis=1, kind="stable")
    lead = order[:, 0]
    at, of = shard.positions(terms[np.arange(len(terms)), lead])
    begin, exact = at - lead[of], np.arange(len(at))
    doc = shard.doc(at)
    low, high, loose = np.maximum(at - near, shard.starts[doc]), np.minimum(at + near, shard.ends[doc] - 1), np.arange(len(at))
    for k in range(1, terms.shape[1]):
        for_exact, for_loose = of[exact], of[loose]
        exact = exact[shard.has(terms[for_exact, order[for_exact, k]], begin[exact] + order[for_exact, k])]
        loose = loose[shard.has_between(terms[for_loose, order[for_loose, k]], low[loose], high[loose])]
    return of[exact], begin[exact], of[loose], at[loose]


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """(shard, doc, block, item, kind, start, end): occurrences of windows of the items.  kind phrase: the words from start
    to end (exclusive, counted in the document) are covered by exact windows of the item; kind near: all terms of a window
    are within `near` words of its rarest one, which is at start.  items: an index too; item is an ordinal in its block."""
    lists = lambda side: side.where(F.col("term").isNotNull())
    asked = lists(items).select("term", F.col("shard").alias("block"), F.col("n").alias("item_n"), F.col("at").alias("item_at"))
    terms = written(asked.select("term").distinct())
    common = written(lists(index).select("term", "n").join(beside(terms), "term").groupBy("term").agg(F.sum("n").alias("frequency")))
    asked = written(asked.join(common, "term"))
    # an item's words as they follow from the next one's start, the last one's from its block's end
    block_end = items.where(F.col("term").isNull()).groupBy(F.col("shard").alias("block")).agg(F.max(F.col("start") + F.col("words")).alias("item_end"))
    asked = written(asked.join(block_end, "block"))
    joined = lists(index).select("shard", "term", "n", "at").join(beside(asked, FEW_LISTS), "term")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        names = group.column("term").to_pylist()
        unpacked = lambda n, at: [decoded_list(x.as_buffer(), m) for x, m in zip(group.column(at).combine_chunks(), group.column(n).to_pylist())]
        at, item_at = unpacked("n", "at"), unpacked("item_n", "item_at")
        none = names.index(STARTS)
        starts, item_starts = at.pop(none), item_at.pop(none)
        rarity = np.delete(group.column("frequency").to_numpy(), none)
        end = group.column("item_end")[0].as_py()
        kinds: dict[str, list] = {c: [] for c in ("doc", "item", "kind", "start", "end")}

        def put(item: np.ndarray, kind: str, start: np.ndarray, end: np.ndarray) -> None:
            doc = shard.doc(start)
            for c, v in (("doc", doc), ("item", item), ("start", start - starts[doc]), ("end", end - starts[doc])):
                kinds[c].append(v)
            kinds["kind"].append(np.full(len(doc), kind))

        if at:
            shard = Shard(at, starts)
            term_of = np.full(end + 1, -1, dtype=np.int64)
            for k, places in enumerate(item_at):
                term_of[places] = k
            for size, first, item in _windows(item_starts, np.append(item_starts[1:] - 1, end) - item_starts, window):
                own = term_of[first[:, None] + np.arange(size)]
                there = (own >= 0).all(axis=1)
                own, item = own[there], item[there]
                if not len(own):
                    continue
                lead = np.take_along_axis(own, rarity[own].argmin(axis=1)[:, None], axis=1)[:, 0]
                part = np.cumsum(shard.size[lead]) // PAIRS_AT_ONCE
                exact, loose = [], []
                for p in np.unique(part):
                    k = np.flatnonzero(part == p)
                    of, begin, close, middle = _found(shard, own[k], rarity, near)
                    exact.append((item[k][of], begin))
                    loose.append((item[k][close], middle))
                which, begin = (np.concatenate(x) for x in zip(*exact))
                if len(which):
                    both = np.unique(np.stack([which, begin], axis=1), axis=0)
                    new = np.append(True, (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] > both[:-1, 1] + size))
                    ends = both[np.append(np.flatnonzero(new)[1:] - 1, len(both) - 1), 1] + size
                    put(both[new, 0], "phrase", both[new, 1], ends)
                which, middle = (np.concatenate(x) for x in zip(*loose))
                if len(which):
                    both = np.unique(np.stack([which, middle], axis=1), axis=0)
                    put(both[:, 0], "near", both[:, 1], both[:, 1] + 1)
        out = {c: np.concatenate(v) if v else [] for c, v in kinds.items()}
        n = len(out["doc"])
        types = {"doc": pa.int32(), "item": pa.int32(), "kind": pa.string(), "start": pa.int32(), "end": pa.int32()}
        return pa.table({"shard": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([key[1].as_py()] * n, pa.int64())} | {c: pa.array(out[c], t) for c, t in types.items()})

    return joined.groupBy("shard", "block").applyInArrow(run, "shard long, block long, doc int, item int, kind string, start int, end int")


@settled
def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """For each row of docs: (id_col, n_words, n_hit, item_ids, near_ids): words, words inside exact windows of items, ids of the
    items (strings) with exact windows, and of those with a proximity match."""
    index = written(build_index(docs, id_col, text_col))
    tests = written(build_index(items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")), "id", "text"))
    own = lambda side: side.where(F.col("term").isNull()).select("shard", "ordinal", "words", "id")
    names = own(tests).select(F.col("shard").alias("block"), F.col("ordinal").alias("item"), F.coalesce("id", F.lit("")).alias("item_id"))
    found = written(search(index, tests, window, near).join(names, ["block", "item"]))
    at_doc = Window.partitionBy("shard", "doc").orderBy("start", "end")
    before = F.max("end").over(at_doc.rowsBetween(Window.unboundedPreceding, -1))
    phrase = found.where("kind = 'phrase'").select("shard", "doc", "start", "end").distinct()
    covered = phrase.select("shard", "doc", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("new"))
    covered = covered.groupBy("shard", "doc").agg(F.sum("new").alias("n_hit"))
    by_kind = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item_id"))))
    sets = found.select("shard", "doc", "kind", "item_id").distinct().groupBy("shard", "doc").agg(by_kind("phrase").alias("item_ids"), by_kind("near").alias("near_ids"))
    hits = written(sets.join(covered, ["shard", "doc"], "left").withColumnRenamed("doc", "ordinal"))
    none = F.array().cast("array<string>")
    return own(index).join(beside(hits), ["shard", "ordinal"], "left").select(
        F.col("id").alias(id_col),
        F.col("words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("near_ids", none).alias("near_ids"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that no window of an item occurs in, as they are.  They are told by their text, so ids may be null or repeated."""
    key = text_key(F.col(text_col).cast("string"))
    texts = docs.select(F.struct(key[0].alias("a"), key[1].alias("b")).alias("key"), F.col(text_col).alias("text"))
    found = contamination(texts, items, "key", "text", item_id, item_text, window)
    gone = written(found.where("n_hit > 0").select("key.a", "key.b").distinct())
    dropped(found)
    return without(docs, gone, key)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
gram AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS size, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, row_number() OVER () AS r, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
span AS (
  SELECT r, size, s, array_to_string(w[s : s + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM doc, (SELECT DISTINCT size FROM gram) WHERE len(w) >= size)),
hit AS (SELECT r, s, span.size AS size, item_id FROM span JOIN gram USING (size, g)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN ids USING (r)
"""
