"""Queries on the graph of observed k-mers, for whole tables of queries at once.

A node is a k-mer with its coverage; neighbours are made by moving one base and looked up in a stored count table, of which only the buckets of those
k-mers are read, so no table of edges is needed.  Of a plain table of counts, or of reads, only what a walk can reach is counted (`store.near`); where very many walks begin, all is stored first.  Nodes are
followed in the orientation of the query; coverage is that of the canonical k-mer.  Walks are loops of at most six joins; each level is written to the shared folder, which keeps plans short and costs a
lost executor one level at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import canonical, checked_k, index_to_dna, left_pad_a, pack
from ..sources.scratch import unused, written
from .store import KmerTable, Nearby, Reads, near, stored

MAX_DEPTH, MAX_STARTS, MAX_BASE_LENGTH = 6, 32, 300
UP, DOWN = "up", "down"


def _looked_up(nodes: DataFrame, counts: KmerTable | Nearby | Reads, columns: dict[str, str]) -> DataFrame:
    """nodes with the coverage of k-mer columns, 0 where one is not counted.  columns: the name of each one's coverage.  All are looked up at once; nodes are read for their k-mers
    first and then for the counts, so they had better be a written table."""
    keys = {}
    for c in columns:
        keys[c] = unused([*nodes.columns, *columns.values(), *keys.values()], "key")
    keyed = nodes.withColumns({key: pack(canonical(F.col(c))) for c, key in keys.items()})
    found = counts.counts_of(keyed.select(F.explode(F.array(*keys.values())).alias("kmer")))
    for c, cov in columns.items():
        keyed = keyed.join(found.select(F.col("kmer").alias(keys[c]), F.col("cov").alias(cov)), keys[c], "left").withColumn(cov, F.coalesce(cov, F.lit(0)))
    return keyed.drop(*keys.values())


def _moved(kmer: Column, base: Column, k: int, direction: Column) -> Column:
    return F.when(direction == UP, F.concat(base, F.substring(kmer, 1, k - 1))).otherwise(F.concat(F.substring(kmer, 2, k - 1), base))


def clean_query(query: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(query, r"\s", ""))


def query_status(query: Column, k: int) -> Column:
    return F.when(F.length(query) < k, "shorter than k").when(F.rlike(query, F.lit("[^ACGT]")), "invalid base")


def neighbors(nodes: DataFrame, counts: DataFrame | KmerTable | Nearby | Reads, k: int) -> DataFrame:
    """nodes (with kmer and direction) with (base, neighbor, cov): all four on that side, absent ones with coverage 0."""
    four = F.explode(F.array(*(F.lit(b) for b in "ACGT")))
    made = nodes.withColumn("base", four).withColumn("neighbor", _moved(F.col("kmer"), F.col("base"), k, F.col("direction")))
    return _looked_up(made, near(nodes, counts, k, 1), {"neighbor": "cov"})


def anchors(queries: DataFrame, k: int) -> DataFrame:
    """Valid queries (query_id, query) as two nodes: the left anchor looks up, the right one down."""
    checked_k(k)
    own = queries.select("query_id", clean_query(F.col("query")).alias("query")).where(query_status(F.col("query"), k).isNull())
    two = F.explode(F.array(F.struct(F.lit(UP).alias("direction"), F.substring("query", 1, k).alias("kmer")), F.struct(F.lit(DOWN).alias("direction"), F.expr(f"right(query, {k})").alias("kmer"))))
    return own.select("query_id", two.alias("a")).select("query_id", "a.direction", "a.kmer")


def kmer_neighbors(queries: DataFrame, counts: DataFrame | KmerTable | Nearby | Reads, k: int) -> DataFrame:
    """(query_id, direction, base, neighbor, cov)."""
    return neighbors(written(anchors(queries, k)), counts, k).select("query_id", "direction", "base", "neighbor", "cov")


def kmer_query(queries: DataFrame, counts: DataFrame | KmerTable, k: int) -> DataFrame:
    """A row for each query: anchors, their canonical forms, coverage (the lesser of the two where they differ), degrees, whether the query is longer
    than k, and an error for those too short or invalid."""
    own = queries.select("query_id", clean_query(F.col("query")).alias("query")).withColumn("error", query_status(F.col("query"), k))
    valid = own.where("error IS NULL").select("query_id", F.substring("query", 1, k).alias("left"), F.expr(f"right(query, {k})").alias("right"), (F.length("query") > k).alias("truncated"))
    counts = near(anchors(queries, k), counts, k, 1)
    covered = _looked_up(written(valid), counts, {"left": "left_cov", "right": "right_cov"})
    degree = kmer_neighbors(queries, counts, k).groupBy("query_id").agg(F.count_if((F.col("direction") == UP) & (F.col("cov") > 0)).alias("in_degree"), F.count_if((F.col("direction") == DOWN) & (F.col("cov") > 0)).alias("out_degree"))
    found = covered.join(degree, "query_id").select("query_id", "left", "right", canonical(F.col("left")).alias("left_canonical"), canonical(F.col("right")).alias("right_canonical"), F.least("left_cov", "right_cov").alias("coverage"), "truncated", "in_degree", "out_degree")
    return own.select("query_id", "error").join(found, "query_id", "left")


def ranked_branches(found: DataFrame, by: list[str]) -> DataFrame:
    """Covered neighbours with rank: the most coverage first, then by base."""
    return found.where("cov > 0").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cov"), "base")))


def _walk(start: DataFrame, counts: DataFrame | KmerTable, k: int, depths: dict[str, int], first_step: int, best_only: bool) -> DataFrame:
    """Levels of covered neighbours.  start: query_id, direction, kmer; the path holds the bases taken so far."""
    depths = {side: max(0, min(MAX_DEPTH, depth)) for side, depth in depths.items()}
    level = written(start.withColumn("path", F.lit("")))
    counts = near(level, counts, k, max(1, *depths.values()))
    out = None
    for step in range(1, max(depths.values()) + 1):
        open_ = [side for side, depth in depths.items() if depth >= step]
        found = neighbors(level.where(F.col("direction").isin(open_)), counts, k)
        found = ranked_branches(found, ["query_id", "direction", "path"])
        if best_only:
            found = found.where("rank = 1")
        rows = found.select("query_id", "direction", F.lit(step + first_step).alias("step"), F.concat("path", "base").alias("path"), "base", F.col("neighbor").alias("kmer"), "cov", "rank")
        rows = written(rows)
        out = rows if out is None else out.unionByName(rows)
        level = rows.select("query_id", "direction", "kmer", "path")
    if out is None:
        empty = neighbors(level.limit(0), counts, k)
        return empty.select("query_id", "direction", F.lit(0).alias("step"), "path", "base", F.col("neighbor").alias("kmer"), "cov", F.lit(0).alias("rank"))
    return out


def branch_tree(queries: DataFrame, counts: DataFrame | KmerTable, k: int, up: int = 1, down: int | None = None) -> DataFrame:
    """(query_id, direction, step, path, base, kmer, cov, rank): covered neighbours of covered neighbours, up to six levels; a k-mer may come again."""
    return _walk(anchors(queries, k), counts, k, {UP: up, DOWN: up if down is None else down}, 0, False)


def expand_nodes(nodes: DataFrame, counts: DataFrame | KmerTable, k: int) -> DataFrame:
    """One more level of a tree's nodes (query_id, direction, step, path, kmer)."""
    found = ranked_branches(neighbors(nodes.select("query_id", "direction", "step", "path", "kmer"), counts, k), ["query_id", "direction", "path"])
    return found.select("query_id", "direction", (F.col("step") + 1).alias("step"), F.concat("path", "base").alias("path"), "base", F.col("neighbor").alias("kmer"), "cov", "rank")


def greedy_path(queries: DataFrame, counts: DataFrame | KmerTable, k: int, up: int = 6, down: int | None = None) -> DataFrame:
    """As branch_tree, with the best neighbour of each step only; a path ends where none is covered."""
    return _walk(anchors(queries, k), counts, k, {UP: up, DOWN: up if down is None else down}, 0, True)


def prefix_starts(prefixes: DataFrame, counts: DataFrame | KmerTable, k: int) -> DataFrame:
    """(query_id, kmer, cov, rank, limit_reached): covered k-mers that start with the query's prefix, in one of both orientations; the first 32
    by text.  The prefixes are searched for as ranges of packed k-mers, and the first of each are picked where the table is scanned."""
    short = prefixes.where(F.length("prefix") < k)
    counts = Reads(counts, k) if isinstance(counts, DataFrame) and "seq" in counts.columns else stored(counts, k)
    found = counts.starting_with(short.select("prefix"), MAX_STARTS)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("kmer"))).where(F.col("rank") <= MAX_STARTS)
    ranked = ranked.withColumn("limit_reached", F.count("*").over(Window.partitionBy("prefix")) >= MAX_STARTS)
    return short.select("query_id", "prefix").join(ranked, "prefix").select("query_id", "kmer", "cov", "rank", "limit_reached")


def prefix_matches(counts: DataFrame | KmerTable, prefix: str, k: int) -> DataFrame:
    """(kmer, cov): counted k-mers, in their canonical form, that start with one prefix, themselves or turned."""
    table = stored(counts, k)
    found = table.starting_with(table.spark.createDataFrame([(prefix,)], "prefix string"), None)
    return found.select(canonical(F.col("kmer")).alias("kmer"), "cov").distinct()


def index_decoded(queries: DataFrame, k: int, base_length: int | None = None, cut: bool = False) -> DataFrame:
    """(query_id, dna, encoded_length, padded, completed, truncated) of decimal indexes (query_id, index); null for what is none.  cut: of more bases than `base_length` the
    first are taken, so that all are of one length."""
    length = k if base_length is None else base_length
    if not 1 <= length <= MAX_BASE_LENGTH:
        raise ValueError(f"the base length must be from 1 to {MAX_BASE_LENGTH}")
    raw = queries.select("query_id", index_to_dna(F.col("index")).alias("raw"))
    dna = left_pad_a(F.col("raw"), length)
    dna = F.substring(dna, 1, length) if cut else dna
    return raw.select("query_id", dna.alias("dna"), F.length("raw").alias("encoded_length"), (F.length("raw") < length).alias("padded"), (F.length(dna) < k).alias("completed"), (F.length(dna) > k).alias("truncated"))


def index_query(queries: DataFrame, counts: DataFrame | KmerTable, k: int, base_length: int | None = None, depth: int = 1, cut: bool = False) -> DataFrame:
    """(query_id, start, direction, step, path, base, kmer, cov): greedy paths from the start k-mers of decimal indexes.  A decoded index of k bases or more is one
    start, with its first k-mer upwards and its last one downwards; a shorter one is completed by the covered k-mers that it begins.  Walks are of different decoded
    indexes, of which there may be far fewer than queries, and the queries are joined to what they found.  cut: see index_decoded()."""
    own = written(index_decoded(queries, k, base_length, cut).where("dna IS NOT NULL").select("query_id", "dna", "completed"))
    if isinstance(counts, DataFrame) and "seq" not in counts.columns:
        counts = stored(counts, k)
    different = own.groupBy("dna").agg(F.first("completed").alias("completed"))
    whole = different.where(~F.col("completed")).select("dna", F.lit(1).alias("start"), F.col("dna").alias("query"))
    begun = prefix_starts(different.where("completed").select(F.col("dna").alias("query_id"), F.col("dna").alias("prefix")), counts, k).select(F.col("query_id").alias("dna"), F.col("rank").alias("start"), F.col("kmer").alias("query"))
    starts = whole.unionByName(begun).select(F.struct("dna", "start").alias("query_id"), "query")
    walked = greedy_path(starts, counts, k, depth).select("query_id.dna", "query_id.start", "direction", "step", "path", "base", "kmer", "cov")
    return own.select("query_id", "dna").join(walked, "dna").drop("dna")
