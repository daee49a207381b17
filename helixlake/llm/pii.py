"""Personal data: fixed patterns, and more identifiers by bootstrapped contexts.  DataFrame functions only.

Base spans are matches of four patterns.  They are the seeds of a bootstrapping over all texts.  Whatever looks like an identifier (five digits or
more, in groups or within a token) is an instance, and its surroundings are lexical patterns: the word in front, the two words in front,
the words in front and behind, and the word in front with the instance's make (digits, letters and digits, or an address).  In each round, instances that are known induce patterns,
and patterns score instances on the graph between both:
a pattern's score is the sum of its known instances' scores over all occurrences of its words in the corpus (for two words, of the rarer one), and it is
trusted from `CONFIDENCE` on with `SUPPORT` different known instances; an instance's score is the chance that one of its trusted patterns is
right, taken as independent, and it is known from `CONFIDENCE` on, under the kind of its best pattern.  What a round adds induces more patterns in the next, until a round
adds nothing.  All occurrences of known instances are spans.

The patterns start at the first character of a run only and never step back in it, which gives the same leftmost matches in linear time and
without deep recursion on long runs.

Cases: a null text counts as an empty one and has no spans; repeated rows are counted each, and have the same spans; null ids are
kept; empty tables give empty results; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import beside, dropped, settled, table, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_TOKEN = "A-Za-z0-9._%+@-"
#: Groups of digits with blanks, brackets and signs between, or a token with a digit.
CANDIDATE = rf"(?<![{_TOKEN}])(?:[+(]?+[0-9]++(?:[\x20().\-/]{{1,2}}[0-9]++)++(?![{_TOKEN}])|(?=[{_TOKEN}]*?[0-9])[{_TOKEN}]++)"
CANDIDATE_DIGITS = 5
CANDIDATE_SIGN = rf"[0-9](?:[\x20()/{_TOKEN}]*?[0-9]){{{CANDIDATE_DIGITS - 1}}}"
#: The last two words of a text that is turned round, and the first word of one as it is.  Both begin at the start, so a long word is read once.
CONTEXT, BEHIND = r"^\P{L}*+(\p{L}++)(?:\P{L}++(\p{L}++))?", r"^\P{L}*+(\p{L}++)"
SUPPORT, CONFIDENCE = 3, 0.5
#: Rounds after which bootstrapping ends, if what is known still changes then; decimals of a score that count.
MOST_ROUNDS, DECIMALS = 64, 9
#: Lengths that are summed at once: sums of longer runs are built of those of blocks.
SUM_BLOCK = 64

_SPAN = "struct<start:int,end:int,value:string,one:string,two:string,behind:string>"


def _let(value: Column, use) -> Column:
    """use(value), where the value is computed once, even if a lambda function in it names it."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """For each of an array of ints the sum of those before it."""

    def of(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(SUM_BLOCK))
        blocks = F.transform(starts, lambda s: _sum(F.slice(x, s, F.lit(SUM_BLOCK))))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(blocks, none, lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])
        return _let(before, lambda b: F.transform(x, lambda _, i: b[F.floor(i / SUM_BLOCK).cast("int")] + _sum(F.slice(x, i - i % SUM_BLOCK + 1, i % SUM_BLOCK))))

    return _let(values, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<int>")))


def _words_at_ends(gap: Column) -> Column:
    """The last word of a text, the last but one, and the first, empty where it has none."""
    word = lambda turned, k: F.reverse(F.regexp_extract(turned, CONTEXT, k))
    return _let(F.reverse(gap), lambda t: F.struct(word(t, 1).alias("one"), word(t, 2).alias("two"), F.regexp_extract(gap, BEHIND, 1).alias("first")))


def _matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as an array of spans with the last two words in front of each (of the two gaps before it) and the first one behind."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def spans(m: Column) -> Column:
        n = F.size(m["hits"])
        pairs = F.arrays_zip(m["hits"].alias("hit"), F.slice(m["gaps"], 1, n).alias("gap"))
        starts = prefix_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])))
        placed = F.zip_with(pairs, starts, lambda p, at: F.struct(p["hit"], (at + F.length(p["gap"])).alias("start")))

        def span(p: Column, w: Column) -> Column:
            own, earlier = w["own"], w["earlier"]
            one = F.when(own["one"] != "", own["one"]).otherwise(earlier["one"])
            two = F.when(own["one"] == "", earlier["two"]).when(own["two"] == "", earlier["one"]).otherwise(own["two"])
            return F.struct(p["start"].alias("start"), (p["start"] + F.length(p["hit"])).alias("end"), p["hit"].alias("value"), one.alias("one"), two.alias("two"), w["next"]["first"].alias("behind"))

        def with_words(words: Column) -> Column:
            none = F.struct(F.lit("").alias("one"), F.lit("").alias("two"), F.lit("").alias("first"))
            around = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(words[i - 1].alias("own"), F.when(i > 1, words[F.greatest(i - 2, F.lit(0))]).otherwise(none).alias("earlier"), words[i].alias("next")))
            return F.zip_with(placed, around, span)

        return F.when(n > 0, _let(F.transform(m["gaps"], _words_at_ends), with_words)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return _let(found, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right but one, sum to a multiple of ten."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4  # noqa: E731  leading zeros don't count
        return F.forall(F.split(value, r"\."), lambda p: F.when(part(p), F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind; null for texts that have none of its signs."""
    has = F.contains(text, F.lit(SIGNS[kind])) if kind == "email" else F.rlike(text, F.lit(SIGNS[kind]))
    return F.when(has, F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])))


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page, email, ip, card, phone, other): each row's id, a hash of its text, its base spans, and candidates that overlap none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    none = F.array().cast(f"array<{_SPAN}>")
    filled = {k: F.coalesce(k, none) for k in KINDS}
    found = F.when(F.rlike("text", F.lit(CANDIDATE_SIGN)), _matches(F.col("text"), CANDIDATE))
    shorter = lambda s: F.regexp_replace(s["value"], "[._%+-]+$", "")  # noqa: E731  a full stop ends a sentence
    found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(shorter(s))).alias("end"), shorter(s).alias("value"), s["one"].alias("one"), s["two"].alias("two"), s["behind"].alias("behind")))
    enough = F.filter(found, lambda s: F.length(_digits(s["value"])) >= CANDIDATE_DIGITS)
    taken = F.transform(F.concat(*filled.values()), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    free = _let(taken, lambda t: F.filter(enough, lambda s: ~F.exists(t, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    free = F.when(F.size(enough) > 0, free)
    return rows.select("id", F.xxhash64("text").alias("page"), *(c.alias(k) for k, c in filled.items()), F.coalesce(free, none).alias("other"))


def contexts(found: DataFrame) -> DataFrame:
    """(value, seed, pattern, words, n): the graph, an edge for each instance and lexical pattern, with the times that they meet; seed: the kind, if it is a
    base span; words: the pattern's.  found: what mentions() returns."""

    def under(seed: Column, column: str) -> Column:
        return F.transform(column, lambda s: F.struct(seed.alias("seed"), s["value"].alias("value"), s["one"].alias("one"), s["two"].alias("two"), s["behind"].alias("behind")))

    spans = F.concat(*(under(F.lit(k), k) for k in KINDS), under(F.lit(None).cast("string"), "other"))
    rows = found.select(F.explode(spans).alias("s")).select("s.seed", F.lower("s.value").alias("value"), *(F.lower(f"s.{c}").alias(c) for c in ("two", "one", "behind"))).where("one <> ''")
    make = F.when(F.contains("value", F.lit("@")), "address").when(F.rlike("value", F.lit("[a-z]")), "mixed").otherwise("digits")
    of = lambda name, pattern, *words: F.struct(F.concat_ws(" ", F.lit(name), *pattern).alias("pattern"), F.array(*words).alias("words"))
    one, two, behind = F.col("one"), F.col("two"), F.col("behind")
    patterns = F.array(of("front", [one], one), F.when(two != "", of("two", [two, one], two, one)), F.when(behind != "", of("around", [one, behind], one, behind)), of("make", [one, make], one))
    edges = rows.select("seed", "value", F.explode(F.array_compact(patterns)).alias("p"))
    return edges.groupBy("value", "seed", "p.pattern", "p.words").agg(F.count("*").alias("n"))


def word_counts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(word, total): occurrences in all texts of each of the lower-cased words that are wanted (word), a written table."""
    words = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"\p{L}+"), F.lit(0)))
    return docs.select(words.alias("word")).select(F.lower("word").alias("word")).join(beside(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))


def bootstrapped(graph: DataFrame, totals: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, list[int]]:
    """(value, kind, score) of the instances that are known besides the seeds, and how many there were after each round.  graph: contexts(); totals: (pattern, total).

    Each round is three aggregations with partial sums: of patterns, and of instances, which are joined to the graph from written tables."""
    edges = written(graph.join(totals, "pattern").select("value", "seed", "pattern", "n", "total"))
    seeds = edges.where("seed IS NOT NULL").groupBy("value").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = written(seeds)
    open_ = written(edges.where("seed IS NULL").join(beside(seeds), "value", "left_anti"))
    known, sizes = written(seeds.limit(0)), []
    while True:
        both = seeds.unionByName(known)
        by_kind = edges.select("value", "pattern", "n", "total").join(beside(written(both)), "value").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("values"), F.sum(F.col("n") * F.col("score")).alias("weight"), F.max("total").alias("total"))
        trusted = by_kind.groupBy("pattern").agg(F.sum("values").alias("values"), F.least(F.lit(1.0), F.sum("weight") / F.max("total")).alias("score"), F.max_by("kind", F.struct("values", "kind")).alias("kind"))
        trusted = written(trusted.where((F.col("values") >= support) & (F.round("score", DECIMALS) >= confidence)).select("pattern", "kind", F.col("score").alias("by")))
        wrong = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("by")))))
        scored = open_.select("value", "pattern").distinct().join(beside(trusted), "pattern").groupBy("value").agg(F.max_by("kind", F.struct("by", "kind")).alias("kind"), (1 - wrong).alias("score"))
        now = written(scored.where(F.round("score", DECIMALS) >= confidence))
        sizes.append(now.count())
        same = sizes[-2:] == sizes[-1:] * 2 and now.join(known.select("value", "kind"), ["value", "kind"], "left_anti").isEmpty()
        dropped(known, trusted)
        known = now
        if same or not sizes[-1] or len(sizes) == MOST_ROUNDS:
            return known, sizes


@settled
def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """For each row: (id_col, email, ip, card, phone, added): arrays of spans (start, end, value); added ones have a kind too."""
    found = written(mentions(docs, id_col, text_col))
    graph = written(contexts(found))
    words = written(graph.select(F.explode("words").alias("word")).distinct())
    totals = written(word_counts(docs, text_col, words))
    own = graph.select("pattern", F.explode("words").alias("word")).distinct().join(beside(totals), "word")
    known, _ = bootstrapped(graph, written(own.groupBy("pattern").agg(F.min("total").alias("total"))), support, confidence)
    candidates = found.where(F.size("other") > 0).select("id", "page", F.explode("other").alias("s"))
    new = candidates.join(beside(known.select(F.col("value").alias("v"), "kind")), F.lower("s.value") == F.col("v"))
    new = new.select("id", "page", F.struct("kind", "s.start", "s.end", "s.value").alias("s")).distinct()
    new = written(new.groupBy("id", "page").agg(F.array_sort(F.collect_list("s")).alias("added")).select(F.col("id").alias("i"), F.col("page").alias("p"), "added"))
    out = found.join(beside(new), found["id"].eqNullSafe(F.col("i")) & (found["page"] == F.col("p")), "left")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    plain = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return out.select(F.col("id").alias(id_col), *(plain(k).alias(k) for k in KINDS), F.coalesce("added", empty).alias("added"))


def _place(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"))


def _of_kind(kind: str) -> Column:
    return F.filter("added", lambda span: span["kind"] == kind)


def _listed(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind as listed, then by start."""

    def named(kind: str, column: Column) -> Column:
        return F.transform(F.array_sort(column), lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))

    return F.array_join(F.concat(*(named(k, F.transform(s, _place)) for k, s in spans.items())), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    everything = {k: F.concat(F.transform(k, _place), F.transform(_of_kind(k), _place)) for k in KINDS}
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed({k: F.col(k) for k in KINDS}), 256).alias("base_sha256"),
        _listed(everything).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        sum((F.size(c) for c in everything.values()), F.lit(0)).cast("long").alias("n_spans"),
    )
