"""Quality rules: statistics of each text, and a learned decision list over them.

Statistics are counted in Arrow batches for every text.  A decision list is learned on the driver from a bounded sample of
labels (`SAMPLE` of them, those of least hash of the id) by sequential covering: a rule, a conjunction of thresholds, is
grown on two thirds of the rows that no rule covers yet, pruned on the other third, and kept while it is precise there.
The list becomes one ordered conditional expression of Spark columns, evaluated for every row where the row lies: only the
labelled rows are joined to anything.

Cases: null and empty texts have no words and fail the base rules; ratios over nothing are zero; repeated rows count each; a null
id is judged by its text like any other; labels that are null or belong to no text are not used; without labels of both kinds there are no
learned rules; empty tables give empty results; other columns of the input are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .substrings import BASES, Rolling
from .tables import table, unused, written
from .words import PLAIN, chunks, mixed, split_words

#: Labelled rows that rules are learned from, at most.
SAMPLE = 20_000
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A rule must be right for this share of the pruning rows that it covers, and cover so many of all.
PRECISION, COVER = 0.9, 5
MAX_CONDITIONS, MAX_RULES, CUTS = 4, 16, 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")


def _classes() -> dict[str, np.ndarray]:
    byte = np.arange(256)
    marks = np.isin(byte, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
    return {
        "n_symbols": np.isin(byte, list(b"#*$%&|<>")),
        "n_upper": (byte >= 65) & (byte <= 90),
        "n_digits": (byte >= 48) & (byte <= 57),
        "n_marks": marks,
    }


def repeated_words(doc: np.ndarray, hashes: np.ndarray, first: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text: its words inside windows of words that it holds twice or more."""
    n = len(hashes)
    out = np.zeros(len(first) - 1, dtype=np.int64)
    if n < window:
        return out
    runs = Rolling(hashes, BASES[0]).runs(window)
    at = np.flatnonzero(np.arange(len(runs)) + window <= first[doc[: len(runs)] + 1])
    keys = mixed(runs[at] + doc[at].astype(np.uint64) * np.uint64(BASES[1]))
    order = np.argsort(keys)
    ordered = keys[order]
    same = (ordered[1:] == ordered[:-1]) & (doc[at[order[1:]]] == doc[at[order[:-1]]])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(out))


def _counted(texts: pa.Array) -> pa.StructArray:
    """COUNTS of each text of a chunk."""
    classes = _classes()
    codepoint = (np.arange(256) & 0xC0) != 0x80
    words = split_words(texts, PLAIN)
    hashes, _ = words.hashes()
    data, at = words.data, words.doc_at  # separators are zero there; a zero byte in a text is none of the classes

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[at[1:]] - sums[at[:-1]]

    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {c: total(flags[data] & in_word) for c, flags in classes.items()}
    out["n_words"] = words.per_doc.astype(np.int64)
    out["word_chars"] = total(codepoint[data] & in_word)
    out["n_repeat_words"] = repeated_words(words.doc_of(), hashes, words.first)
    lines, dups = [], []
    for text in texts.to_pylist():
        own = (text or "").split("\n")
        lines.append(len(own))
        with_word = [x for x in own if x.strip(" \t\n\r\x0b\x0c")] if len(own) > 1 else []
        dups.append(len(with_word) - len(set(with_word)))
    out["n_lines"], out["n_dup_lines"] = np.array(lines, dtype=np.int64), np.array(dups, dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(out[c]) for c in COUNTS], names=list(COUNTS))


def counted(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with one more column, a struct of COUNTS for each text, counted in Arrow batches.  Words are runs between
    blanks; word_chars, code points in words; n_symbols, signs of #*$%&|<>; n_dup_lines, lines with a word that equal an earlier one;
    n_repeat_words, words in 8-word windows found twice or more; n_marks, ASCII punctuation."""

    # columns go by their places: a name may hold a dot, or be there twice
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = plain.columns[docs.columns.index(text_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            counts = _counted(batch.column(text).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, "counts"])

    schema = StructType([*plain.schema.fields, StructField("counts", StructType([StructField(c, LongType()) for c in COUNTS]))])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, *COUNTS): counts for each row's whole text."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return counted(texts, "text", "counts").select(F.col("id").alias(id_col), "counts.*")


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in COUNTS}


def features(own: dict[str, Column] | None = None) -> dict[str, Column]:
    """What rules put thresholds on, from the counts (own: where those are)."""
    own = own or _columns()

    def ratio(a: str, b: str) -> Column:
        return F.when(own[b] > 0, own[a] / own[b]).otherwise(F.lit(0.0))

    return {
        "words": own["n_words"].cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols_per_char": ratio("n_symbols", "word_chars"),
        "upper_per_char": ratio("n_upper", "word_chars"),
        "digits_per_char": ratio("n_digits", "word_chars"),
        "marks_per_char": ratio("n_marks", "word_chars"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
    }


def base_failed(own: dict[str, Column] | None = None) -> Column:
    own = own or _columns()
    return (own["n_words"] < MIN_WORDS) | (100 * own["n_repeat_words"] > MAX_REPEAT_PERCENT * own["n_words"])


@dataclass
class DecisionList:
    """Ordered rules, each a list of (feature, is it `>=`, threshold); a row is rejected by the first that holds, else kept."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def column(self, own: dict[str, Column] | None = None) -> Column:
        """The verdict, an ordered conditional expression: false where a rule rejects, else true."""
        source, out = features(own), None
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & (source[name] >= F.lit(cut) if above else source[name] < F.lit(cut))
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{n} {'>=' if a else '<'} {c:.6g}" for n, a, c in rule) for rule in self.rules) + "\nelse keep"


def _holds(x: dict[str, np.ndarray], rule: list[tuple[str, bool, float]], n: int) -> np.ndarray:
    ok = np.ones(n, dtype=bool)
    for name, above, cut in rule:
        ok &= x[name] >= cut if above else x[name] < cut
    return ok


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, bool, float]]:
    """Adds the condition of the greatest gain in information until no good row is covered."""
    rule: list[tuple[str, bool, float]] = []
    now = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int((now & bad).sum()), int((now & ~bad).sum())
        if not n or not p:
            break
        best, found = 1e-9, None
        for name, values in x.items():
            own, own_bad = values[now], bad[now]
            order = np.argsort(own, kind="stable")
            own, own_bad = own[order], own_bad[order]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1]))
            edges = np.flatnonzero(np.diff(own_bad.astype(np.int8)) != 0)
            # besides quantiles, middles between rows of different labels, at evenly spaced places among them
            edges = edges[np.linspace(0, len(edges) - 1, min(len(edges), CUTS)).astype(int)] if len(edges) else edges
            cuts = np.unique(np.concatenate([cuts, (own[edges] + own[edges + 1]) / 2]))
            at = np.searchsorted(own, cuts)
            below_bad, below = np.append(0, np.cumsum(own_bad))[at], at
            for above in (True, False):
                tp = p - below_bad if above else below_bad
                all_ = len(own) - below if above else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((tp > 0) & (all_ < len(own)), tp * (np.log2(tp / all_) - np.log2(p / (p + n))), -1)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best:
                    best, found = gain[k], (name, above, float(cuts[k]))
        if found is None:
            break
        rule.append(found)
        now &= _holds({found[0]: x[found[0]]}, [found], len(bad))
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """Sequential covering of the bad rows.  Every third row prunes."""
    out = DecisionList()
    left = np.ones(len(bad), dtype=bool)
    prune_rows = np.arange(len(bad)) % 3 == 2
    while len(out.rules) < MAX_RULES and (left & bad & ~prune_rows).sum() >= COVER:
        grow, prune = left & ~prune_rows, left & prune_rows
        rule = _grow({c: v[grow] for c, v in x.items()}, bad[grow])
        if not rule:
            break

        def worth(r: list) -> float:
            covered = _holds(x, r, len(bad)) & prune
            p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _holds(x, rule, len(bad)) & left
        pruning = covered & prune_rows
        if covered.sum() < COVER or not pruning.any() or bad[pruning].mean() < PRECISION or bad[covered].mean() < PRECISION:
            break
        out.rules.append(rule)
        left &= ~covered
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """A decision list from the labelled rows (label 0: reject) that pass the base rules."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    # a bounded sample, of the documented size
    known = written(known.orderBy(F.xxhash64("id"), "id", "label").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = counted(rows, "text", "counts").select("id", "label", "counts.*").where(~base_failed())
    pdf = rows.select("id", "label", *(c.alias(n) for n, c in features().items())).orderBy(F.xxhash64("id"), "id", "label", *features()).limit(sample).toPandas()
    bad = (pdf["label"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return DecisionList()
    return learn_list({c: pdf[c].to_numpy(float) for c in features()}, bad)


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct of COUNTS, base_failed and kept.  One narrow pass: no row moves."""
    name = unused(docs.columns, "quality")
    counts = counted(docs, text_col, name)
    own = {c: F.col(f"`{name}`.{c}") for c in COUNTS}
    source = F.struct(*(c.alias(n) for n, c in own.items()))
    failed = base_failed(own)
    return counts.withColumn(name, source.withField("base_failed", failed).withField("kept", ~failed & rules.column(own))), name


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, *COUNTS, base_failed, kept)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out, name = judged(texts, learn(docs, labels, id_col, text_col))
    return out.select(F.col("id").alias(id_col), f"{name}.*")


def of_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, as they are."""
    out, name = judged(docs, learn(docs, labels, id_col, text_col), text_col)
    return out.where(F.col(f"`{name}`.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
