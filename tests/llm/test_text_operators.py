"""The text operators against brute force, with the cases that each docstring names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.llm import decontaminate, html_text, lines, pii, quality, substrings
from helixlake.llm import words as words_

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
ODD = ["", None, " \n\t", "one", "a\x00b c", "ünï côdé 😀 mark", "x" * 50_000]


def docs(spark, texts, ids=None):
    """Documents with a column that clashes with names the operators use inside."""
    data = [(ids[i] if ids else i, t, "s", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, id string").withColumnsRenamed({"id": "kept"})


# --- benchmark decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items, window=10):
    w = words(text)
    hit, ids = set(), set()
    for name, item in items:
        v = words(item)
        size = min(window, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1) if size else ():
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                ids.add(name)
    return len(w), len(hit), sorted(map(str, ids))


def test_contamination_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 16)))) for i in range(12)] + [(12, None), (3, "t1 t2"), (20, "ABC-def, 9"), (21, "Ünï")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(30)] + ODD + [f"see: abc DEF 9! {items[5][1]}", LONG, LONG]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), tests).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == hits(t, items), i
        assert set(got[i].item_ids) <= set(got[i].near_ids)


def test_proximity(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    shuffled = "kappa iota theta eta zeta epsilon delta gamma beta alpha"
    far = "alpha " + "x " * 40 + "beta gamma delta epsilon zeta eta theta iota kappa"
    got = decontaminate.contamination(docs(spark, [shuffled, far]), item).orderBy("doc_id").collect()
    assert [(r.n_hit, r.near_ids) for r in got] == [(0, ["1"]), (0, [])]


def test_lists_of_positions_round_trip():
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(top, n, replace=False)) for n, top in ((1, 9), (200, 201), (300, 60_000), (40, 10**9), (1, 2**31 - 1), (7, 2**31 - 1))]
    coded = decontaminate.coded_lists(np.concatenate(lists).astype(np.int32), np.cumsum([len(x) for x in lists]))
    assert [decontaminate.decoded_list(c.as_py(), len(x)).tolist() for c, x in zip(coded, lists)] == [x.tolist() for x in lists]
    assert len(coded[1].as_py()) == 4 + 199


def test_clean_documents_stay_as_they_are(spark):
    item = spark.createDataFrame([("1", "alpha beta gamma")], "item_id string, text string")
    df = docs(spark, ["x Alpha, beta gamma y", "alpha beta", None, "x alpha beta gamma"], [None, 1, None, 1]).withColumn("gone_0", F.lit(7))
    assert sorted(map(tuple, decontaminate.without_contaminated(df, item).collect()), key=repr) == [(1, "alpha beta", "s", "own", 7), (None, None, "s", "own", 7)]


def test_contamination_of_nothing(spark):
    item = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, ["a b"]), item).first().n_hit == 0
    assert decontaminate.contamination(docs(spark, []), item).count() == 0


# --- words


def test_hashes_tell_words_apart():
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab\x00é") for _ in range(n)) for n in (*range(1, 40), 1024, 1025, 5000, 5001)] + ["a" * n for n in range(1, 60)] + ["a\x00", "a\x00\x00"]
    texts = [t for t in dict.fromkeys(texts)]
    w = words_.split_words(pa.array([" ".join(texts), "ab", None, " ".join(reversed(texts))]), words_.PLAIN)
    for h in w.hashes():
        assert len(set(h[: len(texts)].tolist())) == len(texts)
        assert h[len(texts) + 1 :].tolist() == h[: len(texts)].tolist()[::-1]


# --- substring dedup


def without(texts, ids, window):
    all_words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    least = {}
    for w, i in zip(all_words, ids):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                least[g] = min(i, least.get(g, i))
    out = []
    for w, i in zip(all_words, ids):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "gram", "bits", "broadcast"), [(4, 2, 20, True), (6, 6, 8, True), (5, 3, None, True), (4, 2, 20, False), (6, 6, 8, False)])
def test_substrings_match_brute_force(spark, monkeypatch, window, gram, bits, broadcast):
    """With a sketch that is broadcast, or probed where it is; large, or so small that it is full."""
    if not broadcast:
        monkeypatch.setattr(substrings, "BROADCAST_BITS", 0)
        monkeypatch.setattr(substrings, "FEW_STRETCHES", 0)
        monkeypatch.setattr(substrings, "HELD", 5)
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(40)] + ODD + [LONG, LONG, LONG[5000:9000]]
    ids = [*range(len(texts) - 3), 500, 400, None]
    texts += ["a b c a b c a b", "a b c a b c a b"]
    ids += [700, 700]
    got = substrings.without_repeats(docs(spark, texts, ids), window=window, gram=gram, bits=bits)
    want = without(texts, ids, window)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "text").collect()), key=repr) == want


def test_substring_buckets_follow_the_texts():
    assert substrings.bucket_bits(0, 1) == 1 and substrings.bucket_bits(10_000, 32) == 5
    for size in (10**9, 10**12, 10**14):
        assert size / 2 / 2 ** substrings.bucket_bits(size, 32) <= substrings.HELD
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1))
    for some, bits in ((hashes, 3), (hashes, 24), (hashes[:0], 3)):
        own, starts = substrings.cuts(some, bits)
        assert np.repeat(own, np.diff(starts)).tolist() == [int(h) >> 64 - bits for h in some] and len(set(own.tolist())) == len(own)


def test_substrings_of_nothing(spark):
    assert substrings.without_repeats(docs(spark, [])).count() == 0


# --- line dedup


def test_lines(spark):
    data = [(i, f"own {i}\nfooter\n\nown {i}", "h") for i in range(8)] + [(8, None, "h"), (9, "", "h"), (10, "footer", None), (11, "footer", "small"), (12, "footer", "h"), (12, "footer", "h")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("lines_dropped", F.lit("mine"))
    got = lines.without_boilerplate(df, ratio=0.5, min_pages=3)
    assert got.columns == ["doc_id", "text", "source", "lines_dropped", "_lines_dropped"]
    out = [(r.doc_id, r.text, list(r["_lines_dropped"])) for r in got.orderBy("doc_id").collect()]
    assert out[0] == (0, "own 0\n\nown 0", [4, 1])
    assert out[8] == (8, None, [0, 0]) and out[9] == (9, "", [1, 0])
    assert out[10] == (10, "footer", [1, 0]) and out[11] == (11, "footer", [1, 0])
    assert out[12] == out[13] == (12, "", [1, 1])
    assert lines.without_boilerplate(df.limit(0)).count() == 0


def test_lines_keep_columns_of_any_name(spark, monkeypatch):
    data = [(i, f"own {i}\nfooter", "h", i, "a", "b", "c") for i in range(8)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, drop int, Host string, kept string, __kept string")
    for few in (1 << 20, 0):
        monkeypatch.setattr(lines, "FEW_ROWS", few)
        got = lines.without_boilerplate(df, ratio=0.5, min_pages=3).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == [(i, f"own {i}", "h", i, "a", "b", "c", [2, 1]) for i in range(8)]


def test_copies_make_boilerplate_unless_they_count_once(spark):
    data = [(i, "the same\ntext again", "h") for i in range(50)] + [(100 + i, f"other {i}", "h") for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = lambda **options: lines.without_boilerplate(df, ratio=0.3, min_pages=2, **options).where("text = 'the same\ntext again'").count()
    assert kept(copies_once=True) == 50 and kept() == 0


def test_lines_match_brute_force(spark):
    """The plain ratio: rows that have a line, over the host's rows."""
    rng = random.Random(8)
    data = [(i, "\n".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(0, 5))), rng.choice(["h", "g", None])) for i in range(120)]
    data += [(200 + i, None, "h") for i in range(9)] + data[:7]
    got = lines.without_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string"), ratio=0.3, min_pages=5)
    total = Counter(s or "" for _, t, s in data if t is not None)
    on = Counter((s or "", x) for _, t, s in data if t is not None for x in set(t.split("\n")))
    drop = {(s, x) for (s, x), n in on.items() if x and n >= 5 and n / total[s] > 0.3}
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s or "", x) not in drop), s) for i, t, s in data]
    assert drop and Counter(tuple(r)[:3] for r in got.collect()) == Counter(want)


# --- quality


def test_statistics_match_brute_force(spark):
    texts = [*ODD, LONG, "a b c d e f g h " * 3, "#* $%\n& | <>\nsame\n\nsame\n same\nsame", "x\n\n\nx\n"]
    got = {r.doc_id: r for r in quality.statistics(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        own, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in own
                own.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), i


def test_decision_list_on_held_out_rows(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(300)]
    junk = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["###", "%%%"]) for _ in range(60)) for _ in range(100)]
    shout = [" ".join("".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(2, 9))) + "!!" for _ in range(60)) for _ in range(100)]
    texts = good + junk + shout + ["few words"]
    bad = [False] * 300 + [True] * 201
    df = docs(spark, texts)
    known = spark.createDataFrame([(i, 1 - b) for i, b in enumerate(bad) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.verdicts(df, known).collect()}
    held = [i for i in range(len(texts)) if i % 2 == 0]
    assert sum(got[i].kept == (not bad[i]) for i in held) >= 0.97 * len(held)
    assert got[len(texts) - 1].base_failed and not got[len(texts) - 1].kept
    rules = quality.learn(df, known)
    assert rules.rules and "reject if" in str(rules)


def test_kept_rows_stay_as_they_are(spark):
    texts = [" ".join(f"w{i}" for i in range(100)), "few", None]
    df = docs(spark, texts, [None, 1, 2]).withColumn("quality", F.lit("mine")).withColumn("n_words", F.lit(3))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in quality.of_quality(df, none).collect()] == [(None, texts[0], "s", "own", "mine", 3)]
    assert "Exchange" not in quality.of_quality(df, none)._jdf.queryExecution().executedPlan().toString()


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.verdicts(docs(spark, [" ".join(f"w{i}" for i in range(100)), None]), none).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in got] == [(False, True), (True, False)]
    assert quality.verdicts(docs(spark, []), none).count() == 0


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_brute_force(spark):
    texts = [
        "x +1+2 (345) 678-90.12 a@b.c_d@e.f.g..h@i 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 4111 1111-1111 1111 5 é😀 a@b.co",
        "+1 " + "2-" * 4000 + "9",
        "1" * 20_000 + " 4111111111111111",
        "a" * 20_000 + "@b" + ".c" * 5000,
        "😀 call +49 30 1234567, mail me: jo.x@y.org. 4111111111111111  411-1111111111111-1 ",
        "9" * 40 + ".1.1.1 12.13.14.15 99999999999.1.1.1",
        *ODD,
        LONG,
    ]
    rng = random.Random(4)
    texts += ["".join(rng.choice("0123 .-+()@ab4") for _ in range(80)) for _ in range(60)]
    got = pii.personal_data(docs(spark, texts)).select("doc_id", pii._listed({k: F.col(k) for k in pii.KINDS}).alias("b")).collect()
    for r in got:
        assert r.b == base(texts[r.doc_id]), r.doc_id


def test_contexts_discover_more(spark):
    texts = [f"please dial {'+49 30 %07d' % (i * 7919) if i % 4 else '030-55%05d' % i} now, number 12345{i:05d} is clean" for i in range(40)]
    got = pii.personal_data(docs(spark, texts)).where("size(added) > 0").collect()
    assert len(got) == 10
    assert all(texts[r.doc_id][s.start : s.end] == s.value and s.kind == "phone" for r in got for s in r.added)


ROUNDS = (
    # seeds and (017) 555 numbers behind "dial"; the latter behind "reach" too, where no seed is; behind that, others
    [f"please dial +49 30 {1000000 + i * 7919} now" for i in range(12)]
    + [f"please dial (017) 555-{7000 + i} now" for i in range(5)]
    + [f"you can reach (017) 555-{7000 + i} there" for i in range(5)]
    + [f"you can reach 020 7946 0{100 + i} there" for i in range(3)]
    + [f"order 020-{31000 + i} was sent" for i in range(9)]
    + ["the sum of 100000 and 200000 is 300000"]
)


def test_a_second_round_finds_what_the_first_cannot(spark):
    df = docs(spark, ROUNDS)
    found = pii.personal_data(df).where("size(added) > 0").collect()
    assert {s.value for r in found for s in r.added} == {f"(017) 555-{7000 + i}" for i in range(5)} | {f"020 7946 0{100 + i}" for i in range(3)}
    graph = pii.contexts(pii.mentions(df, "doc_id", "text")).cache()
    words = Counter(w for t in ROUNDS for w in re.findall(r"[^\W\d_]+", t.lower()))
    rows_ = graph.collect()
    totals = {r.pattern: min(words[w] for w in r.words) for r in rows_}
    known, sizes = pii.bootstrapped(graph, spark.createDataFrame(list(totals.items()), "pattern string, total long"))
    assert sizes == [5, 8, 8]
    # by hand
    values = {r.value: 1.0 for r in rows_ if r.seed}
    kinds = {r.value: r.seed for r in rows_ if r.seed}
    while True:
        trusted = {}
        for p in totals:
            own = [r for r in rows_ if r.pattern == p and r.value in values]
            score = min(1.0, sum(r.n * values[r.value] for r in own) / totals[p])
            if len({r.value for r in own}) >= pii.SUPPORT and score >= pii.CONFIDENCE:
                trusted[p] = score
        new = dict(values)
        for v in {r.value for r in rows_} - set(kinds):
            wrong = 1.0
            for p in {r.pattern for r in rows_ if r.value == v} & set(trusted):
                wrong *= max(1e-9, 1 - trusted[p])
            if 1 - wrong >= pii.CONFIDENCE:
                new[v] = 1 - wrong
        if new.keys() == values.keys():
            break
        values = new
    assert {r.value: pytest.approx(r.score) for r in known.collect()} == {v: s for v, s in new.items() if v not in kinds}


def test_prefix_sums(spark):
    rng = random.Random(13)
    lists = [[], [5], [rng.randint(0, 9) for _ in range(63)], [rng.randint(0, 9) for _ in range(64)], [rng.randint(0, 9) for _ in range(1000)]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", pii.prefix_sums(F.col("x")).alias("s")).collect()
    for r in got:
        assert r.s == [sum(lists[r.i][:k]) for k in range(len(lists[r.i]))]


def test_many_matches_of_one_text(spark):
    text = " ".join(f"a{i}@b.co" for i in range(20_000))
    got = pii.personal_data(docs(spark, [text])).first()
    assert len(got.email) == 20_000 and all(text[s.start : s.end] == s.value for s in got.email)


def test_native_plan(spark):
    plan = pii.contexts(pii.mentions(docs(spark, ["a"]), "doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_of_nothing(spark):
    assert pii.personal_data(docs(spark, [])).count() == 0


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="notice">Cookies</div><article><h1>My &amp; title</h1><p><b>One  two<br>three<p>Next &lt;b&gt; x</p><aside>side</aside><form>f</form><!-- c --><section id="comments"><p>Nice</p></section><p>End.</p></article><div class="ad">buy</div><footer>&copy; f</footer></body></html>"""


def test_page_text(spark):
    pages = [(0, "http://a.org/x/1", PAGE), (1, "http://a.org/x/1", PAGE), (2, None, None), (3, "http://a.org/x/2", ""), (4, "no url", "plain &am"), (5, "http://b.org/p1", "<p>Top</p><p>One</p><p>End"), (6, "http://b.org/p2", "<p>Top</p><p>Two</p><p>End")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r for r in html_text.page_texts(df).collect()}
    want = "My & title\n\nOne two three\n\nNext <b> x\n\nEnd."
    assert got[0].text == got[1].text == want
    assert got[2].text == got[3].text == "" and got[4].text == "plain &am"
    assert (got[5].text, got[6].text) == ("One", "Two") and got[5].n_shared == 2
    assert html_text.page_texts(df.limit(0)).count() == 0


def lcs(a, b):
    """Which of a are in a longest common subsequence, by the whole table of lengths."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_differencing_matches_brute_force(spark, ranges):
    """Hosts whose pages have a template of lines of their own and no telling tags; copies and equal pages among them."""
    rng = random.Random(12)
    pages = []
    for host in ("a.org", "b.org", "c.org"):
        template = [f"{host} part {i}" for i in range(6)]
        for n in range(14):
            body = [f"{host} text {n} {i} " + "word " * 20 for i in range(rng.randint(1, 4))]
            lines = template[:3] + body + template[3 if n % 3 else 4 :]
            pages.append((f"http://{host}/d{n % 4}/p{n}", lines))
            if n % 5 == 0:
                pages += [(f"http://{host}/d{n % 4}/p{n}x{i}", lines) for i in range(rng.randint(1, 6))]
    pages += [("http://alone.org/x", ["one", "two"]), (None, ["no url"]), (None, ["no url", "more"])]
    rng.shuffle(pages)
    rows_ = [(i, u, "".join(f"<div>{x}</div>" for x in lines)) for i, (u, lines) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.page_texts(spark.createDataFrame(rows_, "page_id long, url string, html string"), ranges=ranges).collect()}
    split = lambda u: (u.split("/")[2], "/" + "/".join(u.split("/")[3:])) if u else ("", "")
    order = sorted(range(len(pages)), key=lambda i: (*split(pages[i][0]), str(i)))
    lines = [[x.strip() for x in pages[i][1]] for i in range(len(pages))]
    changed = 0
    for at, i in enumerate(order):
        near = []
        for side in (order[:at][::-1], order[at + 1 :]):
            near += [next((j for j in side if lines[j] != lines[i] or split(pages[j][0])[0] != split(pages[i][0])[0]), None)]
        near = [j for j in near if j is not None and split(pages[j][0])[0] == split(pages[i][0])[0]]
        prefix = lambda j: len([1 for k in range(len(split(pages[i][0])[1])) if split(pages[j][0])[1][: k + 1] == split(pages[i][0])[1][: k + 1]])
        near.sort(key=lambda j: -prefix(j))
        want = lines[i]
        for most in (0.9, 1.0):
            told = [s for j in near for s in [lcs(lines[i], lines[j])] if sum(len(lines[i][k]) for k in s) < most * sum(map(len, lines[i]))]
            if told:
                want = [x for k, x in enumerate(lines[i]) if k not in told[0]]
                break
        assert got[i] == "\n\n".join(want), (i, pages[i][0])
        changed += want != lines[i]
    assert changed > 0.9 * len(pages)


def test_template_in_an_article_and_copies():
    page = lambda *parts: html_text.blocks("<article>" + "".join(parts) + "</article>")
    own = page("<h1>Mine</h1><p>A sentence that both have.</p><p>Own words, and a lot of them, as they should be.</p>", "<div>Subscribe now</div>")
    other = page("<h1>Theirs</h1><p>A sentence that both have.</p><p>Others.</p>", "<div>Subscribe now</div>")
    assert html_text.main_text(own, [other])[0] == "Mine\n\nA sentence that both have.\n\nOwn words, and a lot of them, as they should be."
    copy = page("<h1>Mine</h1><p>A sentence that both have.</p><p>Own words, and a lot of them, as they should be.</p>", "<div>Subscribe now</div><div>x</div>")
    assert html_text.main_text(own, [copy])[0].endswith("Subscribe now")
    assert not html_text.main_text(own, [copy, other])[0].endswith("Subscribe now")


@pytest.mark.parametrize("ranges", [1, 30])
def test_notices_of_marked_articles_go_by_host(spark, monkeypatch, ranges):
    """Notices in articles' paragraphs that many pages have go, sentences that few share stay; against the rule by brute force."""
    rng = random.Random(21)
    notice, late = "Subscribe to our letter", "All rights stay with us"
    pages = []
    for host in ("a.org", "b.org"):
        for n in range(24):
            own = [f"{host} article {n} part {i} " + f"w{n} " * 30 for i in range(rng.randint(2, 4))]
            if n in (4, 5, 6):
                own.insert(1, "A sentence of a few")
            if host == "a.org":
                own.insert(rng.randint(0, len(own)), notice)
                own += [late] if n % 4 else []
            pages += [(f"http://{host}/p{n:02}", own)] * (6 if n == 5 else 1)
    pages += [(f"http://small.org/{n}", [f"small {n} " * 9, notice]) for n in range(4)]
    pages += [("http://one.org/x", [notice])]
    rows_ = [(i, u, "<article>" + "".join(f"<p>{x}</p>" for x in own[:-1]) + f"<h2>Summary</h2><p>{own[-1]}</p></article>") for i, (u, own) in enumerate(pages)]
    df = spark.createDataFrame(rows_, "page_id int, url string, html string")
    for few in (1 << 20, 0):
        monkeypatch.setattr(html_text, "FEW_ROWS", few)
        got = {r.page_id: r.text for r in html_text.page_texts(df, ranges=ranges).collect()}
        assert len(got) == len(pages)
        for i, (url, own) in enumerate(pages):
            gone = (notice, late) if "a.org" in url else ()
            left = [x.strip() for x in [*own[:-1], "Summary", own[-1]] if x not in gone]
            assert got[i] == "\n\n".join(left), url
    assert html_text.page_texts(df.limit(0)).count() == 0


def test_names_of_sections_in_articles():
    text = lambda name: [t for t, says in html_text.blocks(f'<article><p>Own</p><section {name}><p>Part</p></section></article>') if says >= html_text.ARTICLE]
    for name in ('class="related-work"', 'id="search-methods"', 'id="sharing-of-data"', 'class="has-sidebar"'):
        assert text(name) == ["Own", "Part"], name
    for name in ('class="related-posts"', 'class="related"', 'id="searchForm"', 'class="box social-links"', 'class="newsletter-signup"', 'id="user-comments"', 'class="ad-slot"'):
        assert text(name) == ["Own"], name


@pytest.mark.parametrize("broken", ["<head><title>t</title>", "<iframe src=x />", "<iframe src=x>", "<svg/>", "<button>Go", "<select><option>1", "<object data=x>", "<noscript/>"])
def test_unclosed_elements_keep_the_article(broken):
    own = html_text.blocks(f"<html>{broken}<body><article><p>One</p><div>{broken}</div><p>Two {broken}</p><p>Three</p></article><footer>f</footer>")
    assert html_text.main_text(own, [])[0] == "One\n\nTwo\n\nThree"


def test_hidden_elements_end():
    own = html_text.blocks("<p>a <button>x</button>b<svg><title>t</title><text>y</text></svg> c<noscript><p>no</p></noscript>d</p><textarea>z</textarea><p>e")
    assert [t for t, _ in own] == ["a b cd", "e"]


def test_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for case in range(600):
        monkeypatch.setattr(html_text, "CELLS", 1 << 26 if case % 2 else 3)
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        flags = html_text.common(a, b)
        rest = iter(b)
        assert sum(flags) == table[-1][-1] and all(x in rest for x, f in zip(a, flags) if f)


def test_hostile_markup_is_linear():
    html_text.blocks('<a href="' * 20_000)
    html_text.blocks("<div>" * 5000 + "x")
    html_text.blocks("<script>" * 20_000)
    html_text.blocks("<button>" * 20_000)
    assert sum(html_text.common(["x"] * 8000, ["x"] * 9000)) == 8000
    shared = [f"s{i}" for i in range(10_000)]
    flags = html_text.common(["own", *shared], [f"other {i}" for i in range(9000)] + shared + ["end"])
    assert flags == [False] + [True] * 10_000


def test_hashes_of_queries_are_hex(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.createDataFrame([("",)], "t string").select(F.sha2("t", 256)).first()[0]


def test_contexts_of_long_words_and_whole_gaps(spark):
    """A word of any length is a pattern's, as is one far in front of the match."""
    long = "k" * 70_000
    for word, gap in (("mailword", " "), ("x" * 70, " "), (long, " "), ("İzmirword", " "), ("farword", " -" * 400 + " ")):
        texts = [f"{word}{gap}+49 30 {1000000 + i * 7919} {word}"[: -len(word) - 1] for i in range(6)] + [f"a {word}{gap}98765{i} b" for i in range(2)]
        got = pii.personal_data(docs(spark, texts)).where("size(added) > 0").collect()
        assert sorted(s.value for r in got for s in r.added) == ["987650", "987651"], word[:10]


def test_columns_of_any_name_and_ids_of_any_type(spark):
    texts = [" ".join(f"w{i}" for i in range(100)), "few", None]
    df = docs(spark, texts).withColumn("a.b", F.lit(1)).withColumn("c d", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.of_quality(df, none)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [(0, texts[0], "s", "own", 1, "x")]
    page = "<html><body><article><p>One two.</p></article></body></html>"
    for kind in ("smallint", "decimal(12,2)", "double", "date", "string"):
        pages = spark.createDataFrame([("1", "http://a.b/c", page), (None, None, None)], "page_id string, url string, html string")
        pages = pages.withColumn("page_id", F.lit("2020-01-01").cast(kind) if kind == "date" else F.col("page_id").cast(kind))
        got = html_text.page_texts(pages)
        assert got.schema["page_id"].dataType == pages.schema["page_id"].dataType
        assert sorted(r.text for r in got.collect()) == ["", "One two."]
