"""The Jaccard join against brute force over all pairs, and its parts."""

import random
import re

import numpy as np
import pytest

from helixlake.llm import jaccard

SCHEMA = "doc_id long, text string, node string, `a.b` int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "own", i) for i, t in enumerate(texts)], SCHEMA).repartition(4)


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(texts, ids, per_cent=85):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= per_cent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    key = lambda k: (k is None, k or 0)
    least = {r: min((ids[k] for k in range(len(ids)) if root[k] == r), key=key) for r in set(root)}
    return sorted(((ids[k], len(sets[k]), least[root[k]]) for k in range(len(texts))), key=repr)


def changed(rng, words, most):
    words = list(words)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"n{rng.randint(0, 10**9)}"], [words[k], words[k]]])
        words = words or ["x"]
    return words


def corpus(seed):
    rng = random.Random(seed)
    out = []
    for size in (1, 3, 4, 5, 9, 30, 31, 64, 65, 90, 200, 900):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        out += [" ".join(changed(rng, base, max(1, size // 60))) for _ in range(6)] + [" ".join(base)] * 2
    # many sets just below and above the similarity, in two sizes
    base = [f"b{k}" for k in range(130)]
    out += [" ".join(base[:cut] + [f"z{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 14))] + base[cut:]) for cut in range(0, 130, 2)]
    passage = " ".join(f"p{k}" for k in range(40))
    out += [passage + " " + " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 30))) for _ in range(40)]
    out += ["", None, " \n", "One", "one", "ONE", "a\x00b c", "Ünï côdé 😀"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tile_rows", [4, 2048])
def test_components_match_brute_force(spark, tile_rows):
    texts = corpus(tile_rows)
    ids = [*range(len(texts))]
    ids[3], ids[5], ids[6] = None, ids[4], None
    got = jaccard.similar_sets(docs(spark, texts, ids), tile_rows=tile_rows)
    assert got.columns == ["doc_id", "n_shingles", "component"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components(texts, ids)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(changed(rng, base, 3)) for _ in range(300)] + [" ".join(base)] * 300
    ids = list(range(len(texts)))
    got = jaccard.similar_sets(docs(spark, texts, ids), tile_rows=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components(texts, ids)


def test_one_very_long_text(spark):
    long = " ".join(f"w{k % 9973}x{k % 31}" for k in range(150_000))
    got = jaccard.similar_sets(docs(spark, [long, long + " end", "short one"])).collect()
    assert sorted(r.component for r in got) == [0, 0, 2]


def test_odd_tables(spark):
    assert jaccard.similar_sets(docs(spark, ["a"]).where("false")).collect() == []
    assert [tuple(r) for r in jaccard.similar_sets(docs(spark, ["", None])).sort("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]
    named = spark.createDataFrame([("x", "a b c d e"), ("b", "a b c d e")], "`doc.id` string, `t` string").withColumnRenamed("doc.id", "key")
    assert [tuple(r) for r in jaccard.similar_sets(named, "key", "t").sort("key").collect()] == [("b", 2, "b"), ("x", 2, "b")]
    with pytest.raises(ValueError):
        jaccard.similar_sets(docs(spark, ["a"]), similarity=0.3)


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m, both = rng.integers(1, 3000), rng.integers(1, 3000), rng.integers(0, 2000)
        pool = np.unique(rng.integers(0, 1 << 63, int(n + m + both), dtype=np.uint64))
        a, b = np.append(pool[:n], pool[n + m :]), pool[n:]
        sets = [np.sort(x) for x in (a, b)]
        at = np.append(0, np.cumsum([len(x) for x in sets]))
        signed = jaccard._signature_rows(np.concatenate(sets), at)
        widths = jaccard.width_of(np.array([len(x) for x in sets]))
        while widths.max() > widths.min():
            k = int(widths.argmax())
            widths[k] //= 2
            signed[k] = jaccard.folded(signed[k : k + 1], int(widths[k]))[0]
        differ = int(np.bitwise_count(signed[0] ^ signed[1]).sum())
        overlap = len(np.intersect1d(*sets))
        assert jaccard.intersect_size(*sets) == overlap
        assert overlap <= (len(sets[0]) + len(sets[1]) - differ) / 2
