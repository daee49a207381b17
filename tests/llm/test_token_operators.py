"""Near duplicates, tokens, packing, frames and the pipeline, against brute force and round trips."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from conftest import rows
from tokenizers import Tokenizer

import corpus_pipeline
from helixlake.llm import components, frames, golay, packing, simhash, tables, token_counts, tokens
from helixlake.llm.tables import shared_dir, table

ODD = ["", None, " \n\t", "one", "a\x00b c", "ünï côdé 😀 mark", "x" * 20_000, "<|endoftext|> a<|startoftext|>b"]
WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def docs(spark, texts, ids=None):
    data = [(ids[i] if ids else i, t, "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, piece string")


def ids_of(text, *end):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# --- Golay code


def test_golay_keys_meet_at_distance_two():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400)
    own = golay.keys(words)
    assert {int((k >= 0).sum()) for k in own} == {1, 6}
    for a in range(23):
        for b in range(a, 23):
            other = golay.keys(words ^ (1 << a) ^ (0 if a == b else 1 << b))
            for x, y in zip(own, other):
                assert set(x[x >= 0]) & set(y[y >= 0])


def test_golay_code_is_perfect():
    assert (golay.near() >= 0).any(axis=1).all() and (np.bitwise_count(golay.near()[golay.near() >= 0].astype(np.uint64)) <= 4).all()


# --- components


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3)] + [(5000, 5001 + i) for i in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root if find(x) != x}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def fingerprint(text, size=4):
    w = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids, near):
    label = dict(enumerate(ids))
    for _ in range(len(ids)):
        new = {i: min(label[j] for j in range(len(ids)) if near(prints[i], prints[j])) for i in label}
        if new == label:
            break
        label = new
    return [label[i] for i in range(len(ids))]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(6)
    texts = list(ODD)
    for _ in range(25):
        words = [rng.choice(["the", "of", "and"]) + str(rng.randint(0, 200)) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words).upper())
    texts += [texts[12]] * 3
    ids = list(range(100, 100 + len(texts)))
    prints = [fingerprint(t) for t in texts]
    want = linked(prints, ids, lambda a, b: bin(a ^ b).count("1") <= 4)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs(spark, texts, ids)).collect()}
    assert [got[i] for i in ids] == list(zip(prints, want))


@pytest.mark.parametrize(("block", "segments", "held"), [(8, "THREE", 50), (2048, "THREE", 500_000), (64, "FOUR", 500_000)])
def test_links_of_many_close_fingerprints(spark, monkeypatch, block, segments, held):
    """Hot keys are dealt out in blocks without losing links."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", held)
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    while len(prints) < 150:
        x = base
        for bit in rng.choice(64, 4, replace=False):
            x ^= 1 << int(bit)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    items = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {tuple(r) for r in components.components(simhash.close_links(items, 4, getattr(simhash, segments))).collect()}
    label = linked(prints, signed, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert got == {(s, r) for s, r in zip(signed, label) if s != r}


def test_similar_texts_match_brute_force(spark):
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(30):
        words = [f"v{rng.randint(0, 4000)}" for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
            texts.append(" ".join(words))
    ids = list(range(len(texts)))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    want = linked(sets, ids, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.least for r in simhash.similar_texts(docs(spark, texts)).collect()}
    assert [got[i] for i in ids] == want
    assert simhash.similar_texts(docs(spark, [])).count() == 0


def test_similar_texts_with_added_passages_are_all_found(spark, monkeypatch):
    rng = random.Random(9)
    texts, shared = [], [f"s{i}" for i in range(60)]
    for case in range(240):
        n = rng.choice([12, 40, 80, 150, 300])
        words = [f"v{rng.randint(0, 9000)}" for _ in range(n)]
        if case % 4 == 0:
            words[: n // 2] = shared[: n // 2]
        more = [f"v{rng.randint(0, 9000)}" for _ in range(int((n - 4) * rng.choice([0.1, 0.2, 0.23, 0.25, 0.26])))]
        at = rng.choice([0, n // 2, n])
        texts += [" ".join(words), " ".join([*words[:at], *more, *words[at:]])]

    def shingles(t):
        w = t.encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, ids = [shingles(t) for t in texts], list(range(len(texts)))
    want = linked(sets, ids, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert len(set(want)) < len(texts) - 100
    for block in (2048, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.doc_id: r.least for r in simhash.similar_texts(docs(spark, texts)).collect()}
        assert [got[i] for i in ids] == want


def test_repeated_rows_and_ids_of_any_type(spark):
    words = [f"v{i}" for i in range(100)]
    near = " ".join([*words[:50], "other", *words[51:]])
    a, far = " ".join(words), " ".join(reversed(words))
    data = [("b", a, 1), ("a", near, 2), (None, a, 3), ("a", far, 4), ("a", far, 4), (None, None, 5), ("z", "", 6), ("a", near, 2)]
    df = spark.createDataFrame(data, "doc_id string, text string, page int")
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [("a", near, 2), ("a", far, 4), ("z", "", 6)]
    assert {(r.doc_id, r.component) for r in simhash.near_duplicates(df.where(F.col("text") == a)).collect()} == {("b", "b"), (None, "b")}
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.without_near_duplicates(df.limit(0)).count() == 0


def test_tables_of_any_size_give_the_same_groups(spark, monkeypatch):
    rng, texts = random.Random(11), []
    for _ in range(20):
        words = [f"v{rng.randint(0, 4000)}" for _ in range(120)]
        texts.append(" ".join(words))
        words[rng.randrange(120)] = "edit"
        texts += [" ".join(words)] * 2
    df = docs(spark, texts)
    want = rows(simhash.similar_texts(df).select("doc_id", "least"))
    monkeypatch.setattr(tables, "FEW_ROWS", 0)
    monkeypatch.setattr(tables.beside, "__defaults__", (0,))
    monkeypatch.setattr(simhash, "FEW_ROWS", 0)
    assert rows(simhash.similar_texts(df).select("doc_id", "least")) == want


def test_a_few_pairs_of_each_two_groups():
    rng = np.random.default_rng(16)
    one, other, mark = (rng.integers(0, n, 500) for n in (4, 4, 1 << 40))
    k = simhash._few_of_each(one, other, mark, 3)
    pairs = [tuple(sorted(p)) for p in zip(one.tolist(), other.tolist())]
    for p in set(pairs):
        assert sum(pairs[i] == p for i in k) == min(3, pairs.count(p))
    assert len(simhash._few_of_each(one[:0], other[:0], mark[:0], 3)) == 0


def test_groups_that_keys_keep_apart_are_joined(spark, monkeypatch):
    """Without any close fingerprints all is left to the second search, whose first round sees one pair of each two groups only."""
    monkeypatch.setattr(simhash, "CLOSE", 0)
    monkeypatch.setattr(simhash, "FEW_PAIRS", 1)
    words = [f"v{i}" for i in range(200)]
    texts = [" ".join([*words[: 5 * i], f"x{i}", *words[5 * i + 1 :]]) for i in range(40)] + ["apart " * 9, " ".join(reversed(words))]
    got = {r.doc_id: r.least for r in simhash.similar_texts(docs(spark, texts)).collect()}
    assert got == {i: 0 for i in range(40)} | {40: 40, 41: 41}


def test_a_large_cluster_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FULL_BLOCK", 8)
    words = [f"v{i}" for i in range(200)]
    texts = [" ".join([*words[: 5 * i], f"x{i}", *words[5 * i + 1 :]]) for i in range(40)]
    got = simhash.similar_texts(docs(spark, texts)).collect()
    assert {r.least for r in got} == {0}


# --- tokens


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pieces_give_the_tokenizers_ids(text):
    try:
        data = text.encode()
    except UnicodeEncodeError:
        return
    assert np.frombuffer(tokens.encoder().ids(data), "<u4").tolist() == ids_of(text)


def test_pieces_of_every_letter():
    for i in [*range(1, 0x600), 0x1E9E, 0x2126, 0x212B, 0x3000, 0x1F600]:
        text = chr(i) * 2 + "a" + chr(i) + " 's'S"
        assert np.frombuffer(tokens.encoder().ids(text.encode()), "<u4").tolist() == ids_of(text), i


def test_other_tokenizers_are_encoded_whole():
    assert not tokens.pieces_are_safe(public_tokenizers.path("byte_bpe_50k.json"))
    other = tokens.Encoder("byte_bpe_50k.json")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(other.ids(b"Some  text\n here"), "<u4").tolist() == t.encode("Some  text\n here", add_special_tokens=False).ids


# --- packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_best_fit_plan(counts):
    plan = packing.best_fit(counts, 40)
    sequences: dict[int, list] = {}
    for length, low, high, first, each, at in plan:
        for rank in range(low, high):
            j = rank - low
            sequences.setdefault(first + j // each, []).append((at + j % each * length, length))
    by_length: dict[int, list] = {}
    for length, low, high, *_ in plan:
        by_length.setdefault(length, []).append((low, high))
    for length, n in counts.items():
        spans = sorted(by_length[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for slots in sequences.values():
        end = 0
        for at, length in sorted(slots):
            assert at == end
            end += length
        assert end <= 40
    # best fit decreasing, piece by piece
    rooms: list[int] = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(40 - length)
    assert len(sequences) == len(rooms)


def test_packing(spark):
    texts = [*ODD, "a b c " * 500, "d e " * 300, None, "a b c " * 500]
    got = packing.pack(docs(spark, texts), size=256).collect()
    want = []
    for i, t in enumerate(texts):
        own = ids_of(t, 1)
        want += [(i, k // 256, k, len(own[k : k + 256]), crc(own[k : k + 256])) for k in range(0, len(own), 256)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    assert packing.pack(docs(spark, [])).count() == 0


# --- frames


def test_frames_round_trip(spark):
    texts = [*ODD, *(f"text {i} " * (i % 50) for i in range(200))]
    ids = [None, *range(len(texts) - 1, 0, -1)]
    ids[5] = ids[6]
    manifest = frames.write_frames(docs(spark, texts, ids), shared_dir(spark), frame_tokens=500)
    assert manifest.count() > 5
    placed = frames.read_documents(manifest).join(frames.starts(manifest), ["part", "frame"]).orderBy("part", "frame", "place").collect()
    assert [r.id for r in placed] == sorted(ids, key=lambda i: (i is not None, i or 0))
    want: dict = {}
    for i, t in zip(ids, texts):
        want.setdefault(i, []).append(ids_of(t, 2))
    got: dict = {}
    for r in placed:
        got.setdefault(r.id, []).append(np.frombuffer(r.tokens, "<u4").tolist())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_reader_fetches_only_what_it_needs(spark):
    manifest = frames.write_frames(docs(spark, [f"text {i}" for i in range(300)]), shared_dir(spark), frame_tokens=100)
    wanted = manifest.where("first_id <= 42 AND last_id >= 42")
    assert wanted.count() == 1
    assert frames.read_documents(wanted).where("id = 42").count() == 1
    row = manifest.orderBy("part", "frame").first()
    system, path = pyarrow.fs.FileSystem.from_uri(row.path)
    with system.open_input_file(path) as file:
        entries = frames.read_seek_table(file)
        assert entries[0] == (0, row["size"], row.content, row.checksum)
        assert frames.unpacked_frame(frames.read_frame(file, *entries[1][:2], entries[1][3]))[0]
        with pytest.raises(ValueError, match="checksum"):
            frames.read_frame(file, entries[0][0], entries[0][1], entries[0][3] ^ 1)


def test_starts_count_the_ids_before(spark, tmp_path):
    texts = [*ODD, *(f"text {i} " * (i * 7 % 50) for i in range(150))]
    ids = random.Random(14).sample(range(-1000, 1000), len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in frames.op10_frames(spark, str(tmp_path)).collect()}
    want, before = {}, 0
    for i, t in sorted(zip(ids, texts)):
        own = ids_of(t, 2)
        want[i] = (before, len(own), crc(own))
        before += len(own)
    assert got == want


def test_only_wanted_documents_are_read(spark, monkeypatch):
    texts = [f"text {i}" for i in range(300)]
    manifest = frames.write_frames(docs(spark, texts, [3 * i for i in range(300)]), shared_dir(spark), frame_tokens=100)
    wanted = spark.createDataFrame([(3,), (300,), (301,), (897,), (9000,), (None,), (-5,), (3,)], "doc_id long")
    got = {r.id: np.frombuffer(r.tokens, "<u4").tolist() for r in frames.read_wanted(manifest, wanted).collect()}
    assert got == {i: ids_of(texts[i // 3], 2) for i in (3, 300, 897)}
    # a manifest whose places are wrong does no harm: they come from the seek table; and frames that nobody asks for are not touched
    row = manifest.where("first_id <= 300 AND last_id >= 300").first()
    system, path = pyarrow.fs.FileSystem.from_uri(row.path)
    data = bytearray(system.open_input_file(path).read())
    with system.open_input_file(path) as file:
        entries = frames.read_seek_table(file)
    for k, (at, size, _, _) in enumerate(entries):
        if k != row.frame:
            data[at : at + size] = bytes(size)
    with system.open_output_stream(path, compression=None) as file:
        file.write(bytes(data))
    only = spark.createDataFrame([(300,)], "doc_id long")
    assert [r.id for r in frames.read_wanted(manifest.withColumn("offset", F.lit(-1)), only).collect()] == [300]
    with pytest.raises(TypeError):
        frames.write_frames(docs(spark, ["a"]).withColumn("doc_id", F.lit("x")), shared_dir(spark))


def test_frames_of_nothing(spark):
    assert frames.read_documents(frames.write_frames(docs(spark, []), shared_dir(spark))).count() == 0


# --- counts under edits


def count(text):
    return len(ids_of(text))


def test_edited_trees_match_whole_counts():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "cde", "\n", " ", "12", "é"]) for _ in range(rng.randint(0, 60)))
        ends = token_counts.cut(text, 8)
        sums = token_counts.tree([count(text[a:b]) for a, b in zip([0, *ends], ends)])
        assert sums[1] == count(text)
        places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(1, 4))))
        edits = [(a, b, rng.choice(["", "x", " y ", "zz z"])) for a, b in zip(places[::2], places[1::2])]
        new = text
        for a, b, x in reversed(edits):
            new = new[:a] + x + new[b:]
        new_ends, new_sums, _ = token_counts.edited(text, ends, sums, edits, count)
        assert new_sums[1] == count(new) and new_ends[-1] == len(new)
    with pytest.raises(ValueError):
        token_counts.edited("abcdef", [6], [0, 1], [(0, 3, ""), (2, 4, "")], count)


def test_counts_of_a_tokenizer_whose_tokens_cross_blanks(spark):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = lambda t: len(other.encode(t, add_special_tokens=False).ids)
    text = "some words  and\n\n 12345 more " * 60
    df = docs(spark, [text, "", None])
    trees = token_counts.count_trees(df, tokenizer="byte_bpe_50k.json")
    assert {r.id: r.sums[1] for r in trees.collect()} == {0: own(text), 1: 0, 2: 0}
    after = token_counts.apply_edits(trees, token_counts.number_edits(df), tokenizer="byte_bpe_50k.json").collect()
    assert [r.sums[1] for r in after] == [own(text.replace("12345", "[number]"))]


def test_edits_read_only_what_they_touch(spark):
    text = "word " * 10_000 + "12345 " + "end " * 10_000
    texts = [*ODD, text, "1234", "no number", "1234"]
    df = docs(spark, texts)
    trees = token_counts.count_trees(df)
    assert {r.id: r.n for r in trees.select("id", F.col("sums")[1].alias("n")).collect()} == {i: count(t or "") for i, t in enumerate(texts)}
    got = {r.id: r for r in token_counts.apply_edits(trees, token_counts.number_edits(df)).collect()}
    k = len(ODD)
    assert set(got) == {k, k + 1, k + 3}
    assert got[k].sums[1] == count(text.replace("12345", "[number]")) and got[k].encoded < 1000
    assert token_counts.count_trees(docs(spark, [])).count() == 0


# --- pipeline


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(10)

    def prose(n):
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))

    item = prose(30)
    texts = [prose(80) for _ in range(60)]
    near = texts[3].split(" ")
    near[40] = "changed"
    junk = [" ".join(w + "###" for w in prose(60).split(" ")) for _ in range(40)]
    texts += [texts[2], " ".join(near), prose(40) + "\n" + item, *junk, "few", None]
    n = len(texts)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 0 if 63 <= i < 103 else 1, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = table(spark, str(tmp_path), "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == df.columns
            left[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert left["quality_rules"] == left["line_dedup"] == set(range(63))
    assert left["near_duplicates"] == set(range(60)) | {62}
    assert left["decontamination"] == set(range(60))
    before = set(folders(spark))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(folders(spark)) - before) == 1  # the result alone
    assert {r.doc_id for r in packed.collect()} == set(range(60))
    assert packed.agg(F.sum("length")).first()[0] == sum(len(ids_of(t, 1)) for t in texts[:60])


def folders(spark):
    """What is in the folder that jobs write to."""
    return os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
