"""Block gzip is read in ranges, with the same records at every split size."""

import gzip
import random
import struct
import zlib

from pyspark.sql import functions as F

from helixlake.sources import sequences


def block_gzip(data, rng, most):
    """Members of odd sizes, each with its size in an extra field, and the empty one that ends a file."""
    out, at = b"", 0
    while True:
        part = data[at : at + rng.randint(1, most)]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        if not part:
            return out
        at += len(part)


def read(spark, path, split):
    got = sequences.scan_sequences(spark, str(path), split).select("offset", "name", "seq", "qual", "corrupt").collect()
    return [tuple(r)[1:] for r in sorted(got)]


def test_ranges_of_block_gzip(spark, tmp_path):
    rng = random.Random(2)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    fasta = "".join(f">a{i} note\n{dna(rng.randint(0, 70))}\n" + (dna(20) + "\n" if i % 3 else "") for i in range(250))
    fastq = "".join(f"@r{i}\n{(s := dna(rng.randint(1, 90)))}\n+\n{''.join(rng.choice('@>+IJ') for _ in s)}\n" for i in range(250))
    for name, text in (("a.fa", fasta), ("b.fq", fastq)):
        (tmp_path / name).write_text(text)
        want = read(spark, tmp_path / name, 1 << 26)
        assert len(want) == 250
        packed = block_gzip(text.encode(), rng, 700)
        assert gzip.decompress(packed).decode() == text
        (tmp_path / f"{name}.gz").write_bytes(packed)
        for split in (97, 333, 1000, 5000, 1 << 26):
            assert read(spark, tmp_path / f"{name}.gz", split) == want, (name, split)
        df = sequences.scan_sequences(spark, str(tmp_path / f"{name}.gz"), 1000)
        assert df.rdd.getNumPartitions() == -(-len(packed) // 1000)
        assert df.agg(F.count_distinct("offset")).first()[0] == 250


def test_other_gzip_is_one_range(spark, tmp_path):
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(">x\nACGT\n>y\nAC\n")
    df = sequences.scan_sequences(spark, str(tmp_path / "c.fa.gz"), 5)
    assert df.rdd.getNumPartitions() == 1 and [r.seq for r in df.orderBy("offset").collect()] == ["ACGT", "AC"]
