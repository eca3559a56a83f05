"""BAM files of many blocks against a front-to-back reading."""

import random
import struct
import zlib

import pytest

from seqloom.sources import bgzf, genomics


def block(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return bgzf.MAGIC + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + bgzf.SIZE_FIELD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(rng: random.Random, k: int, n: int) -> bytes:
    name = f"r{k}".encode() + b"\0"
    # bases that hold magics and whole blocks
    odd = rng.choice([b"", bgzf.MAGIC * 3, block(b"BAM\1", 0)])
    seq = odd + bytes(rng.choice([0x11, 0x12, 0x48, 0x8F]) for _ in range((n + 1) // 2))
    n = 2 * len(seq)
    qual = bytes(rng.choice([0, 4, 8, 30]) for _ in range(n))
    body = struct.pack("<iiBBHHHiiii", rng.randrange(-1, 40), k, len(name), 30, 0, 1, 0, n, rng.randrange(-1, 40), 5, 6) + name + struct.pack("<I", n << 4) + seq + qual + b"XAZab\0"
    return struct.pack("<i", len(body)) + body


def stream(seed: int, records: int, longest: int) -> bytes:
    rng = random.Random(seed)
    text = "".join(f"@CO\tline {i}\n" for i in range((1 if seed < 5 else 9000))).encode()
    refs = b"".join(struct.pack("<i", 7) + f"chr{i:03d}".encode() + b"\0" + struct.pack("<i", 9) for i in range(40))
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 40) + refs + b"".join(record(rng, k, rng.randrange(longest)) for k in range(records))


def front_to_back(data: bytes) -> list:
    lines, refs, at = genomics._bam_header(data)
    rows = [(True, line, *[None] * 12) for line in lines]
    while at < len(data):
        rows.append(genomics._bam_record(data, at, refs))
        at += 4 + struct.unpack_from("<i", data, at)[0]
    return rows


@pytest.mark.parametrize(("seed", "sizes", "longest", "level"), [(1, (1, 2, 3, 50), 60, 6), (2, (700, 3000), 90, 0), (4, (5, 400), 6000, 6), (5, (60_000,), 200, 6)])
def test_bam_in_parts(spark, tmp_path, monkeypatch, seed, sizes, longest, level):
    tiny = sizes[0] == 1
    monkeypatch.setattr(bgzf, "PART_BLOCKS", 30 if tiny else 4)
    rng, data = random.Random(seed), stream(seed, 12 if tiny else 300, longest)
    out, at = [], 0
    while at < len(data):
        n = rng.choice(sizes)
        out.append(block(data[at : at + n], level))
        at += n
    (tmp_path / "x.bam").write_bytes(b"".join(out) + block(b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(500, sum(map(len, out)) // 7)))
    try:
        got = [tuple(r) for r in genomics.read_alignments(spark, str(tmp_path / "x.bam")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == front_to_back(data)


def test_damaged_bam(spark, tmp_path):
    data = stream(3, 30, 50)
    for k, bad in enumerate([b"no gzip", block(data)[:-9], block(data[:-5]), block(data[:200]), block(b"BAX" + data)]):
        (tmp_path / f"{k}.bam").write_bytes(bad)
        with pytest.raises(Exception, match="gzip|BAM|damaged|record"):
            genomics.read_bam(spark, str(tmp_path / f"{k}.bam")).collect()
