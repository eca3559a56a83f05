"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames, each the little-endian 32-bit ids of some whole documents; then a skippable
frame with an index of its documents; then the seek table of the zstandard seekable format, another skippable frame,
with the sizes of each frame and the low 32 bits of the XXH64 of its content.  Any zstandard decoder reads the file
from front to back, and a reader that wants a few documents decompresses only the frames that hold them.

Documents lie in ascending ``doc_id`` order within a file and over the files, whose order their index frames record.
Spark's text writer writes the files, one row each, with the seek table's last four bytes as its line separator, so
the commit protocol of Spark's writers holds and lost tasks are repeated safely.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceMemo, text_groups
from .scratch import importable

SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"
_SKIP_INDEX, _SKIP_TABLE = 0x184D2A50, 0x184D2A5E
#: Uncompressed bytes after which a frame or a file is closed; a longer document has a frame or file of its own.
FRAME_BYTES, FILE_BYTES = 1 << 18, 32 << 20

#: Tokenizer settings under which a text's ids are those of its parts between white space, and those of a run of letters
#: are the model's: white space is dropped, letters are lower-cased and stand alone, other signs stand together.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: ASCII signs that are neither letters, digits nor white space: behind a run of letters they are a token run of their own.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

_LOADED: dict = {}


class PartEncoder:
    """Ids, as bytes, of texts by the tokenizers library.

    If the tokenizer's settings allow it (see above), texts are cut at ASCII white space and a memo holds what the library
    gave for each part; a new part that is a run of letters and perhaps ASCII signs goes straight to the library's model,
    after the library's normalizer, in one call for many parts, where letters are not all ASCII.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            setting = json.load(f)
        steps = (setting.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_part = (
            (setting.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and steps[0].get("pattern") == {"Regex": _SPLIT}
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and not any(t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in setting["added_tokens"])
            and not any(t["content"][:1].isalnum() for t in setting["added_tokens"])
        )
        self.marks = sorted({t["content"][:2].lower().encode() for t in setting["added_tokens"]})
        # bytes that the byte-level alphabet writes as other characters than latin-1 does
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letters = {b: 256 + i for i, b in enumerate(odd)}
        self.memo = PieceMemo(self._parts, 700_000)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, text: str) -> bytes:
        ids = [t.id for t in self.tok.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stems(self, stems: list[bytes]) -> Iterator[bytes | None]:
        """Ids of each run of letters; None for what is none."""
        odd = [s for s in stems if not s.isascii()]
        normal = self.tok.normalizer.normalize_str(b" ".join(odd).decode()).split(" ")
        if len(normal) != len(odd):  # white space beyond ASCII
            normal = [self.tok.normalizer.normalize_str(s.decode()) for s in odd]
        texts = iter(normal)
        for s in stems:
            if s.isascii():
                yield self._model(s.lower().decode()) if s.isalpha() else None
            else:
                text = next(texts)
                yield self._model(text.encode().decode("latin-1").translate(self.letters)) if text.isalpha() else None

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        cut = [p.rstrip(_SIGNS) for p in parts]
        stems, known = set(cut) - {b""}, self.memo.known
        heads = {s: known[s] for s in stems if s in known and s.isalpha()}
        stems = list(stems.difference(heads))
        heads |= zip(stems, self._stems(stems), strict=True)
        tails = list({p[len(s) :] for p, s in zip(parts, cut, strict=True) if len(s) < len(p)})
        ends = dict(zip(tails, self._library([t.decode() for t in tails]) if tails else [], strict=True)) | {b"": b""}
        left = [p for p, s in zip(parts, cut, strict=True) if s and heads[s] is None]
        whole = dict(zip(left, self._library([p.decode() for p in left]) if left else [], strict=True))
        return [whole[p] if p in whole else heads.get(s, b"") + ends[p[len(s) :]] for p, s in zip(parts, cut, strict=True)]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_part:
            yield from self._library([t.decode() for t in texts])
            return
        # A-Z may be lower-cased before the rest unless a combining mark or an added token could make a difference
        plain = [b"\xcc" not in t and b"\xcd" not in t and not any(m in t for m in self.marks) for t in texts]
        parts = [(t.lower() if ok else t).split() for t, ok in zip(texts, plain, strict=True)]
        known = self.memo.lookup(parts)
        for p in parts:
            yield b"".join(map(known.__getitem__, p))


def encode_bytes(path: str, texts: list[bytes], end_id: int | None) -> Iterator[bytes]:
    if path not in _LOADED:
        _LOADED[path] = PartEncoder(path)
    end = b"" if end_id is None else struct.pack("<I", end_id)
    for ids in _LOADED[path].encode(texts):
        yield ids + end


class FileBuilder:
    """Collects documents and returns the bytes of a file, without the last four."""

    def __init__(self, partition: int, number: int):
        self.place = partition, number
        self.frames: list[tuple[bytes, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.frame_docs: list[int] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.frame_docs.append(len(self.frames))
        self.open.append(ids)
        self.open_bytes += len(ids)
        self.bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append((self.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        null = np.array([i is None for i in self.ids], np.uint8)
        index = struct.pack("<QQQ", *self.place, len(self.ids)) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + null.tobytes()
        index += np.array(self.sizes, "<u8").tobytes() + np.array(self.frame_docs, "<u4").tobytes()
        index = zstandard.ZstdCompressor(level=3).compress(index)
        index_frame = struct.pack("<II", _SKIP_INDEX, len(index)) + index
        entries = [struct.pack("<III", len(z), n, crc) for z, n, crc in self.frames] + [struct.pack("<III", len(index_frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(entries)
        head = struct.pack("<II", _SKIP_TABLE, len(table) + 9)
        return b"".join(z for z, _, _ in self.frames) + index_frame + head + table + struct.pack("<IB", len(entries), 0x80)


class FileReader:
    """Reads one file's bytes; only frames that are asked for are decompressed."""

    def __init__(self, data: bytes):
        if data[-4:] != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        n, flags = struct.unpack("<IB", data[-9:-4])
        if flags != 0x80:
            raise ValueError("seek table without checksums")
        rows = np.frombuffer(data, "<u4", 3 * n, len(data) - 9 - 12 * n).reshape(n, 3).astype(np.int64)
        self.data, self.rows, self.at = data, rows, np.concatenate([[0], np.cumsum(rows[:, 0])])
        lo = int(self.at[n - 1])
        magic, size = struct.unpack("<II", data[lo : lo + 8])
        if magic != _SKIP_INDEX:
            raise ValueError("no index of documents")
        index = zstandard.ZstdDecompressor().decompress(data[lo + 8 : lo + 8 + size])
        self.partition, self.number, docs = struct.unpack("<QQQ", index[:24])
        self.ids = np.frombuffer(index, "<i8", docs, 24)
        self.null = np.frombuffer(index, np.uint8, docs, 24 + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(index, "<u8", docs, 24 + 9 * docs).astype(np.int64)
        self.frame = np.frombuffer(index, "<u4", docs, 24 + 17 * docs).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])

    def content(self, frame: int) -> bytes:
        z, n, crc = self.rows[frame].tolist()
        lo = int(self.at[frame])
        raw = zstandard.ZstdDecompressor().decompress(self.data[lo : lo + z], max_output_size=max(n, 1))
        if len(raw) != n or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != crc:
            raise ValueError(f"frame {frame} is damaged")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids as bytes)."""
        last, raw, base = -1, b"", 0
        for i in range(len(self.ids)):
            doc_id = None if self.null[i] else int(self.ids[i])
            if wanted is not None and doc_id not in wanted:
                continue
            f = int(self.frame[i])
            if f != last:
                last, raw, base = f, self.content(f), int(self.start[np.searchsorted(self.frame, f)])
            lo = 4 * (int(self.start[i]) - base)
            yield doc_id, int(self.start[i]), raw[lo : lo + 4 * int(self.sizes[i])]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, partitions: int | None = None) -> None:
    """Encode every text and write the files below ``path``.

    Null text is empty; null ids come first; rows with equal ids are all written, in the order of a hash of their texts.
    The texts are dealt out by ranges of doc_id, and of hashes and rows where one id has very many, so a partition's ids
    are consecutive and its memory is one file's.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        out = FileBuilder(partition, 0)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([out.finish()], pa.binary())], ["content"])
        for batch in batches:
            ids, lo = batch.column(0).to_pylist(), 0
            for texts in text_groups(batch.column(1)):
                for doc_id, coded in zip(ids[lo : lo + len(texts)], encode_bytes(tokenizer_path, texts, end_id), strict=True):
                    out.add(doc_id, coded)
                    if out.bytes >= FILE_BYTES:
                        yield done()
                        number += 1
                        out = FileBuilder(partition, number)
                lo += len(texts)
        if out.ids:
            yield done()

    order = {"doc_id": F.col("doc_id"), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    dealt = docs.withColumns(order).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    files = dealt.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE_MAGIC.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, partition, number (the file's place), start_in_file, ids (binary, little-endian) of all or some documents."""
    importable(spark)
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = FileReader(data.as_py())
                rows = file.documents(wanted)
                while part := [r for _, r in zip(range(4096), rows)]:
                    doc, start, ids = zip(*part, strict=True)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array([file.partition] * n, pa.int64()), pa.array([file.number] * n, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "partition", "number", "start_in_file", "ids"],
                    )

    return _contents(spark, path).mapInArrow(run, "doc_id long, partition long, number long, start_in_file long, ids binary")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))
    if not files:
        return spark.createDataFrame([], "content binary")
    return spark.read.format("binaryFile").load(f"{path}/part-*").select("content")


def with_starts(rows: DataFrame) -> DataFrame:
    """rows (partition, number, start_in_file, n_tokens, ...) of all documents, with ``start``: the ids in front over all files.

    Sums go from files to partitions to all, so the one window without a key sees a row per partition.  The rows are
    read twice: pass a written table.
    """
    files = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("partition").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("partition", before(Window.orderBy("partition")).alias("base"))
    files = files.select("partition", "number", before(Window.partitionBy("partition").orderBy("number")).alias("inner")).join(parts, "partition")
    files = files.select("partition", "number", (F.col("base") + F.col("inner")).alias("before"))
    return rows.join(files, ["partition", "number"]).withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")
