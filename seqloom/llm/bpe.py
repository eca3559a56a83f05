"""Byte-level BPE by a hierarchical-bitmap rank queue.

The symbols of many pre-tokens lie in one doubly linked list whose links stop at the pre-tokens' ends.  A bucket for
each merge rank holds the list positions at which that merge is possible; a bitmap of the non-empty buckets, with
bitmaps of the non-empty words above it, yields the smallest rank by find-first-set in as many steps as there are levels.
Pre-tokens do not influence one another, and entries of one pre-token with the same rank are taken from left to right.  A
bucket is merged at once where no merge into its token can bring up a smaller rank, as the vocabulary tells beforehand;
other buckets are heaps of positions, left as soon as a smaller rank comes up.  Positions whose pair has changed since they were queued are
stale and skipped.  The work is proportional to the number of queued pairs, so one very long pre-token is no harder
than many short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import importable

#: Text split at a time in a task, in bytes.
SPLIT_BYTES = 4 << 20
#: Buckets up to this size are handled entry by entry.
SMALL = 24


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BitmapQueue:
    """Non-empty buckets by number; 64-way words in levels, the top level being one word."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for words in self.levels:
            i, bit = i >> 6, 1 << (i & 63)
            if words[i] & bit:
                return
            words[i] |= bit

    def remove(self, i: int) -> None:
        for words in self.levels:
            i, bit = i >> 6, 1 << (i & 63)
            words[i] &= ~bit
            if words[i]:
                return

    def first(self) -> int:
        """The smallest number, or -1."""
        i = 0
        for words in reversed(self.levels):
            w = words[i]
            if not w:
                return -1
            i = i << 6 | (w & -w).bit_length() - 1
        return i


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        self.number = [0] * len(self.token)  # one int object for each id, so that a memo of many tuples stays small
        for b, r in ranks.items():
            self.token[r], self.number[r] = b, r
        self.ranks = ranks
        self.decimal = [str(i) for i in range(len(self.token))]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for b, r in ranks.items():
            for cut in range(1, len(b)):
                x, y = ranks.get(b[:cut]), ranks.get(b[cut:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = r
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_rank = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        # ranks whose merge can bring up a pair of a smaller rank, which then goes before the rest of their bucket
        sides = np.stack([keys >> 32, keys & 0xFFFFFFFF])
        self.dips = set(np.unique(sides[sides > self.pair_rank]).tolist())

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; no merge crosses a piece's end."""
        out: list = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = (whole,)
            elif not p:
                out[i] = ()
            else:
                todo.append(i)
        if not todo:
            return out
        length = np.array([len(pieces[i]) for i in todo])
        ends = np.cumsum(length)
        sym = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        self._merge(sym, ends)
        live = sym >= 0
        count = np.cumsum(live)[ends - 1]
        ids = list(map(self.number.__getitem__, sym[live].tolist()))
        lo = 0
        for i, hi in zip(todo, count.tolist(), strict=True):
            out[i] = tuple(ids[lo:hi])
            lo = hi
        return out

    def _merge(self, sym: np.ndarray, ends: np.ndarray) -> None:
        """Merge in place: a position that was merged into its left neighbour becomes -1."""
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[0] = -1
        prv[ends[:-1]] = -1
        buckets: dict[int, list] = {}
        queue, pairs, dips = BitmapQueue(len(self.token)), self.pairs, self.dips

        def put(at: np.ndarray, rank: np.ndarray) -> None:
            if len(at) <= SMALL:
                for a, r in zip(at.tolist(), rank.tolist(), strict=True):
                    if r >= 0:
                        put_one(a, r)
                return
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[cut].tolist(), np.split(at, cut[1:]) if len(cut) else [], strict=True):
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = bucket = []
                    queue.add(r)
                if r in dips:
                    bucket.extend(part.tolist())
                    heapify(bucket)
                else:
                    bucket.extend(part.tolist()) if len(part) <= SMALL else bucket.append(part)

        def put_one(a: int, r: int) -> None:
            bucket = buckets.get(r)
            if bucket is None:
                buckets[r] = [a]
                queue.add(r)
            elif r in dips:
                heappush(bucket, a)
            else:
                bucket.append(a)

        def merge_one(a: int, rank: int) -> int:
            """Merge at a if its pair still has this rank; the smallest rank that comes up, or this one."""
            x, b = int(sym[a]), int(nxt[a])
            if x < 0 or b < 0 or pairs.get(x << 32 | int(sym[b])) != rank:
                return rank
            c, z, low = int(nxt[b]), int(prv[a]), rank
            sym[a], sym[b], nxt[a] = rank, -1, c
            if c >= 0:
                prv[c] = a
                r = pairs.get(rank << 32 | int(sym[c]))
                if r is not None:
                    put_one(a, r)
                    low = min(low, r)
            if z >= 0:
                r = pairs.get(int(sym[z]) << 32 | rank)
                if r is not None:
                    put_one(z, r)
                    low = min(low, r)
            return low

        first = np.flatnonzero(nxt >= 0)
        put(first, self._rank(sym[first], sym[nxt[first]]))
        while (rank := queue.first()) >= 0:
            if rank in dips:
                # from left to right, until a smaller rank comes up
                bucket = buckets[rank]
                while bucket and merge_one(heappop(bucket), rank) == rank:
                    pass
                if not bucket:
                    queue.remove(rank)
                    del buckets[rank]
                continue
            queue.remove(rank)
            bucket = buckets.pop(rank)
            arrays = [b for b in bucket if isinstance(b, np.ndarray)]
            if len(bucket) > SMALL or arrays:
                at = np.unique(np.concatenate([*arrays, np.array([b for b in bucket if not isinstance(b, np.ndarray)], np.int64)]))
                left = sym[at]
                at, left = at[left >= 0], left[left >= 0]
                right = nxt[at]
                at, left, right = at[right >= 0], left[right >= 0], right[right >= 0]
                ok = self._rank(left, sym[right]) == rank
                at, right = at[ok], right[ok]
                if len(at) and (right[:-1] == at[1:]).any():  # x x x: pairs that overlap go from left to right
                    take, free = [], -1
                    for i, (a, b) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                        if a != free:
                            take.append(i)
                            free = b
                    at, right = at[take], right[take]
                after = nxt[right]
                sym[at], sym[right] = rank, -1
                nxt[at] = after
                prv[after[after >= 0]] = at[after >= 0]
                before, inner = prv[at], at[after >= 0]
                before = before[before >= 0]
                put(before, self._rank(sym[before], sym[nxt[before]]))
                put(inner, self._rank(sym[inner], sym[nxt[inner]]))
                continue
            for a in sorted(bucket):
                merge_one(a, rank)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PieceMemo:
    """Ids of pieces seen before, at most ``most`` of them: when it is full, new ones are held for one call only."""

    def __init__(self, encode: Callable[[list], list], most: int = 250_000):
        self.encode, self.most, self.known, self.passing = encode, most, {}, []

    def lookup(self, split: list[list]) -> dict:
        """A mapping that holds every piece of these texts, until the next call."""
        for piece in self.passing:
            del self.known[piece]
        self.passing = []
        seen: set = set()
        for pieces in split:
            seen.update(pieces)
        new = list(seen.difference(self.known))
        if new:
            if len(self.known) + len(new) > self.most:
                self.passing = new[max(0, self.most - len(self.known)) :]
            self.known.update(zip(new, self.encode(new), strict=True))
        return self.known


_LOADED: dict = {}


def _loaded(path: str, pattern: str):
    """One coder and memo for each worker process."""
    if (path, pattern) not in _LOADED:
        bpe = ByteBpe(read_ranks(path))
        memo = PieceMemo(lambda pieces: bpe.encode_pieces([p.encode() for p in pieces]))
        _LOADED[path, pattern] = bpe, memo, regex.compile(pattern)
    return _LOADED[path, pattern]


def text_groups(column: pa.Array, limit: int = SPLIT_BYTES) -> Iterator[list]:
    """The texts (or byte strings) of a column in runs of about ``limit`` bytes; null is empty."""
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    lo, held, n = 0, 0, len(column)
    for i, size in enumerate(pc.binary_length(column).to_pylist()):
        held += size or 0
        if held >= limit or i + 1 == n:
            yield [t or empty for t in column.slice(lo, i + 1 - lo).to_pylist()]
            lo, held = i + 1, 0


def encode_texts(path: str, pattern: str, texts: list[str]) -> Iterator[list[int]]:
    bpe, memo, split = _loaded(path, pattern)
    pieces = [split.findall(t) for t in texts]
    known = memo.lookup(pieces)
    for p in pieces:
        ids: list[int] = []
        for x in p:
            ids += known[x]
        yield ids


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every row.  ``ranks_path`` must be readable on every executor."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in text_groups(batch.column(1)):
                ids = list(encode_texts(ranks_path, pattern, texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                lo += len(texts)

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows doc_id, ids."""
    importable(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path, pattern)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encoding and decoding in one pass over the texts.

    Every row gives a row.  Null or empty text has no ids: 0 tokens and the digests of the empty string.  Text that
    the pattern does not match anywhere is not encoded, as in the library.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path, pattern)[0]
        for batch in batches:
            lo = 0
            for texts in text_groups(batch.column(1)):
                n, a, b, all_ids = [], [], [], []
                for ids in encode_texts(ranks_path, pattern, texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                columns = [batch.column(0).slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
                lo += len(texts)

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(run, schema + ", ids array<int>" * with_ids)
