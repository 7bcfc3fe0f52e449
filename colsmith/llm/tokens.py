"""Token ids of whole texts in wavelet-matrix shards, written by Spark and read back.

Documents are sorted by id over all partitions, encoded, ended by an end id and packed into shards of about
``SHARD_TOKENS`` ids. A shard is one row of the written files: its place (partition, number in the partition, ids before it there), the ids of its
documents and one compressed binary that holds the lengths of the documents and a wavelet matrix, one bit-plane for
each bit of the vocabulary. Rank directories are rebuilt when a shard is opened, so any token can be read, counted or located
without decoding the rest.

Null and empty texts have just the end id. Rows with equal ids stay apart, in the order of their texts; null ids come
first. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.llm import words as W

END_ID = 2
SHARD_TOKENS = 1 << 19
CACHED_PIECES = 300_000  # pieces of text whose ids a worker remembers
MARKS = ".,"  # units of their own after a letter and before a space or the end
BLOCK = 512  # bits between two entries of a rank directory
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Encoder:
    """Ids of texts from a tokenizers file.

    A single space between two other characters always begins a new unit of the byte-level split, and so do a full stop or comma
    after a letter at a piece's end and a line feed between other characters. Texts are cut there and each piece is encoded once; those with a cut next to other white space are encoded whole.
    With ``special_strings`` the strings of special tokens in a text are ordinary text; else they become those tokens, as in the library's own ``encode``.
    """

    def __init__(self, path: str, special_strings: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_strings
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values(), default=0) + 1
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made["normalizer"] is None
        self.known: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes | None] = {}
        self.marks = dict(zip([*MARKS, "\n"], self._whole([*MARKS, "\n"])))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_heads(self, pieces: set[str]) -> None:
        """Ids of new pieces without a space before them."""
        heads = self.heads
        bare = {h[:-1] if h[-1:] in MARKS and h[-2:-1].isalpha() else h for h in pieces}
        bare = [h for h in bare if h not in heads]
        heads.update((h, None if not h or h[-1].isspace() else ids) for h, ids in zip(bare, self._whole(bare) if bare else []))
        for h in pieces:
            if h not in heads:
                heads[h] = heads[h[:-1]] + self.marks[h[-1]]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of new pieces with the space before them; None for pieces that cannot stand alone."""
        known, bare, marked, lined = self.known, set(), set(), []

        def need(p):
            if p[-1] in MARKS and p[-2:-1].isalpha():
                marked.add(p)
                p = p[:-1]
            if p not in known:
                bare.add(p)

        for p in pieces:
            if not p or p[0].isspace() or p[-1].isspace():
                known[p] = None
                continue
            left, line, right = p.partition("\n")
            if line and not left[-1].isspace() and not right[0].isspace():  # one line feed between other characters is a unit
                lined.append((p, left, right))
                if left not in known:
                    need(left)
            else:
                need(p)
        if bare:  # all as one text: a piece begins where a token begins with a space
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(bare)], add_special_tokens=False)[0].ids, np.uint32)
            first = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(first) != len(bare) + 1:
                raise ValueError("pieces and tokens do not match")
            raw, ends = ids.tobytes(), (first * 4).tolist()
            known.update((p, raw[a:b]) for p, a, b in zip(bare, ends, ends[1:]))
        for p in marked:
            known[p] = known[p[:-1]] + self.marks[p[-1]]
        self._learn_heads({right for _, _, right in lined if right not in self.heads})
        for p, left, right in lined:
            known[p] = known[left] + self.marks["\n"] + self.heads[right]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        cut = [t.split(" ") for t in texts] if self.by_piece else []
        first = [p.pop(0) for p in cut]
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        if len(self.heads) > CACHED_PIECES:
            self.heads = {}
        self._learn_heads({h for h in set(first) if h not in self.heads})
        new = set()
        for p in cut:
            new.update(p)
        known = self.known
        new = {x for x in new if x not in known}
        if new:
            self._learn(new)
        for i, p in enumerate(cut):
            head = self.heads[first[i]]
            try:
                out[i] = head + b"".join([known[x] for x in p])
            except TypeError:  # a piece that cannot stand alone
                pass
        whole = [i for i, ids in enumerate(out) if ids is None]
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(path: str, special_strings: bool = False) -> Encoder:
    """One encoder a worker process, with the pieces it has learned in earlier tasks."""
    key = path, special_strings
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_strings)
    return _ENCODERS[key]


class WaveletMatrix:
    """Bit-planes of a sequence, highest bit first; each plane is in the order that the planes above sort the sequence into."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self._ranks = [None] * len(planes)
        self.zeros = [n - int(_POPCOUNT[p].sum()) for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, current = [], values.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            ones = (current & current.dtype.type(1 << b)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            following = np.empty_like(current)
            zeros = len(current) - int(np.count_nonzero(ones))
            np.compress(~ones, current, out=following[:zeros])
            np.compress(ones, current, out=following[zeros:])
            current = following
        return cls(len(values), planes)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)

    def rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        plane = self.planes[level]
        if self._ranks[level] is None:
            padded = np.pad(_POPCOUNT[plane], (0, -len(plane) % (BLOCK // 8)))
            self._ranks[level] = np.append(0, np.cumsum(padded.reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)))
        block, byte = i // BLOCK, i // 8
        ones = int(self._ranks[level][block]) + int(_POPCOUNT[plane[block * (BLOCK // 8) : byte]].sum())
        return ones + (int(_POPCOUNT[plane[byte] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """The value at place i."""
        value = 0
        for level, plane in enumerate(self.planes):
            bit, ones = int(plane[i // 8] >> (i % 8)) & 1, self.rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for level in range(len(self.planes)):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often the value stands before place i."""
        start, end = self._range(value, i)
        return end - start if value >> len(self.planes) == 0 else 0

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of occurrence k (from 0) of the value."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        low, high = 0, self.n - 1
        while low < high:  # the least place with k + 1 occurrences up to it
            middle = (low + high) // 2
            low, high = (low, middle) if self.rank(value, middle + 1) > k else (middle + 1, high)
        return low

    def occurrences(self, value: int) -> np.ndarray:
        """All places of the value, traced back from the last plane."""
        if value >> len(self.planes):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(value, self.n))
        for level in range(len(self.planes) - 1, -1, -1):
            bits = self._bits(level)
            one = value >> (len(self.planes) - 1 - level) & 1
            at = np.flatnonzero(bits)[at - self.zeros[level]] if one else np.flatnonzero(~bits)[at]
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = self._bits(level)
            sorted_, values = values, np.empty_like(values)
            values[~bits] = sorted_[: self.zeros[level]]
            values[bits] = sorted_[self.zeros[level] :] | values.dtype.type(1 << (len(self.planes) - 1 - level))
        return values


class Shard:
    """One shard: lengths of its documents and the wavelet matrix of their ids."""

    MAGIC = b"WMS1"

    def __init__(self, lengths: np.ndarray, matrix: WaveletMatrix):
        self.lengths, self.matrix = lengths, matrix

    def to_bytes(self) -> bytes:
        """Header (magic, documents, ids, planes), then each part as its size and its zstd frame."""
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(self.lengths.astype("<u4").tobytes()), *(pack(p.tobytes()) for p in self.matrix.planes)]
        head = self.MAGIC + struct.pack("<IQB", len(self.lengths), self.matrix.n, len(self.matrix.planes))
        return head + b"".join(struct.pack("<I", len(p)) + p for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        if raw[:4] != cls.MAGIC:
            raise ValueError("not a token shard")
        docs, n, planes = struct.unpack_from("<IQB", raw, 4)
        at, parts, unpack = 4 + struct.calcsize("<IQB"), [], zstandard.ZstdDecompressor().decompress
        for _ in range(planes + 1):
            size = struct.unpack_from("<I", raw, at)[0]
            parts.append(np.frombuffer(unpack(raw[at + 4 : at + 4 + size]), np.uint8))
            at += 4 + size
        return cls(parts[0].view("<u4"), WaveletMatrix(n, parts[1:]))


def write(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
          special_strings: bool = False) -> None:
    """Encode, sort and write all documents as shards."""
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("shard", pa.binary())])

    @W.lean
    def run(batches):
        encoder, end = encoder_of(tokenizer, special_strings), np.array([end_id], "<u4").tobytes()
        bits = max(1, int(max(encoder.size - 1, end_id)).bit_length())
        part, seq, before, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def shard():
            lengths = np.array([len(x) // 4 for x in held], np.uint32)
            matrix = WaveletMatrix.of(np.frombuffer(b"".join(held), "<u4"), bits)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "n_tokens": [matrix.n], "ids": [names], "shard": [Shard(lengths, matrix).to_bytes()]}, schema=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = encoder.encode([t or "" for t in some.column(1).to_pylist()])
                for name, x in zip(some.column(0).to_pylist(), ids):
                    held.append(x + end)
                    names.append(name)
                    size += len(held[-1]) // 4
                    if size >= shard_tokens:
                        yield shard()
                        seq, before, held, names, size = seq + 1, before + size, [], [], 0
        if held:
            yield shard()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.coalesce("text", F.lit("")))
    rows.mapInArrow(run, "part int, seq int, before long, n_tokens long, ids array<long>, shard binary").write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, start (ids before it over all shards), n_tokens, ids_crc32 of its ids as little-endian 32-bit integers."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row per written partition
    starts_of = dict(zip([r["part"] for r in sizes], np.append(0, np.cumsum([r["n"] for r in sizes])).tolist()))
    shared = spark.sparkContext.broadcast(starts_of)

    @W.lean
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in ("part", "before", "ids", "shard")}
                shard = Shard.from_bytes(row["shard"])
                ids, ends = shard.matrix.decode().astype("<u4"), np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(starts + (shared.value[row["part"]] + row["before"])), pa.array(shard.lengths.astype(np.int64)),
                     pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())],
                    [id_column, "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "ids", "shard").mapInArrow(run, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")
