"""Token-ID / binary output (3): a wavelet matrix per shard with access, rank and select.

A shard is one row of a Parquet table, whose ``payload`` is the whole succinct file: a header,
the shard's alphabet, the document offsets and one bit-plane for each bit of an id's rank in
the alphabet. Spark's own writer commits it, so a lost task leaves no half-written shard and
the path may be in any store that Spark writes to.

Layout of a payload (little-endian): ``SWM2``, uint32 length of the JSON header, the header
(n_tokens, n_docs, planes, alphabet, sizes of the sections), then the sections: uint16 alphabet,
int64 document ids, uint32 lengths (Zstandard frames), the directory, and the planes. A plane is
cut into blocks of BLOCK bits, each a Zstandard frame of its own; the directory holds, for
each block of each plane, the set bits before it in the plane (uint32) and the end of its frame
(uint32). So access, count and select open only the blocks that they step on, one or two a plane.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setphrase.llm.common import cut
from setphrase.llm.tokens import TOKENIZER, encode

MAGIC = b"SWM2"
BLOCK = 1 << 18
OPEN_BLOCKS = 128
CACHED = 800_000
NO_ID = np.iinfo(np.int64).min
SHARD = pa.schema({"part": pa.int32(), "seq": pa.int32(), "first_doc": pa.int64(), "n_tokens": pa.int64(), "payload": pa.binary()})


def build(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard; ids are those of its documents one after the other."""
    pack = zstandard.ZstdCompressor(level=1).compress
    used = np.zeros(65536, bool)
    used[ids] = True
    alphabet = np.flatnonzero(used).astype("<u2")
    rank = np.zeros(65536, np.uint16)
    rank[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
    x = rank[ids]
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    before, ends, frames, end = [], [], [], 0
    for bit in range(planes - 1, -1, -1):
        ones = (x & np.uint16(1 << bit)) != 0
        raw = np.packbits(ones, bitorder="little").tobytes()
        count = 0
        for at in range(0, len(raw), BLOCK // 8):
            block = raw[at : at + BLOCK // 8]
            frames.append(pack(block))
            end += len(frames[-1])
            before.append(count), ends.append(end)
            count += int.from_bytes(block, "little").bit_count()
        x = np.concatenate([np.compress(~ones, x), np.compress(ones, x)])  # indexing by a mask stumbles over every change of bit
    directory = np.array([before, ends], "<u4").tobytes()
    parts = [pack(alphabet.tobytes()), pack(docs.astype("<i8").tobytes()), pack(lengths.astype("<u4").tobytes()), directory, b"".join(frames)]
    head = json.dumps({"n_tokens": len(ids), "n_docs": len(docs), "planes": planes, "alphabet": len(alphabet), "sections": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class WaveletMatrix:
    """A shard opened from its file's bytes; blocks of planes are unpacked as they are needed."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        (size,) = struct.unpack_from("<I", payload, 4)
        head, at, parts = json.loads(payload[8 : 8 + size]), 8 + size, []
        self._unpack = zstandard.ZstdDecompressor().decompress
        view = memoryview(payload)
        for length in head["sections"]:
            parts.append(view[at : at + length])
            at += length
        self.n, self.planes = head["n_tokens"], head["planes"]
        self.alphabet = np.frombuffer(self._unpack(parts[0]), "<u2")
        self.docs, self.lengths = np.frombuffer(self._unpack(parts[1]), "<i8"), np.frombuffer(self._unpack(parts[2]), "<u4").astype(np.int64)
        self._blocks = -(-self.n // BLOCK)
        before, ends = np.frombuffer(parts[3], "<u4").astype(np.int64).reshape(2, self.planes, self._blocks)
        self._before, self._ends, self._frames = before, ends.ravel(), parts[4]
        self._open: dict[int, np.ndarray] = {}
        self.zeros = [self.n - self._ones(p, self.n) for p in range(self.planes)]

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bytes of a block; the last OPEN_BLOCKS stay open."""
        k = plane * self._blocks + block
        found = self._open.get(k)
        if found is None:
            if len(self._open) >= OPEN_BLOCKS:
                self._open.pop(next(iter(self._open)))
            found = self._open[k] = np.frombuffer(self._unpack(self._frames[self._ends[k - 1] if k else 0 : self._ends[k]]), np.uint8)
        return found

    def _bit(self, plane: int, at: int) -> int:
        return int(self._block(plane, at // BLOCK)[at % BLOCK // 8] >> at % 8) & 1

    def _ones(self, plane: int, at: int) -> int:
        """Set bits among the first ``at`` of a plane."""
        if not at:
            return 0
        block = (at - 1) // BLOCK
        bits, rest = self._block(plane, block), at - block * BLOCK
        count = int(self._before[plane, block]) + int(np.bitwise_count(bits[: rest // 8]).sum(dtype=np.int64))
        return count + (int(bits[rest // 8] & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0)

    def _bits(self, plane: int) -> np.ndarray:
        """A whole plane, unpacked."""
        k = plane * self._blocks
        raw = b"".join(self._unpack(self._frames[self._ends[i - 1] if i else 0 : self._ends[i]]) for i in range(k, k + self._blocks))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def _rank_of(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank = 0
        for p in range(self.planes):
            bit = self._bit(p, i)
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            rank = rank << 1 | bit
        return int(self.alphabet[rank])

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before position ``end`` (rank)."""
        rank = self._rank_of(token)
        if rank is None:
            return 0
        low, high = 0, self.n if end is None else min(end, self.n)
        for p in range(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if rank >> (self.planes - 1 - p) & 1 else (low - a, high - b)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token, -1 if there are fewer."""
        rank = self._rank_of(token)
        if rank is None or not 0 <= k < self.count(token):
            return -1
        low = 0
        for p in range(self.planes):
            a = self._ones(p, low)
            low = self.zeros[p] + a if rank >> (self.planes - 1 - p) & 1 else low - a
        i = low + k
        for p in range(self.planes - 1, -1, -1):
            one = rank >> (self.planes - 1 - p) & 1
            want = i - self.zeros[p] if one else i
            # the last block with too few such bits before it, then the place within it
            before = self._before[p] if one else np.arange(self._blocks) * BLOCK - self._before[p]
            block = int(np.searchsorted(before, want, "right")) - 1
            bits = np.unpackbits(self._block(p, block), bitorder="little")[: self.n - block * BLOCK]
            i = block * BLOCK + int(np.flatnonzero(bits == one)[want - int(before[block])])
        return i

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up: a plane's zeros come first in the order below it."""
        y = None
        for p in range(self.planes - 1, -1, -1):
            ones = self._bits(p)
            if y is None:
                y = np.zeros(self.n, np.uint16)
                y[self.zeros[p] :] = 1
            up = np.empty(self.n, np.uint16)
            up[np.flatnonzero(~ones)], up[np.flatnonzero(ones)] = y[: self.zeros[p]], y[self.zeros[p] :]
            if p:  # ranks gain the bit that the plane above sorted by
                y = up
                above = self.planes - p
                y[self.zeros[p - 1] :] |= np.uint16(1 << above)
            else:
                y = up
        return self.alphabet[y] if self.planes else np.zeros(0, np.uint16)


def write_shards(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000, tokenizer: str = TOKENIZER) -> None:
    """Encode every whole text (null: empty), append end_id, and write wavelet-matrix shards to ``path``.

    Documents are in ascending id order within and across shards, which ``part`` and ``seq``
    number in that order; the other columns are ``first_doc``, ``n_tokens`` and ``payload``. Rows with a null id come first; rows that
    repeat an id stay, next to one another. An empty table makes an empty one. Only ids
    (2 bytes a token) are shuffled, and a task holds one shard, not a partition.
    """
    ids = cut(encode(docs, end_id, id_col, text_col, tokenizer, CACHED))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // (2 * shard_tokens)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        part, made = TaskContext.get().partitionId(), 0

        def shard() -> pa.RecordBatch:
            docs_ = pa.concat_arrays([b.column(0) for b in held])
            first = docs_[0].as_py()
            raw = [x for b in held for x in b.column(2).to_pylist()]
            lengths = np.array([len(x) // 2 for x in raw], np.int64)
            payload = build(np.frombuffer(b"".join(raw), "<u2"), docs_.fill_null(NO_ID).to_numpy(zero_copy_only=False), lengths)
            values = (part, made, first, int(lengths.sum()), payload)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, SHARD.types)], SHARD.names)

        for batch in batches:
            at, sums = 0, np.cumsum(batch.column(1).to_numpy())
            while at < len(batch):
                done = int(sums[at - 1]) if at else 0
                end = min(len(batch), int(np.searchsorted(sums, done + shard_tokens - size)) + 1)
                held.append(batch.slice(at, end - at))
                size += int(sums[end - 1]) - done
                at = end
                if size >= shard_tokens:
                    yield shard()
                    held, size, made = [], 0, made + 1
        if held:
            yield shard()

    # rows that share an id can be dealt to several parts, by a hash of what they hold
    order = ["doc", "hash", "n", "ids"]
    ordered = ids.withColumn("hash", F.xxhash64("ids")).repartitionByRange(parts, "doc", "hash").sortWithinPartitions(*order).select("doc", "n", "ids")
    ordered.mapInArrow(run, "part int, seq int, first_doc long, n_tokens long, payload binary").write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc, start, n, crc (unsigned, of 32-bit ids).

    Starts come from the shards' sizes: a sum within each part, and one over a row a part.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    within = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("inner"))
    bases = within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard = WaveletMatrix(batch.column(2)[row].as_py())
                ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.lengths)
                raw = memoryview(ids.tobytes())
                starts = ends - shard.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                doc = pa.array(shard.docs, mask=shard.docs == NO_ID)
                where = [pa.array(np.full(len(crc), batch.column(c)[row].as_py(), np.int32)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*where, doc, pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["part", "seq", "doc", "inner", "n", "crc"])

    found = shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc long, inner long, n long, crc long")
    return found.join(bases, ["part", "seq"]).select("doc", (F.col("base") + F.col("inner")).alias("start"), "n", "crc")
