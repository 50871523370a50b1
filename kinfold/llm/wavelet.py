"""Token ids in wavelet matrices: one compressed file per shard, readable without its neighbours.

A wavelet matrix keeps one bit plane per bit of the ids, highest bit first; behind each plane the ids are
parted stably by that bit. With the counts of ones before every block of a plane (rank), it gives any token,
the number of times an id occurs in any stretch, and the place of its k-th occurrence (select), each in as
many steps as there are planes, and the whole sequence back.

File: the magic bytes, then sections, each with its length and compressed with zstandard: header (JSON),
document ids, null flags, document lengths, and per plane its bits and its ones before each block of
`BLOCK` bits.

In Spark: documents are range-partitioned and sorted by id; a task encodes its documents in order and writes a
shard as soon as it holds `SHARD_TOKENS`; a document is never split. A file is written under another name
and then renamed, and its name and content depend only on the rows, so a repeated task writes the same
file. What comes back is a row per file. The tasks' token totals (a number per task) give the global starts.

Defined results: null text is empty (the end id alone); rows of one id are ordered by text; null ids come
first; repeated rows are kept; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as TK
from .common import arrow_filesystem, materialise, scratch_folder

MAGIC = b"KWM1"
BLOCK = 512
SHARD_TOKENS = 1 << 20
END_ID = 0


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.planes, self.ones = n, planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ones = [], []
        for level in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            ones.append(cls._directory(planes[-1]))
            # Places, then a gather: a mask on random bits costs a branch missed per token.
            zeros, after = np.flatnonzero(~bit), np.empty_like(now)
            np.take(now, zeros, out=after[: len(zeros)], mode="clip")
            np.take(now, np.flatnonzero(bit), out=after[len(zeros) :], mode="clip")
            now = after
        return cls(len(ids), planes, ones)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        size = BLOCK // 8
        padded = np.zeros(-(-max(len(plane), 1) // size) * size, np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded).reshape(-1, size).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first `i` bits of a plane."""
        plane, size = self.planes[level], BLOCK // 8
        block, byte = i // BLOCK, i // 8
        got = int(self.ones[level][block]) + int(np.bitwise_count(plane[block * size : byte]).sum())
        return got + (int(plane[byte]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else got

    def access(self, i: int) -> int:
        """The token at place `i`."""
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            before = self._rank1(level, i)
            i = self.zeros[level] + before if bit else i - before
            value = value << 1 | bit
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of `token` in [a, b) stand behind the last plane."""
        top = len(self.planes) - 1
        for level in range(len(self.planes)):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            if token >> (top - level) & 1:
                a, b = self.zeros[level] + ra, self.zeros[level] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of `token` in [a, b)."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, a, self.n if b is None else b)
        return high - low

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        blocks = np.arange(len(self.ones[level]), dtype=np.int64)
        before = self.ones[level].astype(np.int64)
        if not bit:
            before = np.minimum(blocks * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        size = BLOCK // 8
        bits = np.unpackbits(self.planes[level][block * size : (block + 1) * size], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of `token`."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(f"token {token} occurs {high - low} times")
        at = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All tokens in order: the planes' partings undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for shift, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:zeros]
            before[np.flatnonzero(bit)] = now[zeros:] | now.dtype.type(1 << shift)
            now = before
        return now.astype(np.uint32)


class Shard:
    """The documents of one file: `ids` (None for null), `lengths` and the matrix of their tokens."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix):
        self.ids, self.nulls, self.lengths, self.matrix = ids, nulls, lengths, matrix

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        head = {"tokens": self.matrix.n, "documents": len(self.ids), "planes": len(self.matrix.planes)}
        sections = [
            json.dumps(head).encode(),
            self.ids.astype("<i8").tobytes(),
            np.packbits(self.nulls).tobytes(),
            self.lengths.astype("<u4").tobytes(),
        ]
        for plane, ones in zip(self.matrix.planes, self.matrix.ones, strict=True):
            sections += [plane.tobytes(), ones.astype("<u4").tobytes()]
        packed = [pack(s) for s in sections]
        return MAGIC + b"".join(struct.pack("<Q", len(p)) + p for p in packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        unpack, at, sections = zstandard.ZstdDecompressor().decompress, 4, []
        while at < len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            sections.append(unpack(data[at + 8 : at + 8 + size]))
            at += 8 + size
        head = json.loads(sections[0])
        planes = [np.frombuffer(s, np.uint8) for s in sections[4::2]]
        ones = [np.frombuffer(s, "<u4") for s in sections[5::2]]
        nulls = np.unpackbits(np.frombuffer(sections[2], np.uint8), count=head["documents"]).astype(bool)
        return cls(
            np.frombuffer(sections[1], "<i8"),
            nulls,
            np.frombuffer(sections[3], "<u4").astype(np.int64),
            WaveletMatrix(head["tokens"], planes, ones),
        )


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text: str = "text",
    bits: int = 16,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the files and return a row per file: `task`, `shard`, `documents`, `tokens`, `file`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_filesystem(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        enc = TK.encoder(tokenizer, True)
        ids, nulls, parts, held, shard = [], [], [], 0, 0
        rows = []

        def write():
            nonlocal ids, nulls, parts, held, shard
            matrix = WaveletMatrix.build(np.concatenate(parts), bits)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            data = Shard(np.array(ids, np.int64), np.array(nulls, bool), lengths, matrix).to_bytes()
            name = f"{root}/shard-{task:06d}-{shard:06d}.wm"
            with system.open_output_stream(f"{name}.{attempt}.tmp") as out:
                out.write(data)
            system.move(f"{name}.{attempt}.tmp", name)
            rows.append((task, shard, len(ids), held, name))
            ids, nulls, parts, held, shard = [], [], [], 0, shard + 1

        for batch in batches:
            keys = batch.column(0)
            for a, b in TK.text_runs(batch.column(1)):
                for i, tokens in enumerate(enc.encode(batch.column(1)[a:b].to_pylist()), a):
                    if held and held + len(tokens) + 1 > shard_tokens:
                        write()
                    key = keys[i].as_py()
                    ids.append(key or 0)
                    nulls.append(key is None)
                    parts.append(np.append(tokens, np.uint32(end_id)))
                    held += len(parts[-1])
        if held:
            write()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows, strict=True)],
                schema=pa.schema(
                    [("task", pa.int64()), ("shard", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("file", pa.string())]
                ),
            )

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("t"))
    d = d.repartitionByRange("id").sortWithinPartitions("id", "t")
    written = d.mapInArrow(run, "task bigint, shard bigint, documents bigint, tokens bigint, file string")
    return materialise(written, "wavelet-files")


def read_shards(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document from the files: id, `start`, `n_tokens`, `ids_crc32`."""
    totals = files.groupBy("task").agg(F.sum("tokens").alias("n")).orderBy("task").toArrow()
    # Range partitions are in order, so a task's documents follow those of the tasks before it.
    begin = np.cumsum(totals["n"].to_numpy()) - totals["n"].to_numpy() if totals.num_rows else []
    base = files.sparkSession.sparkContext.broadcast(
        dict(zip(totals["task"].to_pylist(), map(int, begin), strict=True))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = arrow_filesystem(folder)
        for batch in batches:
            for task, before, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(name) as f:
                    shard = Shard.from_bytes(f.read())
                tokens = shard.matrix.decode()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [TK.crc32(tokens[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.ids, mask=shard.nulls),
                        pa.array(starts + before + base.value[task]),
                        pa.array(shard.lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    from pyspark.sql import Window

    before = F.sum("tokens").over(Window.partitionBy("task").orderBy("shard")) - F.col("tokens")
    listed = files.select("task", before.alias("before"), "file")
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(parts, "file").mapInArrow(
        run, f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def encode(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> tuple[DataFrame, str]:
    """Write the shards under `folder` (a new one in the shared folder by default) and read them back."""
    folder = folder or scratch_folder(docs.sparkSession, "wavelet")
    files = write_shards(docs, tokenizer, folder, **options)
    return read_shards(files, folder, options.get("id_col", "doc_id")), folder
