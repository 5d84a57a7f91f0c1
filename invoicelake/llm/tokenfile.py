"""Token files: concatenated ids with Elias-Fano coded document boundaries and ids of documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from invoicelake.llm.bpe import encoder
from invoicelake.llm.common import shared_folder, slices, small_batches, stored
from invoicelake.llm.components import beside
from invoicelake.llm.files import with_scheme, write_file

#: Tokens of a file at most, but for one longer document.
FILE_TOKENS = 4 << 20
#: Ones between two entries of a select table.
SAMPLE = 256
MAGIC = b"TOKENEF1"
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass
class EliasFano:
    """A sorted sequence of n numbers below 2**63 in about 2 + log2(largest / n) bits each.

    `low` has the lowest bits of each number; the rest is `high`: number i sets bit (number >> bits) + i. `samples` are
    32-bit places of every SAMPLE-th set bit, so `select` reads a few bytes and no table of offsets is needed.
    """

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        largest = int(values[-1]) if n else 0
        bits = max(0, (largest // max(n, 1)).bit_length() - 1)
        parts = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little")
        return cls(n, bits, pack(parts.astype(np.uint8).ravel()), pack(flags), places[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        sizes = struct.pack("<QBQQQ", self.n, self.bits, len(self.low), len(self.high), len(self.samples))
        return sizes + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        arrays = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4")), strict=True):
            arrays.append(np.frombuffer(data, kind, size, at))
            at += arrays[-1].nbytes
        return cls(n, bits, *arrays), at

    def select(self, i: int) -> int:
        """The i-th number, from a sample and the set bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        mask = int(self.high[byte]) >> (place % 8) << (place % 8)
        while left >= _COUNT[mask]:
            left -= int(_COUNT[mask])
            byte += 1
            mask = int(self.high[byte])
        for _ in range(left):
            mask &= mask - 1
        top = byte * 8 + (mask & -mask).bit_length() - 1 - i
        first = i * self.bits
        window = int.from_bytes(self.low[first // 8 : (first + self.bits + 7) // 8].tobytes(), "little")
        return top << self.bits | window >> first % 8 & (1 << self.bits) - 1

    def run(self, a: int, b: int) -> np.ndarray:
        """The numbers from a to b - 1: the set bits between the sample at or before a and the one behind b."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, behind = int(self.samples[a // SAMPLE]), (b - 1) // SAMPLE + 1
        stop = int(self.samples[behind]) if behind < len(self.samples) else 8 * len(self.high)
        byte = first // 8
        places = np.flatnonzero(np.unpackbits(self.high[byte : (stop + 7) // 8], bitorder="little")) + 8 * byte
        places = places[places >= first][a % SAMPLE :][: b - a]
        start = a * self.bits
        flags = np.unpackbits(self.low[start // 8 : (b * self.bits + 7) // 8], bitorder="little")
        parts = flags[start % 8 :][: (b - a) * self.bits].reshape(b - a, self.bits)
        low = (parts.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (places - np.arange(a, b)).astype(np.uint64) << np.uint64(self.bits) | low

    def all(self) -> np.ndarray:
        """All numbers."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        parts = np.unpackbits(self.low, count=self.n * self.bits, bitorder="little").reshape(self.n, self.bits)
        low = (parts.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits) | low


def dump_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int) -> list[bytes]:
    """A file's parts. doc_ids ascend, nulls first; counts are tokens of each document; ids take `width` bytes each."""
    nulls = sum(d is None for d in doc_ids)
    known = doc_ids[nulls:]
    base = known[0] if known else 0
    gaps = EliasFano.of(np.array([d - base for d in known], np.uint64))
    ends = EliasFano.of(np.cumsum(counts))
    head = MAGIC + struct.pack("<BQQqQ", width, len(doc_ids), len(ids), base, nulls)
    return [head, gaps.dump(), ends.dump(), ids.astype(f"<u{width}").tobytes()]


@dataclass
class TokenFile:
    """An open token file: ids and ends of documents are read from their sequences in parts, never as whole tables."""

    nulls: int
    base: int
    gaps: EliasFano
    ends: EliasFano
    ids: np.ndarray

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """Ids of the documents from a to b - 1."""
        known = self.gaps.run(max(a - self.nulls, 0), max(b - self.nulls, 0))
        return [None] * max(min(b, self.nulls) - a, 0) + [self.base + int(x) for x in known]

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where the documents from a to b - 1 start, and where the last ends."""
        start = self.ends.select(a - 1) if a else 0
        return np.concatenate(([start], self.ends.run(a, b).astype(np.int64)))


def open_file(data: memoryview) -> TokenFile:
    if bytes(data[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token file")
    width, _, n_tokens, base, nulls = struct.unpack_from("<BQQqQ", data, len(MAGIC))
    gaps, at = EliasFano.load(data, len(MAGIC) + struct.calcsize("<BQQqQ"))
    ends, at = EliasFano.load(data, at)
    return TokenFile(nulls, base, gaps, ends, np.frombuffer(data, f"<u{width}", n_tokens, at))


def load_file(data: memoryview) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """What dump_file was given, the counts as ends of documents."""
    file = open_file(data)
    return file.doc_ids(0, file.ends.n), file.ends, file.ids


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Writes whole texts of (doc_id, text) as token files in ascending doc_id order; returns (file, n_docs, n_tokens, start).

    `end_id` closes each document. File names sort as their documents do; `start` counts the ids of all files before.
    Null ids come first; rows of one id are ordered by a hash of their text, so that even one hot id is spread. Null
    texts have the end id only. No rows, no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    target = with_scheme(folder or shared_folder(spark, "tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(tool.vocabulary.size, end_id + 1) <= 1 << 16 else 4
        names: list[int | None] = []
        counts: list[int] = []
        blocks: list[np.ndarray] = []
        made: list[tuple[str, int, int]] = []

        def flush() -> None:
            if names:
                file = f"{task:08d}-{len(made):06d}.tokens"
                write_file(target, file, dump_file(names, np.array(counts), np.concatenate(blocks), width))
                made.append((file, len(names), sum(counts)))
                names.clear(), counts.clear(), blocks.clear()

        for batch in batches:
            for part in slices(batch, 1):
                ids, starts = tool.encode(part.column(1).to_pylist())
                sizes = np.diff(starts) + 1
                closed = np.insert(ids, starts[1:], end_id).astype(f"u{width}")
                ends, docs_of = np.cumsum(sizes), part.column(0).to_pylist()
                cuts = np.flatnonzero(np.diff(ends // file_tokens)) + 1  # documents from which a file may start
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                    if counts and sum(counts) + int(sizes[a:b].sum()) > file_tokens:
                        flush()
                    names += docs_of[a:b]
                    counts += sizes[a:b].tolist()
                    blocks.append(closed[ends[a] - sizes[a] : ends[b - 1]])
        flush()
        if made:
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])], names=["file", "n_docs", "n_tokens"]
            )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            run, "file string, n_docs bigint, n_tokens bigint"
        ),
        "token-manifest",
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.select(
        F.concat(F.lit(target + "/"), "file").alias("path"), "*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    )


def read_token_files(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of token files (as write_token_files returns them): doc_id, start, n_tokens, ids_crc32, and `ids` on demand.

    `start` counts the ids of all documents before, n_tokens includes the end id, ids_crc32 is the CRC-32 of all ids as
    little-endian 32-bit integers. Bounds come from the files' sequences by select, 2,000 documents at a time. Empty
    files tables give no rows.
    """
    small_batches(spark)
    files = stored(files.select("file", "path", F.col("start").alias("file_start")), "token-files")
    folder = files.select(F.regexp_replace("path", "/[^/]*$", "")).first()
    extra = [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = "file string, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    if folder is None:
        return spark.createDataFrame([], schema.replace("file string, ", "").replace("place", "start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = open_file(memoryview(batch.column(1)[k].as_buffer()))
                n = file.ends.n
                for a in range(0, n, 2000):
                    b = min(n, a + 2000)
                    bounds = file.bounds(a, b)
                    wide = file.ids[bounds[0] : bounds[-1]].astype("<u4")
                    cut = bounds - bounds[0]
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    columns = [
                        pa.array([batch.column(0)[k].as_py()] * (b - a), pa.string()), pa.array(file.doc_ids(a, b), pa.int64()),
                        pa.array(bounds[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64()),
                    ]
                    if extra:
                        columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(wide.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "place", "n_tokens", "ids_crc32", *(e[0] for e in extra)])

    read = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder[0])
        .select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")
        .mapInArrow(run, schema)
    )
    return beside(read, files.select("file", "file_start"), "file", "inner").select(
        "doc_id", (F.col("file_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(e[0] for e in extra)
    )
