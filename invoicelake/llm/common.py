"""What the operators share: scratch tables in the shared folder, row-wise Arrow columns, words and hashes in numpy."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Arrow batch holds at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which Spark removes when the application ends.

    Without that setting a local session gets a temporary folder; a cluster raises, as its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _SCRATCH.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="llm-"))
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.setdefault(
        "PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    )


def with_columns_by(
    df: DataFrame, source: str, fields: list[T.StructField], compute: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """`df` with columns that `compute` makes of one column; columns of the same name are replaced.

    All other columns pass as they are. `compute` gets slices of about 1 MB of text, or one longer text.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [k for k, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    at = [f.name.lower() for f in df.schema.fields].index(source.lower())
    schema = T.StructType([df.schema.fields[k] for k in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                made = compute(part.column(at))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + made, names=schema.names)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `limit` bytes."""
    import pyarrow.compute as pc

    column = batch.column(at)
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one more entry than texts). Null counts as ''."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0] if len(texts) else np.zeros(1, np.int64))


#: A word is a run of other bytes than these: the space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words_of(
    raw: np.ndarray, starts: np.ndarray, lower: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts in a row: 64-bit hash, first byte, end byte, and the index of the first word of each text.

    Two words with the same bytes have the same hash. `lower` folds A-Z.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(starts), np.int64)
    blank = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts[:-1][starts[:-1] < n]] = True  # a text starts anew
    solid = ~blank
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    first = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:] | edge[1:n]
    end = np.flatnonzero(solid & after) + 1
    return hash_spans(_LOWER[raw] if lower else raw, first, end), first, end, np.searchsorted(first, starts)


def hash_spans(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, from one running sum: equal spans have equal hashes."""
    up, down = _power_table(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `width` words from each word on, and how many of them each text has.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    have = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(hashes):
        return np.zeros(0, np.uint64), have
    factor = np.uint64(0xD1342543DE82EF95)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * factor + hashes[k : k + len(rolled)]
    out = np.zeros(int(have.sum()), np.uint64)
    to = np.cumsum(have) - have
    full = counts >= width
    if full.any():
        n, at = have[full], bounds[:-1][full]
        flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[flat + np.repeat(to[full], n)] = rolled[flat + np.repeat(at, n)]
    for t in np.flatnonzero((counts > 0) & ~full):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in hashes[bounds[t] : bounds[t + 1]]:
                value = value * factor + h
            value += np.uint64(counts[t])
        out[to[t]] = value
    return mix(out), have


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))
