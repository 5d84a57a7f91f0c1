"""Token counts: documents of flat token files without an index, found by their separators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from invoicelake.llm.bpe import encoder
from invoicelake.llm.common import shared_folder, slices, small_batches, stored
from invoicelake.llm.files import with_scheme, write_file

#: Tokens of a piece of a stream; documents go on from one piece into the next.
PIECE_TOKENS = 4 << 20
#: Tokens that one search looks at.
BLOCK_TOKENS = 1 << 18


def write_flat_files(
    docs: DataFrame, tokenizer: str, separator: int, folder: str, piece_tokens: int = PIECE_TOKENS
) -> DataFrame:
    """Writes whole texts of (doc_id, text) as streams of 16-bit ids, each document closed by `separator`; nothing else
    is in the files. Returns (stream, ordinal, doc_id), the documents in the order of each stream.

    Every task writes a stream, cut into pieces of `piece_tokens` wherever that falls. Special tokens within a text are
    text like any other, so the separator occurs nowhere else. Null texts have no token.
    """
    small_batches(docs.sparkSession)
    target = with_scheme(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task = encoder(tokenizer, special=False), TaskContext.get().partitionId()
        if max(tool.vocabulary.size, separator + 1) > 1 << 16:
            raise ValueError("flat files hold 16-bit ids")
        left, pieces, ordinal = np.zeros(0, np.uint16), 0, 0
        waiting: list[np.ndarray] = []
        size = 0

        def flush(last: bool) -> None:
            nonlocal left, pieces, size
            whole = np.concatenate([left, *waiting])
            waiting.clear()
            while len(whole) >= piece_tokens or (last and len(whole)):
                write_file(target, f"{task:08d}-{pieces:06d}.flat", [whole[:piece_tokens].astype("<u2").tobytes()])
                whole, pieces = whole[piece_tokens:], pieces + 1
            left, size = whole, len(whole)

        for batch in batches:
            for part in slices(batch, 1):
                ids, starts = tool.encode(part.column(1).to_pylist())
                waiting.append(np.insert(ids, starts[1:], separator).astype(np.uint16))
                size += len(waiting[-1])
                if size >= piece_tokens:
                    flush(False)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, task, np.int64)), pa.array(np.arange(ordinal, ordinal + n)), part.column(0)],
                    names=["stream", "ordinal", "doc_id"],
                )
                ordinal += n
        flush(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "stream bigint, ordinal bigint, doc_id bigint"), "flat-order")


def count_flat_files(spark: SparkSession, folder: str, separator: int) -> DataFrame:
    """Documents of flat files: (stream, ordinal, start, n_tokens), the separator not counted.

    Each piece is searched in blocks; a prefix scan over the pieces of a stream (their lengths, separators and last
    separators) then places its documents, so one may span any number of blocks and pieces. Tokens after the last
    separator of a stream are a document, too. Folders without files give no rows.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[k].as_buffer(), "<u2")
                found = [np.flatnonzero(ids[a : a + BLOCK_TOKENS] == separator) + a for a in range(0, len(ids), BLOCK_TOKENS)]
                places = np.concatenate(found) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, 1), pa.array([len(ids)]),
                        pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places.astype(np.int32))),
                    ],
                    names=["file", "n", "places"],
                )

    name = F.regexp_extract("path", "[^/]*$", 0)
    pieces = stored(
        spark.read.format("binaryFile").option("pathGlobFilter", "*.flat").load(folder)
        .select(name.alias("file"), "content")
        .mapInArrow(run, "file string, n bigint, places array<int>")
        .select(
            F.regexp_extract("file", "^([0-9]+)-", 1).cast("long").alias("stream"),
            F.regexp_extract("file", "-([0-9]+)", 1).cast("long").alias("piece"),
            "n",
            "places",
        ),
        "separators",
    )
    earlier = Window.partitionBy("stream").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stream")
    zero = F.lit(0).cast("long")
    # the scan: one row a piece
    scanned = (
        pieces.select("stream", "piece", "n", F.size("places").alias("found"), F.array_max("places").alias("last"))
        .withColumn("base", F.coalesce(F.sum("n").over(earlier), zero))
        .withColumn("ordinal", F.coalesce(F.sum("found").over(earlier), zero))
        .withColumn("after", F.col("base") + F.col("last") + 1)
        .withColumn("open", F.coalesce(F.max("after").over(earlier), zero))
        .withColumn("final", F.max("piece").over(whole) == F.col("piece"))
    )
    joined = pieces.drop("n").join(scanned, ["stream", "piece"])
    closed = joined.where("found > 0").select(
        "stream", "base", "ordinal", "open", F.posexplode(F.arrays_zip("places", F.concat(F.array(F.lit(None).cast("int")), F.slice("places", F.lit(1), F.greatest(F.size("places") - 1, F.lit(0)))).alias("before"))).alias("k", "at")
    ).select(
        "stream",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        F.coalesce(F.col("base") + F.col("at.before") + 1, F.col("open")).alias("start"),
        (F.col("base") + F.col("at.places")).alias("end"),
    )
    tail = scanned.where("final").select(
        "stream",
        (F.col("ordinal") + F.col("found")).alias("ordinal"),
        F.greatest("open", F.coalesce("after", zero)).alias("start"),
        (F.col("base") + F.col("n")).alias("end"),
    ).where("end > start")
    return closed.unionByName(tail).select("stream", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, separator: int) -> DataFrame:
    """Documents with their tokens as the flat files have them: doc_id, n_tokens, one row for each row of `docs`."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "flat")
    order = write_flat_files(docs, tokenizer, separator, folder)
    if order.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    return order.join(count_flat_files(spark, with_scheme(folder), separator), ["stream", "ordinal"]).select("doc_id", "n_tokens")
