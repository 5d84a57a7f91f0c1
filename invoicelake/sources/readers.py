"""Sources (I1, I2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from invoicelake.functions.intake import header_of, tail_of


def read_text_corpus(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """(doc_id, raw_text) from parquet or JSON columns, or from whole text files,
    which are identified by their path.  A null text becomes ''."""
    if fmt == "text":
        frame = spark.read.text(path, wholetext=True)
        return frame.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw_text"))
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw_text")
    )


def read_files(
    spark: SparkSession,
    path: str,
    pattern: str | None = None,
    recursive: bool = True,
    max_bytes: int | None = None,
    keep_content: bool = False,
) -> DataFrame:
    """One row per file with path, size, leading and last bytes.

    A missing path fails when the frame is made.  The content is cut down to
    its header and tail in the scan itself unless asked for; ``max_bytes`` is
    pushed to the source, so that larger files are not even opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    extra = ["content"] if keep_content else []
    content = F.col("content")
    return files.select(
        "path", "modificationTime", "length", header_of(content).alias("header"), tail_of(content).alias("tail"), *extra
    )
