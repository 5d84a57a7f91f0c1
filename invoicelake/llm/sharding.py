"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.common import shared_folder, stored
from invoicelake.llm.components import beside

#: Bits of a row's address, how many of them are the key's, and bits that one pass over the rows looks at.
BITS, KEY_BITS, STEP = 60, 44, 8


def address(key: str, row: Column) -> Column:
    """60 bits: 44 of the MD5 of the key's text, then 16 of that of the row's. Nulls count as ''."""
    digits = [F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, n // 4) for c, n in ((F.col(key), KEY_BITS), (row, BITS - KEY_BITS))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def _prefix_of(column: str, bits: int) -> Column:
    return F.shiftright(column, BITS - bits)


def _prefix(bits: int) -> Column:
    return _prefix_of("address", bits)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes) for rows (address, bytes): each holds at most `limit`, unless its rows share one
    address and so can't be split.

    Each pass sums the bytes of buckets STEP bits deeper, of those rows only whose bucket is still oversized; sums of
    the depths between come from those. Partial sums are made before the shuffle, so one hot bucket costs no more.
    """
    spark = rows.sparkSession
    done: list[DataFrame] = []
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    if total <= limit:
        return spark.createDataFrame([(0, 0, int(total))], "depth int, prefix bigint, bytes bigint")
    open_rows, depth = rows, 0
    while depth < BITS:
        deep = min(depth + STEP, BITS)
        sums = stored(
            open_rows.groupBy(_prefix(deep).alias("prefix")).agg(F.sum("bytes").alias("bytes")), "bucket-sums"
        )
        levels = []
        for bits in range(depth + 1, deep + 1):
            level = sums.groupBy(F.shiftright("prefix", deep - bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
            levels.append(level.select(F.lit(bits).alias("depth"), "prefix", "bytes"))
        table = stored(reduce(DataFrame.unionByName, levels), "bucket-levels")
        # a bucket is one if it fits and the bucket that it was split from didn't
        parent = table.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        fits = table.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        split = fits.where(F.col("depth") > depth + 1).join(
            parent, (fits["depth"] == parent["depth"]) & (F.shiftright("prefix", 1) == F.col("above")), "left_semi"
        )
        done.append(fits.where(F.col("depth") == depth + 1).unionByName(split))
        over = stored(table.where((F.col("depth") == deep) & (F.col("bytes") > limit)).select(F.col("prefix").alias("over")), "oversized")
        if deep == BITS or over.isEmpty():
            break
        open_rows = beside(open_rows.withColumn("over", _prefix(deep)), over, "over", "left_semi").drop("over")
        depth = deep
    return stored(reduce(DataFrame.unionByName, done), "directory")


def shards(rows: DataFrame, limit: int, key: str, size: Column, row: Column | None = None) -> DataFrame:
    """`rows` with shard (its prefix as bits, '' for the whole), shard_depth, shard_bytes; columns so named are replaced.

    A bucket splits on the next bit of its rows' addresses only while it holds more than `limit` bytes. Rows of one key
    stay together unless they alone exceed the limit: behind the key's 44 bits an address has 16 of `row` (all columns,
    if not given), so a hot key is split, told by a shard_depth beyond 44. Only rows that are equal in both, or one row
    with more bytes than the limit, make a shard that exceeds it, told by shard_bytes. Null keys count as one key. Empty
    tables give no rows.
    """
    taken = {"shard", "shard_depth", "shard_bytes"}
    kept = [c for c in rows.columns if c.lower() not in taken]
    row = F.to_json(F.struct(*kept)) if row is None else row
    placed = rows.select(*kept, address(key, row).alias("__address"), F.coalesce(size, F.lit(0)).cast("long").alias("__bytes"))
    sizes = stored(placed.select(F.col("__address").alias("address"), F.col("__bytes").alias("bytes")), "addresses")
    book = directory(sizes, limit)
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    # a row's shard is the one bucket that is a prefix of its address; it is looked up depth by depth
    found = []
    for depth in sorted(r[0] for r in book.select("depth").distinct().collect()):  # at most BITS values
        bucket = F.struct(name.alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"))
        found.append(f"__bucket{depth}")
        level = stored(book.where(F.col("depth") == depth).select(F.col("prefix").alias("__prefix"), bucket.alias(found[-1])), "directory-level")
        placed = beside(placed.withColumn("__prefix", _prefix_of("__address", depth)), level, "__prefix", "left").drop("__prefix")
    if not found:
        return placed.select(*kept, F.lit("").alias("shard"), F.lit(0).alias("shard_depth"), F.lit(0).cast("long").alias("shard_bytes"))
    return placed.withColumn("__bucket", F.coalesce(*found)).select(*kept, "__bucket.shard", "__bucket.shard_depth", "__bucket.shard_bytes")


def write_shards(
    rows: DataFrame, limit: int, key: str, size: Column, folder: str | None = None, row: Column | None = None
) -> str:
    """Writes rows as Parquet, one directory a shard, and returns the folder (new in the shared folder if not given)."""
    folder = folder or shared_folder(rows.sparkSession, "shards")
    # a directory's name can't be empty
    out = shards(rows, limit, key, size, row).withColumn("bucket", F.concat(F.lit("b"), "shard"))
    out.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    return folder
