"""Hard negatives: positives' upper limits split the scores into slots; the best of each slot answer all windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoicelake.llm.common import small_batches, stored

#: Positives of an anchor, negatives of a window, per cent of the positive's score that a negative must have.
POSITIVES, NEGATIVES, LOWEST = 5, 5, 80
#: Anchors of a block, parts that the rows are dealt to for each block, rows that are scored at a time.
BLOCK, PARTS, ROWS = 4096, 64, 512
#: Scores beyond this size are taken as this size.
MOST = 1 << 53
_PACKED = "wide int, ids binary, labels binary, values binary"


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole-number vectors of a batch (vec_id, label, vector); shorter vectors end in zeros."""
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(ids), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    small = np.abs(out).max(initial=0) < 1 << 24
    return ids, labels, out.astype(np.float32) if small else out


def packed(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector) as blocks of one row each: width of the vectors, and ids, labels and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, values = _vectors(batch)
            made = [x.tobytes() for x in (ids, labels, values)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([values.shape[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in made)],
                names=["wide", "ids", "labels", "values"],
            )

    small_batches(rows.sparkSession)
    return rows.select("vec_id", "label", "vector").mapInArrow(run, _PACKED)


def _block(ids: bytes, labels: bytes, values: bytes, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.float64 if len(values) == 8 * wide * len(own) else np.float32
    return own, np.frombuffer(labels, np.int64), np.frombuffer(values, kind).reshape(len(own), wide)


def scores_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exact; the narrower matrix ends in zeros."""
    wide = min(left.shape[1], right.shape[1])
    left, right = left[:, :wide], right[:, :wide]
    size = wide * (float(np.abs(left).max(initial=0)) + 1) * (float(np.abs(right).max(initial=0)) + 1)
    if size < MOST:
        kind = np.float32 if size < 1 << 24 else np.float64
        return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(len(m), wide) for m in (left, right)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, by score and then smaller id; in order."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[rank < k]


Select = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _scored(pairs: DataFrame, select: Callable[[bytes, np.ndarray, np.ndarray], Select], slots: int, k: int) -> DataFrame:
    """Rows (anchor_id, slot, score, vec_id): for each anchor and slot the k best of the rows that `select` takes.

    `pairs` has a block of anchors and a block of rows. Each task combines what it finds; a last window over the tasks'
    results, at most k of each task, keeps the k best of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def combined() -> tuple[np.ndarray, ...]:
            anchor, slot, score, ids = (np.concatenate([h[c] for h in held]) for c in range(4))
            # anchors are told apart by their place among the distinct ones, so that anchor and slot fit one number
            group = np.unique(anchor, return_inverse=True)[1] * slots + slot
            best = _best(group, score, ids, k)
            return anchor[best], slot[best], score[best], ids[best]

        for batch in batches:
            for row in batch.to_pylist():
                anchors, labels, vectors = _block(row["a_ids"], row["a_labels"], row["a_values"], row["a_wide"])
                ids, other, values = _block(row["ids"], row["labels"], row["values"], row["wide"])
                choose = select(row.get("limits"), anchors, labels)
                for a in range(0, len(ids), ROWS):
                    part = slice(a, a + ROWS)
                    at, slot, place, score = choose(scores_of(vectors, values[part]), ids[part], other[part])
                    best = _best(at * slots + slot, score, ids[part][place], k)
                    held.append((anchors[at[best]], slot[best], score[best], ids[part][place[best]]))
                    size += len(best)
                if size > 1 << 20:  # combine, so that a task holds few rows besides the k best of its anchors
                    held = [combined()]
                    size = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in combined()], names=["anchor_id", "slot", "score", "vec_id"])

    found = pairs.mapInArrow(run, "anchor_id bigint, slot bigint, score bigint, vec_id bigint")
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _positives(limits: bytes | None, anchors: np.ndarray, labels: np.ndarray):
    def choose(scores: np.ndarray, ids: np.ndarray, other: np.ndarray):
        at, place = np.nonzero((labels[:, None] == other[None, :]) & (anchors[:, None] != ids[None, :]))
        return at, np.zeros(len(at), np.int64), place, scores[at, place]

    return choose


def _negatives(limits: bytes, anchors: np.ndarray, labels: np.ndarray):
    """`limits` has the distinct upper limits of each anchor from the highest, filled up with the lowest."""
    upper = np.frombuffer(limits, np.int64).reshape(len(anchors), -1)
    lowest, last = -(-LOWEST * upper[:, -1] // 100), (upper > upper[:, -1:]).sum(axis=1)

    def choose(scores: np.ndarray, ids: np.ndarray, other: np.ndarray):
        at, place = np.nonzero(
            (labels[:, None] != other[None, :]) & (scores <= upper[:, :1]) & (scores >= lowest[:, None])
        )
        score = scores[at, place]
        # a slot holds the scores from its upper limit down to the next lower one
        slot = (upper[at] >= score[:, None]).sum(axis=1) - 1
        return at, np.minimum(slot, last[at]), place, score

    return choose


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & whole


def _anchor_blocks(anchors: DataFrame, limits: bool) -> DataFrame:
    """Anchors (vec_id, label, vector, block and, asked for, limits) as one row a block and part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, lists = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                own = lists.slice(k, 1).flatten()
                rows = pa.RecordBatch.from_arrays([own.field(c) for c in range(own.type.num_fields)], names=[f.name for f in own.type])
                ids, labels, values = _vectors(rows)
                made = [pa.array([values.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, values))]
                if limits:
                    made.append(pa.array([np.array(rows.column(3).to_pylist(), np.int64).tobytes()], pa.binary()))
                names = ["block", "a_wide", "a_ids", "a_labels", "a_values", "limits"]
                yield pa.RecordBatch.from_arrays([blocks.slice(k, 1), *made], names=names[: len(made) + 1])

    columns = ["vec_id", "label", "vector", *(["limits"] if limits else [])]
    # blocks have about BLOCK anchors each, as they are dealt by a hash of ids that don't repeat
    blocks = anchors.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    schema = "block bigint, a_wide int, a_ids binary, a_labels binary, a_values binary" + (", limits binary" if limits else "")
    return stored(blocks.mapInArrow(run, schema), "anchor-blocks").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")).alias("part")
    )


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id and both scores.

    A component x counts as floor(256 * x); a score is the inner product of whole numbers, so it is exact. Higher scores
    come first, ties by the smaller id. The positives of an anchor are its first 5 other rows of the same label; the
    negatives of a positive with score p are the first 5 rows of another label with 80 * p <= 100 * score <= 100 * p.
    Fewer are returned if there are fewer; a negative p has none. `label` gives labels other than the column `label`;
    `is_anchor` and `label` are expressions over the columns of `vectors`.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that repeat an id the
    one with the smallest label, then the smallest vector, counts. Vectors of unequal length are compared as if the
    shorter one ended in zeros; an empty vector scores 0. Scores beyond 2 ** 53 count as 2 ** 53. Tables without
    anchors, positives or negatives give no rows. Other columns are not looked at.

    Anchors form blocks of about 4,096, rows blocks of at most 1,000; every block of rows meets every block of anchors
    once for positives and once for negatives, as matrices, dealt over 64 parts a block of anchors. The positives' scores
    are upper limits that split the scores of an anchor into disjoint slots. Tasks keep the best 5 of each slot, and the
    window of a positive is answered by its slot and those below: merged from the highest score down, cut at the lowest.
    """
    spark = vectors.sparkSession
    of = F.col("label") if label is None else label
    rows = (
        vectors.select(
            F.col(key).cast("long").alias("vec_id"), of.cast("long").alias("label"),
            F.col(vector).alias("vector"), is_anchor.alias("anchor"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
        .select("vec_id", "row.label", "row.vector", F.coalesce("row.anchor", F.lit(False)).alias("anchor"))
    )
    rows = stored(rows, "vectors")
    chosen = rows.where("anchor")
    blocks = max(1, -(-chosen.count() // BLOCK))
    chosen = chosen.select("vec_id", "label", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    dealt = stored(packed(rows), "row-blocks").select(
        F.pmod(F.xxhash64("ids"), F.lit(PARTS)).alias("part"), "wide", "ids", "labels", "values",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
    )
    small_batches(spark)

    def met(anchors: DataFrame) -> DataFrame:
        return dealt.join(anchors, ["block", "part"]).drop("block", "part")

    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"))  # at most 5 rows
    positives = stored(
        _scored(met(_anchor_blocks(chosen, False)), _positives, 1, POSITIVES)
        .select("anchor_id", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
        .where("positive_score >= 0")
        .withColumn("slot", F.dense_rank().over(by_score) - 1),
        "positives",
    )
    # the distinct upper limits of an anchor from the highest, filled up with the lowest, which adds empty slots only
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_set("positive_score"), asc=False).alias("own")
    )
    filled = F.concat("own", F.array_repeat(F.element_at("own", -1), F.lit(POSITIVES) - F.size("own"))).alias("limits")
    limited = chosen.join(limits, "vec_id").select("vec_id", "label", "vector", "block", filled)
    found = _scored(met(_anchor_blocks(limited, True)), _negatives, POSITIVES, NEGATIVES)
    best = found.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("vec_id").alias("id"), "slot"))).alias("best")
    )
    # a window is its own slot and all below, merged from the highest score on
    merged = F.slice(F.filter("best", lambda x: x["slot"] >= F.col("slot")), 1, NEGATIVES)
    window = F.filter(merged, lambda x: -100 * x["down"] >= LOWEST * F.col("positive_score"))
    return (
        positives.join(best, "anchor_id")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "x"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("x.id").alias("negative_id"),
            "positive_score",
            (-F.col("x.down")).alias("negative_score"),
        )
    )
