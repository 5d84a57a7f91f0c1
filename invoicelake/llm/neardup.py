"""MinHash near-duplicates: an LSH forest of sorted signature orders, exact confirmation, and an exact way for dense regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from invoicelake.llm.common import mix, shingles_of, slices, small_batches, stored, text_bytes, words_of
from invoicelake.llm.components import beside, connected

WIDTH = 5
#: Links have 100 * shared >= PERCENT * united shingles.
PERCENT = 75
#: Orders of the forest, values that neighbours share at least, further values (16 bits of each) that an order sorts by.
TREES, DEPTH, DEEPER = 32, 4, 4
VALUES = TREES * DEPTH
#: Neighbours before a row in an order that are its candidates.
NEIGHBOURS = 2
#: Parts that the nodes of one shingle are dealt to.
PARTS = 16

_RANDOM = np.random.default_rng(20240501)
_FACTOR = (_RANDOM.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_SHIFT = _RANDOM.integers(0, 2**32, VALUES, dtype=np.uint32)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts in a row, repeats included, and how many each text has."""
    hashes, _, _, bounds = words_of(*text_bytes(texts))
    return shingles_of(hashes, bounds, WIDTH)


def _prints(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    return int(own.sum()), int(np.bitwise_xor.reduce(own * (own | np.uint64(1))))


def _node() -> Column:
    return F.xxhash64("n_shingles", "print1", "print2").alias("node")


def signatures(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, text): size of its set of shingles, `node` (64-bit hash of the set), MinHash values as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                shingles, have = shingle_sets(part.column(1))
                first = np.cumsum(have) - have
                some = np.flatnonzero(have)
                values = np.full((len(have), VALUES), 2**32 - 1, np.uint32)
                if len(some):
                    short = (shingles >> np.uint64(32)).astype(np.uint32)
                    for k in range(VALUES):
                        values[some, k] = np.minimum.reduceat(short * _FACTOR[k] + _SHIFT[k], first[some])
                size, prints = np.zeros(len(have), np.int64), np.zeros((2, len(have)), np.uint64)
                for k in some.tolist():
                    own = np.unique(shingles[first[k] : first[k] + have[k]])
                    size[k], prints[:, k] = len(own), _prints(own)
                rows = pa.array([values[k].tobytes() for k in range(len(have))], pa.binary())
                made = [pa.array(size), *(pa.array(x.view(np.int64)) for x in prints), rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *made], names=["doc_id", "n_shingles", "print1", "print2", "values"]
                )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, print1 bigint, print2 bigint, values binary").select(
        "doc_id", "n_shingles", _node(), "values"
    )


def _orders() -> np.ndarray:
    """For each tree the values that it sorts by: DEPTH of its own, then DEEPER of those that follow."""
    return (np.arange(TREES)[:, None] * DEPTH + np.arange(DEPTH + DEEPER)) % VALUES


def forest(sets: DataFrame) -> DataFrame:
    """Rows (prefix, deeper, node, size) of all orders of (node, size, values); a prefix tells its order, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, VALUES)
            prefix = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(values), 1))
            for k in range(DEPTH):
                prefix = mix(prefix * np.uint64(0xD1342543DE82EF95) + values[:, orders[:, k]])
            deeper = np.zeros_like(prefix)
            for k in range(DEPTH, DEPTH + DEEPER):
                deeper = deeper << np.uint64(16) | (values[:, orders[:, k]] >> np.uint32(16)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(prefix.view(np.int64).ravel()),
                    pa.array(deeper.view(np.int64).ravel()),
                    *(pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), TREES)) for k in (0, 1)),
                ],
                names=["prefix", "deeper", "node", "size"],
            )

    return sets.select("node", "size", "values").mapInArrow(
        run, "prefix bigint, deeper bigint, node bigint, size bigint"
    )


def _neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the rows of sorted orders that share a prefix and stand next to each other.

    The orders are sorted by range over all tasks, so a large region is spread; rows at the ends of the tasks are
    compared by a second step, over two rows a task.
    """
    order = ["prefix", "deeper", "node"]
    names = ["a", "b", "size_a", "size_b", "task", "place", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, head, tail = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3)]
            old = len(tail[0]) if tail else 0
            if tail:
                rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
            prefix, node, size = rows
            head = head or [x[:NEIGHBOURS] for x in rows]
            tail = [x[-NEIGHBOURS:] for x in rows]
            found = []
            for back in range(1, NEIGHBOURS + 1):
                at = np.arange(max(back, old), len(node))
                at = at[(prefix[at] == prefix[at - back]) & (node[at] != node[at - back])]
                found.append((at, at - back))
            b, a = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            a, b = np.where(node[a] > node[b], b, a), np.where(node[a] > node[b], a, b)
            ints, none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (node[a], node[b], size[a], size[b])), ints, ints, none], names=names
            )
        if tail:
            prefix, node, size = (np.concatenate(x) for x in zip(head, tail, strict=True))
            n, none = len(node), pa.nulls(len(node), pa.int64())
            where = [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(prefix)]
            yield pa.RecordBatch.from_arrays([pa.array(node), none, pa.array(size), none, *where], names=names)

    found = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("prefix", "deeper", "node", "size").mapInArrow(
            run, "a bigint, b bigint, size_a bigint, size_b bigint, task int, place int, prefix bigint"
        ),
        "neighbours",
    )
    pairs = found.where("b IS NOT NULL").select("a", "b", "size_a", "size_b")
    before = Window.partitionBy("prefix").orderBy("task", "place")  # a few rows a task
    ends = found.where("b IS NULL").select("a", "size_a", "prefix", "task", "place")
    for back in range(1, 2 * NEIGHBOURS + 1):
        other = [F.lag(c, back).over(before).alias(n) for c, n in (("a", "b"), ("size_a", "size_b"))]
        pairs = pairs.unionByName(
            ends.select("a", "size_a", *other)
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "size_a", "size_b")
        )
    return pairs


def _could_link(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The whole sets of shingles of nodes (written: node, doc_id), once each: (node, shingles), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                shingles, have = shingle_sets(part.column(1))
                first = np.cumsum(have) - have
                own = [np.unique(shingles[a : a + n]) for a, n in zip(first, have, strict=True)]
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                prints = np.array([_prints(x) for x in own], np.uint64).reshape(-1, 2).view(np.int64)
                sizes = np.array([len(x) for x in own], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists],
                    names=["n_shingles", "print1", "print2", "shingles"],
                )

    wanted = beside(docs, nodes.select("doc_id"), "doc_id", "left_semi").mapInArrow(
        run, "n_shingles bigint, print1 bigint, print2 bigint, shingles array<bigint>"
    )
    sets = stored(beside(wanted.select(_node(), "shingles"), nodes.select("node"), "node", "left_semi"), "sets")
    if sets.count() > nodes.count():  # some row is repeated
        sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    return sets


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    united = F.size("left") + F.size("right") - F.col("shared")
    return (
        pairs.select("a", "b").join(left, "a").join(right, "b")
        .select("a", "b", F.size("left").alias("n1"), F.size("right").alias("n2"), shared.alias("shared"))
        .where(100 * F.col("shared") >= PERCENT * (F.col("n1") + F.col("n2") - F.col("shared")))
        .select("a", "b")
    )


def _rest(members: DataFrame, parts: DataFrame, sets: DataFrame, tested: DataFrame) -> DataFrame:
    """Further pairs to confirm in regions that neighbours did not settle, found by an exact filter.

    A region is settled if its members are one component, or two rows (they are neighbours). Similar sets share one of
    their rarest shingles: of a set of n, some of the n - ceil(n * PERCENT / 100) + 1 that come first by frequency. So
    sets meet only in those; members of a meeting's largest component are compared with the others, not with each other.
    """
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_regions = placed.groupBy("prefix").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("n > 2 AND low < high").select("prefix")
    nodes = stored(placed.join(open_regions, "prefix").select("node", "component").distinct(), "open-nodes")
    rows = nodes.join(sets, "node").select("node", F.explode("shingles").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = rows.join(counts, "shingle").select("node", F.struct("n", "shingle").alias("at"))
    size = F.size("shingles")
    # rows per node are bounded by its text; shingles that no other node has come first and can't be shared
    heads = (
        common.groupBy("node").agg(F.sort_array(F.collect_list("at")).alias("at"))
        .join(sets, "node").join(nodes, "node")
        .withColumn("size", size)
        .withColumn("lone", size - F.size("at"))
        .withColumn("width", size - F.ceil(size * F.lit(PERCENT) / 100).cast("int") + 1 - F.col("lone"))
        .where("width > 0")
        .select("node", "component", "size", "lone", F.posexplode(F.slice("at", F.lit(1), F.col("width"))).alias("place", "at"))
        .select("node", "component", "size", (F.col("lone") + F.col("place")).alias("place"), F.col("at.shingle").alias("shingle"))
    )
    heads = stored(heads, "heads")
    each = heads.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    largest = each.groupBy("shingle").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    # a shingle that many nodes have is dealt out; what it is joined with goes to all its parts
    dealt = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")).alias("part")
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part")
    met = stored(
        heads.select("*", part).join(largest.select("shingle", "main", dealt), ["shingle", "part"]), "met"
    )
    one = met.where("component <> main").select("shingle", dealt, *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "size", "place")])
    two = met.select("shingle", "part", "main", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "size", "place")])
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    pairs = (
        one.join(two, ["shingle", "part"])
        .where("component_a <> component_b AND (component_b = main OR node_a < node_b)")
        .where(_could_link("size_a", "size_b"))
        .where(left * (100 + PERCENT) >= PERCENT * (F.col("size_a") + F.col("size_b")))
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
    )
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, with other columns of `docs` left out.

    Words are runs of anything but the space and U+0009 to U+000D, A-Z in lower case; a set holds the distinct shingles
    of five words, or the whole text as one if it has fewer. Sets are linked if 100 * shared >= 75 * united;
    component_id is the smallest doc_id that links reach. Texts that are null or without words have an empty set, no
    link, and are their own component. Rows that repeat a doc_id are one node. Rows without a doc_id link to nothing,
    have a null component and are kept.

    Equal sets become one node first, so groups of copies of any size cost one row. Neighbours in the orders of the
    forest are confirmed on whole sets; where a region stays in several components, an exact filter on rare shingles
    finds the rest (`_rest`). A link is missed only if two similar sets share no prefix in any of the 32 orders: for
    a similarity of exactly 0.75 a chance of 5 in a million, far less above.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(source), "signatures")
    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(linkable.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    several = stored(classes.where("copies > 1").select("node", "first"), "several")
    rows = forest(
        beside(linkable, several, "node", "left")
        .where("first IS NULL OR first = doc_id")
        .select("node", F.col("n_shingles").alias("size"), "values")
    )
    shared = stored(
        rows.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "shared-prefixes"
    )
    members = stored(beside(rows, shared, "prefix", "left_semi").select("prefix", "deeper", "node", "size"), "members")
    pairs = stored(_neighbours(members).where(_could_link("size_a", "size_b")).select("a", "b").distinct(), "pairs")
    nodes = stored(
        members.select("node").distinct().join(classes, "node").select("node", F.col("first").alias("doc_id")), "nodes"
    )
    sets = sets_of(source, nodes)
    links = stored(confirmed(pairs, sets), "links")
    rest = stored(_rest(members, connected(links), sets, pairs), "rest")
    more = confirmed(rest, sets)
    same = linkable.select("doc_id", "node").distinct()
    lowest = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    texts = same.join(lowest.where("a < b"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    parts = connected(links.unionByName(more).unionByName(texts))
    roots = parts.join(classes, "node").groupBy("component").agg(F.min("first").alias("root"))
    of_class = (
        classes.join(parts.join(roots, "component").select("node", "root"), "node", "left")
        .select("node", F.coalesce("root", "first").alias("component_id"))
    )
    found = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", "n_shingles", "node").join(of_class, "node", "left").select(
        "doc_id",
        "n_shingles",
        found.alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that of the smallest doc_id.

    Rows without a doc_id stay, and so do texts without words. Of rows that repeat a doc_id one stays.
    """
    found = stored(near_duplicates(docs), "near-duplicates")
    gone = stored(found.where("NOT kept").select("doc_id").distinct(), "dropped")
    out = beside(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return out
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
