"""Merkle manifest of a table: trees of runs per group, a tree over the groups, proofs by pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoicelake.llm.common import stored

#: Consecutive nodes of a run, which become one node of the next level.
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: From this distance on many nodes point to one ancestor; such ancestors are few and are dealt out to so many parts.
FAR, PARTS = 4, 64
#: The tree over the groups; the groups' own trees are numbered from 0.
_TOP = -1
_KEY = ("tree", "level", "idx")
_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: `-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    shown = []
    for field in fields:
        value = field.cast("string")
        shown.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return digest(*shown)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a path as one text, from the leaf's run to the root's, each run from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with their place `idx` (from 0) within a group and the group's size `n`.

    Rows are sorted by range over all tasks, so one group may hold most of them; what is added up per group is one
    number of each task that has rows of it.
    """
    by = [group, *order]
    at = F.monotonically_increasing_id()
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at), "sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    pieces = placed.groupBy(group, "part").agg(F.count("*").alias("have"), F.min("place").alias("first"))
    own = Window.partitionBy(group)
    before = F.sum("have").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(
        group, "part", F.sum("have").over(own).alias("n"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")
    )
    return placed.join(pieces, [group, "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop(
        "at", "part", "place", "shift"
    )


def _run_of(place: Column) -> Column:
    return F.shiftright(place, FAN_BITS)


def _runs(n: Column) -> Column:
    """How many runs n nodes make."""
    return F.shiftright(n + (FAN - 1), FAN_BITS)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["hash"]), "")


def _step(nodes: Column, k: Column) -> Column:
    """The siblings to the left and to the right of the node at place k (from 0) of a run."""
    return F.struct(
        _joined(F.slice(nodes, F.lit(1), k)).alias("left"),
        _joined(F.slice(nodes, k + 2, F.lit(FAN))).alias("right"),
    )


def _levels(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame, int]:
    """The tree above `nodes` (tree, idx, n, hash: all nodes of a level), built level by level.

    Returns the edges (key of a node, key of its parent, step), the last nodes (tree, level, hash), one a tree, and
    the highest level. A level has a sixteenth of the rows of the one below.
    """
    edges: DataFrame | None = None
    tops = None
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        done = nodes.where("n = 1").select("tree", F.lit(level).alias("level"), "hash")
        tops = done if tops is None else tops.unionByName(done)
        if most <= 1:
            return edges, tops, level
        runs = stored(
            nodes.where("n > 1")
            .groupBy("tree", _run_of(F.col("idx")).alias("idx"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("nodes"), _runs(F.max("n")).alias("n")),
            "runs",
        )
        pairs = runs.select(
            "tree", F.lit(level).alias("level"), F.posexplode("nodes").alias("k", "node"), "nodes", F.col("idx").alias("up_idx")
        ).select(
            "tree", "level", F.col("node.idx").alias("idx"),
            F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), "up_idx",
            F.array(_step(F.col("nodes"), F.col("k"))).alias("steps"), F.lit(None).cast("string").alias("subroot"),
        )
        edges = pairs if edges is None else edges.unionByName(pairs)
        nodes = runs.select("tree", "idx", "n", F.sha2(_joined(F.col("nodes")), 256).alias("hash"))
        level, most = level + 1, -(-most // FAN)


def _jumped(pointers: DataFrame, root: tuple[int, int], depth: int) -> DataFrame:
    """Pointers (key, up key, steps, subroot) of all nodes to their parents, made to point to the root.

    Each round joins the pointers with themselves: a node takes over the pointer of the node that it points to, with
    its steps behind its own, so distances double. Those that have reached the root leave the join, as all of them
    would share one key; the few far ancestors with many rows below them are dealt out to several parts.
    """
    arrived = (F.col("up_tree") == root[0]) & (F.col("up_level") == root[1])
    distance = 1
    while distance < depth:
        parts = PARTS if distance >= FAR else 1
        there = pointers.where(arrived)
        part = F.pmod(F.xxhash64(*_KEY), F.lit(parts)).alias("part")
        on = pointers.where(~arrived).select("*", part)
        far = pointers if distance < FAR else pointers.join(
            on.select(*[F.col(f"up_{c}").alias(c) for c in _KEY]).distinct(), list(_KEY), "left_semi"
        )
        far = far.select(
            *[F.col(c).alias(f"up_{c}") for c in _KEY],
            *[F.col(f"up_{c}").alias(f"next_{c}") for c in _KEY],
            F.col("steps").alias("more"),
            F.col("subroot").alias("above"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).alias("part"),
        )
        moved = on.join(far, [*(f"up_{c}" for c in _KEY), "part"]).select(
            *_KEY,
            *[F.col(f"next_{c}").alias(f"up_{c}") for c in _KEY],
            F.concat("steps", "more").alias("steps"),
            F.coalesce("subroot", "above").alias("subroot"),
        )
        pointers = stored(there.unionByName(moved), "pointers")
        distance *= 2
    return pointers


def merkle_proofs(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row of `docs`: doc_id, source (the columns `key` and `group`), leaf, altered_leaf, subroot, root, proof.

    A leaf is the digest of the row's fields. The leaves of a group, by key, make its tree: every 16 consecutive nodes
    become one, until one is left, the subroot; the subroots by group make the tree over all, up to the root. `proof`
    lists the siblings of each run of a leaf's way to the root, as texts of those to its left and to its right; `fold`
    gives the root from it. `altered` replaces fields for altered_leaf, which is the leaf of a row as found later.

    Groups come in the order of their UTF-8 bytes, the null group first and apart from an empty name; null keys come
    first in their group, rows of equal keys in the order of their leaves. Repeated rows are leaves each. A null group
    with one row, or any other, has that leaf as its subroot; with one group the root is its subroot, and a table of
    one row has an empty proof. An empty table gives no rows. Columns that no field names are not looked at.

    The texts are read once and never shuffled; what moves is digests. Proofs are put together for the runs, a
    sixteenth of the rows, and only then handed to the leaves of a run, within their task.
    """
    now = {f: F.col(f) for f in fields}
    changed = F.lit(None).cast("string")
    if altered:
        changed = leaf_digest([altered.get(f, now[f]) for f in fields])
    leaves = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            # groups as texts that sort as they should; the null group is the empty text
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("home"),
            leaf_digest([now[f] for f in fields]).alias("leaf"),
            changed.alias("altered_leaf"),
        ),
        "leaves",
    )
    ranked = _ranked(leaves.withColumn("row", F.monotonically_increasing_id()), "home", ["doc_id", "leaf", "row"])
    member = F.struct("idx", "doc_id", F.col("leaf").alias("hash"), "altered_leaf")
    lowest = stored(
        ranked.groupBy("home", _run_of(F.col("idx")).alias("run"))
        .agg(F.array_sort(F.collect_list(member)).alias("nodes"), F.max("n").alias("n_leaves")),
        "lowest-runs",
    )
    groups = _ranked(lowest.where("run = 0").select(F.lit(0).alias("all"), "home"), "all", ["home"])
    groups = stored(groups.select("home", F.col("idx").alias("tree"), F.col("n").alias("n_trees")), "groups")
    # a run over is the first node of level 1; the only leaf of a group stands there as it is
    over = F.when(F.col("n_leaves") > 1, F.sha2(_joined(F.col("nodes")), 256)).otherwise(F.col("nodes")[0]["hash"])
    lowest = _spread_join(lowest, groups)
    first = stored(lowest.select("tree", F.col("run").alias("idx"), _runs(F.col("n_leaves")).alias("n"), over.alias("hash")), "nodes")
    edges, subroots, level = _levels(first, 1)
    depth = level - 1
    n_trees = groups.agg(F.max("n_trees")).first()[0] or 0
    subroots = stored(subroots, "subroots")
    if n_trees > 1:
        tops = subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "hash")
        above, last, top_level = _levels(tops, level)
        depth += top_level - level
        # a subroot stands in both trees: its edge upwards starts at its place in the group's own
        own = subroots.select(F.col("tree").alias("idx"), F.col("tree").alias("own_tree"), F.col("level").alias("own_level"), F.col("hash").alias("own"))
        lifted = (
            above.where(F.col("level") == level).drop("subroot").join(own, "idx")
            .select(
                F.col("own_tree").alias("tree"), F.col("own_level").alias("level"), F.lit(0).cast("long").alias("idx"),
                "up_tree", "up_level", "up_idx", "steps", F.col("own").alias("subroot"),
            )
        )
        above = above.where(F.col("level") > level).unionByName(lifted)
        edges = above if edges is None else edges.unionByName(above)
        root_at = (_TOP, top_level)
    else:
        last, root_at = subroots, (0, level)
    top = last.select("hash").first()
    root = F.lit(top[0] if top else None).cast("string")
    nothing = F.array().cast(f"array<{_STEP}>")
    runs = lowest.select("tree", F.lit(1).alias("level"), F.col("run").alias("idx"), "home", "nodes", "n_leaves")
    if edges is None:
        runs = runs.select("*", nothing.alias("steps"), F.lit(None).cast("string").alias("subroot"))
    else:
        paths = _jumped(stored(edges, "edges"), root_at, depth)
        runs = runs.join(paths.where("level = 1").select(*_KEY, "steps", "subroot"), list(_KEY), "left")
    step = F.when(F.col("n_leaves") > 1, F.array(_step(F.col("nodes"), F.col("k")))).otherwise(nothing)
    return runs.select("*", F.posexplode("nodes").alias("k", "node")).select(
        F.col("node.doc_id").alias("doc_id"),
        F.when(F.col("home") != "", F.substr("home", F.lit(2))).alias("source"),
        F.col("node.hash").alias("leaf"),
        F.col("node.altered_leaf").alias("altered_leaf"),
        F.coalesce("subroot", root).alias("subroot"),
        root.alias("root"),
        F.concat(step, F.coalesce("steps", nothing)).alias("proof"),
    )


def _spread_join(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Runs with the tree of their group. One group may hold most runs, so groups are dealt out to several parts."""
    part = F.pmod(F.col("run"), F.lit(PARTS)).alias("part")
    # a group is needed in as many parts as it can have runs in
    dealt = groups.join(runs.where("run = 0").select("home", _runs(F.col("n_leaves")).alias("runs")), "home").select(
        "home", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("runs"), F.lit(PARTS)) - 1)).alias("part")
    )
    return stored(runs.select("*", part).join(dealt, ["home", "part"]).drop("part"), "placed-runs")
