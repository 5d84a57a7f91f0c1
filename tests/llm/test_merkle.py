"""Merkle proofs against a plain construction."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from invoicelake.llm.merkle import fold, merkle_proofs, siblings
from invoicelake.llm.queries import op13_merkle_proofs
from tests.llm.corpus import LOWER, odd_texts, prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, nodes string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(level: list[str]) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """The last node, and for each of the first nodes its runs on the way up with its place in each."""
    at, ways = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, place in enumerate(at):
            ways[k].append((runs[place // 16], place % 16))
        at, level = [p // 16 for p in at], [h(*r) for r in runs]
    return level[0], ways


def expected(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of all rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        keyed = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        leaves = [leaf(r[0], r[3], r[2], r[4], r[1]) for r in keyed]
        trees.append((keyed, leaves, *climb(leaves)))
    root, tops = climb([t[2] for t in trees]) if trees else (None, [])
    out = []
    for (keyed, leaves, subroot, ways), top in zip(trees, tops, strict=True):
        for r, own, way in zip(keyed, leaves, ways, strict=True):
            full = way + top
            proof = "".join("".join(run[:k] + run[k + 1 :]) for run, k in full)
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r[0], r[3], r[2], r[4], r[1].translate(LOWER))
            for run, k in full:
                node = h(*run[:k], node, *run[k + 1 :])
            out.append((r[0], own, subroot, root, h(proof), node, node == root))
    return sorted(out, key=str)


def found(spark, tmp_path, rows):
    folder = tmp_path / "tables"
    data = [(*r, "old", "old", "old") for r in rows]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in op13_merkle_proofs(spark, str(folder)).collect()), key=str)


def table(groups: dict[str | None, int]) -> list[tuple]:
    rows, doc_id = [], 100
    for name, n in groups.items():
        for _ in range(n):
            doc_id = (doc_id * 7919 + 13) % 1_000_003
            rows.append((doc_id, f"Text {doc_id} Of {name}", "en", name, doc_id % 50))
    return rows


@pytest.mark.parametrize(
    "groups",
    [
        {"hot": 700, "b": 1, None: 17, "": 16, "é": 33, "Z": 257, "a": 2},  # trees of all heights, null before empty
        {f"s{k}": 1 + k % 2 for k in range(300)},  # a high tree over the sources
        {"only": 300},
        {"only": 1},
        {None: 5},
        {"a": 1, "b": 1},
        {"a": 4400, "b": 3},  # four levels and more
    ],
    ids=["mixed", "many", "one", "leaf", "null", "two", "high"],
)
def test_equals_plain_construction(spark, tmp_path, groups):
    rows = table(groups)
    assert found(spark, tmp_path, rows) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(i, t, None if k % 2 else "de", "s" if k % 3 else None, None if k % 5 == 0 else k) for k, (i, t) in enumerate(odd_texts())]
    rows += [(7, "Equal Row", "en", "s", 9)] * 20 + [(None, "No Key", None, "s", None)] * 3
    rows += [(55, "ÀÉ A-Z İ " + " ".join(prose(1, 20_000)), "en", "S", 1)]
    assert found(spark, tmp_path, rows) == expected(rows)


def test_no_rows(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


def test_proofs_carry_the_siblings(spark):
    rows = table({"a": 40, "b": 2})
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    proofs = merkle_proofs(docs, altered={"text": F.concat("text", F.lit("!"))})
    out = proofs.select(
        "*", fold(F.col("leaf"), F.col("proof")).alias("good"), fold(F.col("altered_leaf"), F.col("proof")).alias("bad"), siblings(F.col("proof")).alias("all")
    ).collect()
    assert len(out) == 42
    for r in out:
        assert r["good"] == r["root"] != r["bad"]
        assert len(r["proof"]) == (3 if r["source"] == "a" else 2) and len(r["all"]) % 64 == 0
    assert merkle_proofs(docs).where("altered_leaf IS NOT NULL").count() == 0
