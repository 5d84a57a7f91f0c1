"""Reports and sinks: items, ranks, conflicts, days."""

import random
from collections import Counter

from pyspark.sql import functions as F

from invoicelake.catalog import queries as Q
from invoicelake.operators.intake import admit
from invoicelake.operators.reports import conflict_report, item_differences, write_review
from invoicelake.sources.readers import read_files
from invoicelake.sources.writers import write_intake

ITEMS = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"


def brute(got, want):
    got, want = Counter(got or []), Counter(want or [])
    matched = sum((got & want).values())
    left, right = got - want, want - got
    names = lambda c: Counter(x[0] for x in c.elements())
    changed = sum((names(left) & names(right)).values())
    return matched, changed, sum(right.values()) - changed, sum(left.values()) - changed


def test_item_differences_equal_brute_force(spark):
    rng = random.Random(3)
    item = lambda: (rng.choice(["a", "b", "c", None]), rng.choice([1.0, None]), 2.0, rng.choice([2.0, 3.0]))
    rows = [(k, [item() for _ in range(rng.randint(0, 8))], [item() for _ in range(rng.randint(0, 8))]) for k in range(300)]
    rows += [(900, None, [("a", 1.0, 1.0, 1.0)]), (901, None, None), (902, [], [])]
    frame = spark.createDataFrame(rows, f"k int, got {ITEMS}, want {ITEMS}")
    out = {r.k: tuple(r.d) for r in frame.select("k", item_differences(F.col("got"), F.col("want")).alias("d")).collect()}
    assert out == {k: brute(got, want) for k, got, want in rows}


def test_review_ranks(spark, tmp_path):
    rows = [(k, round((k * 37 % 100) / 100, 2)) for k in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, overall_confidence double")
    got = sorted((r["rank"], r.doc_id) for r in write_review(frame, str(tmp_path / "r"), 0.6).collect())
    want = [k for k, c in sorted(rows, key=lambda x: (x[1], x[0])) if c < 0.6]
    assert got == list(enumerate(want, 1))
    assert write_review(frame, str(tmp_path / "none"), -1.0).count() == 0


def test_review_queue_extracts_once(spark, monkeypatch):
    """Sorting reads its input once more, so the rows are written before."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(k, round((k * 37 % 100) / 100, 2)) for k in range(500)]

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(rows, "doc_id long, overall_confidence double")
    monkeypatch.setattr(Q, "_results", lambda spark, sf_dir: frame.mapInArrow(count, frame.schema))
    got = [tuple(r) for r in Q.review_queue(spark, "").collect()]
    assert got == sorted([r for r in rows if r[1] < 0.6], key=lambda r: (r[1], r[0]))
    assert seen.value == len(rows)


def test_review_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = spark.range(100).selectExpr("id AS doc_id", "id / 200 AS overall_confidence")
    ranked = write_review(frame.mapInArrow(count, frame.schema), str(tmp_path / "once"), 0.6)
    assert ranked.count() == 100 and seen.value == 100


def test_conflicts(spark):
    claims = [(1, "f", "rule", "a"), (1, "f", "rule", "b"), (2, "f", "rule", "a"), (2, "f", "entity", "a"), (3, "f", "rule", "a"),
              (3, "f", "entity", "b"), (4, "f", "entity", "a"), (4, "f", "entity", "c"), (5, "g", "rule", "x")]
    frame = spark.createDataFrame(claims, "doc_id long, field string, by string, value string")
    assert {tuple(r) for r in conflict_report(frame).collect()} == {("f", 4, 1, 1, 1), ("g", 1, 0, 0, 0)}


def test_one_day_is_replaced_and_the_input_read_once(spark, tmp_path):
    rows = [(k, f"/in/{k}/a.pdf", 10 + k, bytearray(b"%PDF" if k % 2 else b"????"), f"2024-01-0{k % 3 + 1}") for k in range(30)]
    files = spark.createDataFrame(rows, "doc_id long, path string, length long, header binary, intake_day string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    admitted = admit(files.mapInArrow(count, files.schema))
    path = str(tmp_path / "lake")
    assert write_intake(admitted, path) == {"accepted": 15, "rejected": 15}
    assert seen.value == 30
    assert write_intake(admit(files.where("doc_id = 3 OR doc_id = 6")), path) == {"accepted": 1, "rejected": 1}
    back = {r.doc_id: r.outcome for r in spark.read.parquet(path).collect()}
    assert set(back) == {k for k in range(30) if k % 3} | {3, 6} and back[3] == "accepted"


def test_size_limit_reaches_the_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 10)
    (tmp_path / "b.txt").write_text("x" * 1000)
    files = read_files(spark, str(tmp_path), pattern="*.txt", max_bytes=100)
    assert "LessThanOrEqual(length,100)" in files._jdf.queryExecution().executedPlan().toString()
    assert [r.length for r in files.collect()] == [10]
