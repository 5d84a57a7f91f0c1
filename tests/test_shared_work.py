"""What the extraction of many texts must not do for each of them, with the same results."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from invoicelake.catalog import queries as Q
from invoicelake.functions.columns import first_where
from invoicelake.operators import entities as E
from invoicelake.plans.extraction import first_name_line, suffix_line


def test_a_bucket_fits_a_task():
    assert Q._buckets(0) == Q._buckets(150_000) == 16
    assert Q._buckets(9_000_000) == 90
    assert Q._buckets(10**9) == 512


def test_bucketed_tags_have_buckets_for_their_documents(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"Acme {i} Ltd\nTotal: ${i}.50") for i in range(90)], "doc_id bigint, raw_text string")
    monkeypatch.setattr(Q.C, "rendered_invoices", lambda *_: docs)
    monkeypatch.setattr(Q, "BUCKET_DOCUMENTS", 4)
    _, spans, tokens = Q._bucketed_tags(spark, "unused")
    for table in (spans, tokens):
        name = re.search(r"default\.(\w+)", table._jdf.queryExecution().analyzed().toString())[1]
        kept = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        assert kept["Num Buckets"] == "23"
        assert table.select("doc_id").distinct().count() == 90


def test_the_first_hit_ends_the_search(spark):
    lines = spark.createDataFrame([(["ok", "bad"],), (["no", "no", "ok", "no", "bad"],), (["no"] * 9 + ["ok"],), ([],), (None,)], "l array<string>")

    def test(x):
        return F.when(x == "bad", F.raise_error(F.lit("looked too far")).cast("boolean")).otherwise(x == "ok")

    got = [r.hit for r in lines.select(first_where(F.col("l"), test, 9).alias("hit")).collect()]
    assert got == ["ok", "ok", None, None, None]


def test_vendor_lines_anywhere_in_the_head(spark):
    cases = [
        ("x\n  Kiln Ltd \nOther GmbH", "Kiln Ltd", None), ("a\nb\nc\nd\ne\nf Clay AG", "f Clay AG", None), ("Private\nLimited", "Limited", "Private"),
        ("12-3\nInvoice\n  \nabcde", None, "abcde"), ("", None, None), ("\n" * 30 + "Late Ltd", None, None),
    ]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    rows = docs.select("i", suffix_line(F.col("t")).alias("s"), first_name_line(F.col("t")).alias("f")).orderBy("i").collect()
    assert [(r.s, r.f) for r in rows][3:] == [(s, f) for _, s, f in cases][3:]
    assert [r.s for r in rows] == [s for _, s, _ in cases]


def test_numbers_are_cut_without_the_span_patterns(spark):
    text = "A1 12 12.50 1.2.2024 $ 5 $5 USD 7 USD7 ١٢ €3 Kiln Ltd 12, 3.4.5 x"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, raw_text string")
    spans = [(r.start_tok, r.label, r.text) for r in E.tag_entities(docs).orderBy("start_tok").collect()]
    assert spans == [
        (1, "CARDINAL", "12"), (2, "CARDINAL", "12.50"), (3, "DATE", "1.2.2024"), (4, "MONEY", "$ 5"), (6, "MONEY", "$5"), (8, "MONEY", "USD 7"),
        (11, "CARDINAL", "١٢"), (12, "MONEY", "€3"), (14, "ORG", "Kiln Ltd"), (16, "CARDINAL", "12"), (18, "CARDINAL", "3.4.5"),
    ]


@pytest.mark.parametrize("window", [6, 8, 11])
def test_confidences_of_gaps_are_those_of_the_formula(spark, window):
    gaps = spark.range(window).withColumn("gap", F.col("id").cast("int"))
    rows = gaps.select(E._near_confidence(F.col("gap"), F.lit(window)).alias("a"), E.near_confidences(window)[F.col("gap")].alias("b")).collect()
    assert len(rows) == window and all(r.a == r.b for r in rows)


def test_tables_are_not_sorted_by_an_interpreted_comparison(spark):
    docs = spark.createDataFrame([(1, "Kiln Ltd\nTotal: $3.50")], "doc_id bigint, raw_text string")
    rows = E.tagged_rows(E.tokens(docs), E.tag_entities(docs))
    assert "array_sort" not in rows._jdf.queryExecution().optimizedPlan().toString()
