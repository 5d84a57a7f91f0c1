"""The text of an invoice's line is made of its row, before lines are grouped."""

from __future__ import annotations

import datetime

from invoicelake.catalog import corpus as C


def test_line_texts_are_made_of_rows(spark, tmp_path):
    day = datetime.date(2024, 3, 1)
    orders = spark.createDataFrame([(8, 5, day, 7.5), (9, 5, day, 1.0)], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double")
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double"
    lines = spark.createDataFrame([(8, 7, 3, 2, "R", 2.0, 3.0), (8, 6, 4, 1, "N", 3.0, 4.5), (8, 6, 4, 1, None, None, None)], kinds)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    billed = {r["k"]: [i["line"] for i in r["items"]] for r in C.billed_orders(spark, str(tmp_path), texts=True).collect()}
    assert billed == {8: ["", "Part#000006 N\x1f3\x1f1.50\x1f4.50", "Part#000007 R\x1f2\x1f1.50\x1f3.00"], 9: []}
    plain = C.billed_orders(spark, str(tmp_path)).schema["items"].dataType.elementType
    assert "line" not in plain.names
    text = {r["doc_id"]: r["raw_text"] for r in C.rendered_invoices(spark, str(tmp_path)).collect()}
    assert "\n\nPart#000006 N   3   1.50   4.50\nPart#000007 R   2   1.50   3.00\n" in text[8] and "Supplier#000000003" in text[8]
    assert "Description" not in text[9] and "Unbilled Trading" in text[9]
