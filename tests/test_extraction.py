"""Whole documents, with and without entities, in batch and as a stream."""

import io
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from invoicelake.catalog import queries
from invoicelake.catalog.queries import QUERIES
from invoicelake.operators.entities import tag_entities, tokens
from invoicelake.operators.intake import admit
from invoicelake.operators.reports import coverage
from invoicelake.plans.extraction import INVOICE, PURCHASE_ORDER, RECEIPT, extract_documents, extract_invoices
from invoicelake.sources.readers import read_files, read_text_corpus
from invoicelake.streaming.extract import stream_extract

MILL = """\
INVOICE

Invoice No. MW/0932
Dated 03.11.2026
Invoice Date: 3 November 2026
Payment Due: 18 November 2026

Old Mill Weavers Inc.

Description              Qty   Unit Price   Amount
Wool blanket              12       31.50    378.00
Loom hire                  3       40.00    120.00

Subtotal:                                   498.00
Total Due: EUR 572.70
"""
TEXTS = {
    1: MILL,
    2: "Juniper   Freight   LLC\nlnv#:  JF-88\nT0tal  &  more\nNet  45\nsum  of  $  77.00\n",
    3: "",
    4: "\t\n  \n",
    5: "The heron stood in the reeds until dusk.",
    6: "Amount Due: €9.876,54",
    7: "Receipt K-3\nNet 15\nTotal: 64",
    8: "Total: 730\nMadrid",
    9: "Total: 8 317.09",
    10: "Due Date: 2027-01-09",
    11: "Subtotal: 70.00\nShipping: 5.50\nGrand Total: 75.50\n",
    12: None,
    13: "Description  Qty  Amount\nA\x1f5.00\nRope  2  9.00\n",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, raw_text string")


@pytest.fixture(scope="module")
def results(docs):
    return {r.doc_id: r for r in extract_invoices(docs).collect()}


def test_clean_invoice(results):
    r = results[1]
    f = r.fields
    assert (f.vendor_name, f.invoice_number, str(f.invoice_date), f.due_date, f.total_amount, f.currency) == (
        "Old Mill Weavers Inc.", "MW/0932", "2026-11-03", None, 572.7, "EUR")
    assert tuple(r.confidence) == (0.65, 0.95, 0.95, 0.0, 0.92, 0.65)
    assert [tuple(i) for i in f.line_items] == [("Wool blanket", 12.0, 31.5, 378.0), ("Loom hire", 3.0, 40.0, 120.0)]
    assert r.extraction_warnings == [] and r.overall_confidence == 0.82 and r.raw_text_length == len(MILL)


def test_noise_and_net_terms(results):
    f = results[2].fields
    assert (f.vendor_name, f.invoice_number, f.invoice_date, f.due_date, f.total_amount, f.currency) == (
        "Juniper Freight LLC", None, None, None, None, None)
    assert results[7].fields.due_date is None


def test_empty_and_prose(results):
    for key in (3, 4, 12):
        assert results[key].overall_confidence == 0.0 and results[key].fields.line_items == []
    assert results[5].confidence.vendor_name == 0.30 and results[5].extraction_warnings == []


def test_number_forms(results):
    assert (results[6].fields.total_amount, results[6].fields.currency) == (9876.54, "EUR")
    assert results[8].fields.total_amount == 730.0
    assert results[9].fields.total_amount == 8317.09
    assert results[10].fields.due_date is None
    assert results[11].fields.total_amount == 75.5 and results[11].overall_confidence == 0.64


def test_a_separator_character_alone_parts_no_cells(results):
    assert [i.description for i in results[13].fields.line_items] == ["Rope"]


def test_entities_raise_agreeing_fields(docs):
    fused = {r.doc_id: r for r in extract_invoices(docs, tag_entities(docs), tokens(docs)).collect()}
    r = fused[1]
    assert r.source.total_amount == "regex+nlp" and round(r.confidence.total_amount, 2) == 0.97
    assert r.source.vendor_name == "nlp" and r.confidence.vendor_name == 0.90
    assert fused[2].fields.total_amount == 77.0 and fused[2].source.total_amount == "nlp"
    assert set(fused) == set(TEXTS)


def test_hostile_values_give_null_not_errors(spark):
    texts = ["Total: 9" + "9" * 400, "Invoice Date: 99/99/9999\nNet 99999999999", "Invoice No: " + "A" * 5000, "\x00\x1f\ufffe", "Total: ١٢٣"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    rows = {r.doc_id: r for r in extract_invoices(frame).collect()}
    assert len(rows) == len(texts) and rows[0].fields.total_amount is None and rows[1].fields.due_date is None


def test_coverage_by_a_column(docs):
    frame = extract_invoices(docs).withColumn("half", F.col("doc_id") % 2)
    rows = coverage(frame, by=["half"]).collect()
    assert {(r.half, r.n_docs) for r in rows if r.field == "currency"} == {(0, 6), (1, 7)}


def test_receipts_have_no_due_date(docs):
    r = {x.doc_id: x for x in extract_documents(docs, RECEIPT).collect()}[1]
    assert r.document_type == "receipt" and r.fields.due_date is None and r.fields.total_amount == 572.7


def test_stream_matches_batch(spark, docs, results, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream_extract(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v.fields for k, v in streamed.items()} == {k: v.fields for k, v in results.items()}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "b.txt").write_text("one\ntwo")
    files = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert bytes(files["a.pdf"].header)[:4] == b"%PDF" and files["b.txt"].length == 7
    assert read_text_corpus(spark, str(tmp_path / "b.txt"), fmt="text").first().raw_text == "one\ntwo"
    with pytest.raises(Exception):
        read_files(spark, str(tmp_path / "missing"))


ORDER = """\
PURCHASE ORDER
Vendor: Harbour Ropes Ltd
Order No: HR-771
Delivery: 4 May 2027
Total: USD 1,200.00
"""


def zipped(names, comment=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in names:
            z.writestr(n, "x" * 50)
        z.comment = comment
    return data.getvalue()


def test_zip_types_by_their_entries(spark, tmp_path):
    word, sheet = ["[Content_Types].xml", "word/document.xml", "word/é.xml"], ["xl/workbook.xml"]
    files = {
        "a.docx": zipped(word), "b.bin": zipped(word), "c.docx": zipped(sheet), "d.zip": zipped(["x.txt"]),
        "e.docx": zipped(["ppt/presentation.xml"]), "f.bin": zipped(word, b"a comment"), "g.docx": zipped(word)[:60],
        "h.zip": zipped(word)[:60], "i.zip": zipped([]), "j.docx": b"\x00\x01", "l.docx": zipped(word) + b"tail",
        "m.bin": zipped([f"n{k}" for k in range(300)] + word),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = admit(read_files(spark, str(tmp_path)))
    assert "tail" not in found.columns
    kinds = {r.path.rsplit("/", 1)[1]: (r.mime or "").rsplit(".", 1)[-1] for r in found.collect()}
    assert kinds == {
        "a.docx": "document", "b.bin": "document", "c.docx": "sheet", "d.zip": "application/zip", "e.docx": "presentation",
        "f.bin": "document", "g.docx": "document", "h.zip": "application/zip", "i.zip": "application/zip", "j.docx": "document",
        "l.docx": "document", "m.bin": "document",
    }


def test_a_type_adds_fields_of_its_own(spark):
    docs = spark.createDataFrame([(1, ORDER), (2, "PO number X1-9 deliver soon\nto 2027-05-06"), (3, "")], "doc_id long, raw_text string")
    plain = {r.doc_id: r for r in extract_documents(docs, PURCHASE_ORDER).collect()}
    f = plain[1].fields
    assert (f.vendor_name, f.po_number, str(f.delivery_date), f.total_amount, f.currency) == (
        "Harbour Ropes Ltd", "HR-771", "2027-05-04", 1200.0, "USD")
    assert (f.invoice_number, f.invoice_date, f.due_date) == (None, None, None)
    assert (plain[1].confidence.po_number, plain[1].source.delivery_date) == (0.85, "regex")
    assert plain[2].fields.po_number == "X1-9" and plain[2].fields.delivery_date is None
    assert plain[3].source.po_number == "none" and plain[3].overall_confidence == 0.0
    for fused in (
        extract_documents(docs, PURCHASE_ORDER, tagged=True),
        extract_documents(docs, PURCHASE_ORDER, tag_entities(docs), tokens(docs)),
    ):
        rows = {r.doc_id: r for r in fused.collect()}
        assert rows[1].source.delivery_date == "regex+nlp" and rows[1].confidence.delivery_date == 1.0
        assert str(rows[2].fields.delivery_date) == "2027-05-06" and rows[2].source.delivery_date == "nlp"
        assert rows[1].fields.invoice_date is None  # entities add no field that the type lacks


def test_types_are_chosen_within_one_scan(spark, docs, results):
    mixed = docs.unionByName(spark.createDataFrame([(900, ORDER)], docs.schema))
    found = extract_documents(mixed, (PURCHASE_ORDER, INVOICE))
    rows = {r.doc_id: r for r in found.collect()}
    alone = extract_documents(mixed.where("doc_id = 900"), PURCHASE_ORDER).first()
    assert rows[900] == alone and rows[900].document_type == "purchase_order"
    for key, r in results.items():
        assert rows[key].document_type == "invoice" and rows[key].fields.po_number is None
        known = {k: v for k, v in rows[key].fields.asDict().items() if k not in ("po_number", "delivery_date")}
        assert known == r.fields.asDict() and rows[key].overall_confidence == r.overall_confidence
    plan = extract_documents(docs, (PURCHASE_ORDER, INVOICE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan


@pytest.mark.parametrize("folder", [True, False])
def test_a_streamed_table_may_be_a_folder_or_a_file(spark, tmp_path, folder):
    rows = spark.createDataFrame([(k, f"Invoice No: A-{k:03d}") for k in range(7)], "doc_id long, text string")
    rows.repartition(3 if folder else 1).write.parquet(str(tmp_path / "made"))
    if folder:
        (tmp_path / "made").rename(tmp_path / "documents.parquet")
    else:
        next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert {r.doc_id for r in QUERIES["stream_results"](spark, str(tmp_path)).collect()} == set(range(7))


def test_lots_land_in_few_files_that_many_tasks_can_read(spark, tmp_path):
    docs = spark.range(200_000, numPartitions=24).selectExpr("id AS doc_id", "concat(sha2(string(id), 256), sha2(string(-id), 256)) AS raw_text")
    for lot in range(2):
        queries._land(docs.where(f"doc_id % 2 = {lot}"), str(tmp_path / "in"))
    files = list((tmp_path / "in").glob("*.parquet"))
    assert len(files) == 2 * queries.LOT_FILES
    assert all(pq.ParquetFile(f).num_row_groups > 1 for f in files[:3])
    assert spark.read.parquet(str(tmp_path / "in")).exceptAll(docs).isEmpty()
    assert spark.read.parquet(str(tmp_path / "in")).count() == 200_000
