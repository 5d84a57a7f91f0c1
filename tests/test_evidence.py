"""Evidence found within the scan against evidence from tables of tokens and spans."""

import random

from pyspark.sql import functions as F

from invoicelake.catalog.corpus import prose, rendered_invoices
from invoicelake.functions.text import clean_text
from invoicelake.operators.entities import annotated, evidence, head_text, tag_entities, tagged_rows, tokens, with_row_evidence, with_text_evidence
from invoicelake.plans.extraction import extract_invoices
from invoicelake.sources.writers import bucketed
from tests.test_extraction import TEXTS

SF = "/root/testdata/sf0.001"


def by_doc(frame):
    """Rows of evidence; a document without any is left out, as the joins leave it out."""
    found = {r.doc_id: r.evidence.asDict(True) for r in frame.collect() if r.evidence is not None}
    return {k: v for k, v in found.items() if any(x not in (None, []) for x in v.values())}


def compare(docs):
    clean = docs.withColumn("clean_text", clean_text(F.coalesce("raw_text", F.lit(""))))
    scanned = with_text_evidence(clean)
    joined = evidence(docs, tokens(docs), tag_entities(docs))
    joined = joined.select("doc_id", F.struct(*joined.columns[1:]).alias("evidence"))
    left, right = by_doc(scanned), by_doc(joined)
    assert left == right
    rows = clean.withColumn("_top", head_text(F.col("clean_text"))).join(tagged_rows(tokens(docs), tag_entities(docs)), "doc_id", "left")
    assert by_doc(with_row_evidence(rows)) == right
    return len(left)


def random_texts(n=150):
    rng = random.Random(11)
    parts = ["invoice", "Date:", "due", "payable", "total", "grand", "paid", "Issued", "Dated", "today", "net", "\n"]
    parts += ["$12.50", "USD 300", "€", "7", "1,200.00", "12/03/2024", "2024-05-06", "5 May 2024", "Acme Ltd", "acme inc", "B Corp."]
    parts += ["99/99/2024", "12 apples", "£ 4", "May 7, 2023", "Xy AG", "INR 1 000.50"]
    return [(k, " ".join(rng.choices(parts, k=rng.randint(1, 60)))) for k in range(n)]


def test_scan_equals_joins_on_random_texts(spark):
    rows = random_texts() + [(1000, None), (1001, ""), (1002, "total " * 3000 + "$5")]
    assert compare(spark.createDataFrame(rows, "doc_id long, raw_text string")) > 100


def test_scan_equals_joins_on_invoices_and_prose(spark):
    assert compare(rendered_invoices(spark, SF).where("doc_id % 3 = 0")) > 400
    compare(prose(spark, SF))


def test_extraction_in_one_scan(spark):
    docs = spark.createDataFrame(list(TEXTS.items()) + [(100 + k, t) for k, t in random_texts(60)], "doc_id long, raw_text string")
    scanned, joined = extract_invoices(docs, tagged=True), extract_invoices(docs, tag_entities(docs), tokens(docs))
    assert {r.doc_id: r for r in scanned.collect()} == {r.doc_id: r for r in joined.collect()}
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_several_spans_at_one_token(spark):
    tokens_table = spark.createDataFrame([(1, k, w) for k, w in enumerate("Total due $ 5 or 6 date x".split())], "doc_id long, tok_no int, token string")
    spans = [(1, 0, 2, "MONEY", "$ 5"), (1, 1, 2, "MONEY", "$ 4"), (1, 2, 2, "DATE", " 2024-01-05 "), (1, 3, 5, "CARDINAL", "6"), (1, 4, 3, "CARDINAL", "5"), (1, 5, 7, "ORG", "")]
    entities = spark.createDataFrame(spans, "doc_id long, ent_no int, start_tok int, label string, text string")
    docs = spark.createDataFrame([(1, "Total due"), (2, "nothing")], "doc_id long, raw_text string")
    joined = evidence(docs, tokens_table, entities)
    joined = joined.select("doc_id", F.struct(*joined.columns[1:]).alias("evidence"))
    rows = docs.withColumn("_top", F.lit("")).join(tagged_rows(tokens_table, entities), "doc_id", "left")
    assert by_doc(with_row_evidence(rows)) == by_doc(joined) != {}


def test_bucketed_tables_stay_in_place(spark, tmp_path):
    docs = spark.createDataFrame(random_texts(80), "doc_id long, raw_text string")
    words = bucketed(tokens(docs), "tokens_by_doc", str(tmp_path / "tokens"), 4)
    spans = bucketed(tag_entities(docs), "spans_by_doc", str(tmp_path / "spans"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = tagged_rows(words, spans)
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        found = extract_invoices(docs, spans, words)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1  # that of the candidates
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r for r in found.collect()} == {r.doc_id: r for r in extract_invoices(docs, tagged=True).collect()}


def test_what_is_cut_once_serves_tokens_and_spans(spark):
    texts = [(1, "Total: USD 12.50 on 3 May 2027 for Acme Ltd"), (2, ""), (3, None), (4, "12\tdue 2027-01-09")]
    docs = spark.createDataFrame(texts, "doc_id long, raw_text string")
    cut = annotated(docs)
    for made in (tokens, tag_entities):
        assert sorted(map(str, made(cut).collect())) == sorted(map(str, made(docs).collect()))
    written = spark.createDataFrame(cut.collect(), cut.schema)
    for made in (tokens, tag_entities):
        assert "regexp_extract_all" not in made(written)._jdf.queryExecution().optimizedPlan().toString()
