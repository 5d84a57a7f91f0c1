"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from invoicelake.catalog import corpus as C
from invoicelake.functions import fixed_values as V
from invoicelake.functions.cascade import first_valid
from invoicelake.functions.line_items import explode_line_items, item_columns
from invoicelake.functions.normalize import (
    compute_due_date,
    detect_currency,
    normalize_amount,
    normalize_currency,
    normalize_date,
    strip_currency,
)
from invoicelake.functions.report import amount_text, date_text, field_rows, file_size_text, file_type_label, percent_text
from invoicelake.functions.scoring import number_text, tier
from invoicelake.functions.text import clean_text, fields_found, head_lines, lines, norm_newlines, raw_text_length, total_line
from invoicelake.operators import assembly, entities as E, intake, reports
from invoicelake.operators.rule_hits import best_rule, rule_hits, rule_report
from invoicelake.operators.rule_table import RULES_SCHEMA, rule_table_hits, rules_as_table
from invoicelake.plans.extraction import (
    INVOICE,
    PURCHASE_ORDER,
    RECEIPT,
    extract_documents,
    extract_invoices,
    first_name_line,
    suffix_line,
)
from invoicelake.plans.pipeline import assembled_texts, run_pipeline
from invoicelake.sources.readers import read_files, read_text_corpus
from invoicelake.sources.writers import bucketed, write_intake, write_quarantine, write_results
from invoicelake.streaming.extract import stream_extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the cluster's shared folder; only a local session may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="invoicelake-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _written(frame: DataFrame, name: str) -> DataFrame:
    """A table that several steps read, written once."""
    path = scratch(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_invoices(C.rendered_invoices(spark, sf_dir))


def _field(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _results(spark, sf_dir).select(
        "doc_id", F.col("fields")[name].alias(name), F.col("confidence")[name].alias("confidence")
    )


# --- Extraction of the rendered invoices --------------------------------------


@query
def invoice_numbers(spark, sf_dir):
    return _field(spark, sf_dir, "invoice_number")


@query
def invoice_dates(spark, sf_dir):
    return _field(spark, sf_dir, "invoice_date")


@query
def due_dates(spark, sf_dir):
    return _field(spark, sf_dir, "due_date")


@query
def totals(spark, sf_dir):
    return _field(spark, sf_dir, "total_amount")


@query
def currencies(spark, sf_dir):
    return _field(spark, sf_dir, "currency")


@query
def vendors(spark, sf_dir):
    return _field(spark, sf_dir, "vendor_name")


@query
def line_items(spark, sf_dir):
    return explode_line_items(_results(spark, sf_dir))


@query
def line_item_sums(spark, sf_dir):
    items = F.col("fields.line_items")
    total = F.aggregate(items, F.lit(0.0), lambda t, i: t + i["amount"])
    return _results(spark, sf_dir).select(
        "doc_id", F.size(items).alias("n_items"), F.round(total, 2).alias("items_total"),
        item_columns(items)["has_quantity"].alias("has_quantity"),
        item_columns(items)["has_unit_price"].alias("has_unit_price"),
        item_columns(items)["has_amount"].alias("has_amount"),
    )


@query
def consistency_warnings(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "doc_id", F.posexplode("extraction_warnings").alias("warning_no", "warning")
    )


@query
def overall_confidence(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "doc_id", "overall_confidence", fields_found(F.col("fields")).alias("fields_found")
    )


@query
def confidence_tiers(spark, sf_dir):
    overall = F.col("overall_confidence")
    both = F.array(
        *[F.struct(F.lit(s).alias("scale"), tier(overall, s).alias("tier")) for s in V.TIER_SCALES]
    )
    tiers = _results(spark, sf_dir).select(F.explode(both).alias("t")).select("t.*")
    return tiers.groupBy("scale", "tier").agg(F.count("*").alias("n_docs"))


@query
def coverage(spark, sf_dir):
    return reports.coverage(_results(spark, sf_dir))


@query
def review_queue(spark, sf_dir):
    below = reports.below_review(_results(spark, sf_dir)).select("doc_id", "overall_confidence")
    return reports.route_review(_written(below, "below")).select("doc_id", "overall_confidence")


@query
def reconcile(spark, sf_dir):
    orders = C.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    truth = orders.select(
        k.alias("doc_id"),
        F.lit(None).cast("string").alias("vendor_name"),
        F.concat(F.lit("INV-"), C.padded(k, 6)).alias("invoice_number"),
        F.to_date("o_orderdate").alias("invoice_date"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        F.col("o_totalprice").alias("total_amount"),
        F.lit("USD").alias("currency"),
    )
    return reports.reconcile(_results(spark, sf_dir), truth)


@query
def review_ranks(spark, sf_dir):
    ranked = reports.write_review(_results(spark, sf_dir), scratch(spark, "review"))
    return ranked.select("doc_id", "overall_confidence", "rank")


@query
def reconcile_items(spark, sf_dir):
    """Line items against a truth in which, by key, one is left out, added or changed."""
    kind = F.col("doc_id") % 4
    items = F.transform(C.true_items(F.col("items")), lambda i, k: i.withField("amount", F.when((kind == 3) & (k == 0), i["amount"] + 1).otherwise(i["amount"])))
    none, ghost = F.lit(None).cast("double"), F.lit("Ghost")
    added = F.array(F.struct(ghost.alias("description"), none.alias("quantity"), none.alias("unit_price"), none.alias("amount")))
    truth = C.billed_orders(spark, sf_dir).select(
        "doc_id",
        F.when((kind == 1) & (F.size(items) > 0), F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))))
        .when(kind == 2, F.concat(added, F.reverse(items)))
        .otherwise(F.reverse(items)).alias("line_items"),
    )
    return reports.reconcile_items(_results(spark, sf_dir), truth)


@query
def extract_full(spark, sf_dir):
    return _shown(_results(spark, sf_dir))


def _shown(results: DataFrame, *more: str) -> DataFrame:
    """All that a result row holds, nested parts as text."""

    def item(i: Column) -> Column:
        return F.concat_ws("|", i["description"], *[F.format_string("%.2f", i[c]) for c in ("quantity", "unit_price", "amount")])

    return results.select(
        "doc_id",
        *more,
        "document_type",
        *[F.col("fields")[f].alias(f) for f in V.FIELDS],
        *[F.col("confidence")[f].alias("c_" + f) for f in V.FIELDS],
        *[F.col("source")[f].alias("s_" + f) for f in V.FIELDS],
        F.array_join(F.transform("fields.line_items", item), ";").alias("items"),
        "overall_confidence",
        F.array_join("extraction_warnings", ";").alias("warnings"),
    )


@query
def receipts(spark, sf_dir):
    results = extract_documents(C.rendered_invoices(spark, sf_dir), RECEIPT)
    return results.select(
        "doc_id", "document_type", "fields.vendor_name", "fields.invoice_number", "fields.invoice_date", "fields.due_date",
        "fields.total_amount", "fields.currency", F.size("fields.line_items").alias("n_items"),
    )


@query
def mixed_types(spark, sf_dir):
    """Invoices and purchase orders, each with the fields of its type."""
    names = [*V.FIELDS, *[field.name for field in PURCHASE_ORDER.extra]]
    results = extract_documents(C.mixed_documents(spark, sf_dir), (PURCHASE_ORDER, INVOICE))
    return results.select(
        "doc_id", "document_type",
        *[F.col("fields")[f].alias(f) for f in names],
        *[F.col("confidence")[f].alias("c_" + f) for f in names],
        F.size("fields.line_items").alias("n_items"), "overall_confidence",
    )


@query
def report_format(spark, sf_dir):
    return field_rows(_results(spark, sf_dir))


# --- Rules ----------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(C.rendered_invoices(spark, sf_dir))


@query
def rule_hit_rows(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "field", "rule_no", "confidence", "value")


@query
def best_rules(spark, sf_dir):
    return best_rule(_hits(spark, sf_dir))


@query
def rule_hit_report(spark, sf_dir):
    return rule_report(_hits(spark, sf_dir))


@query
def rule_table_rows(spark, sf_dir):
    """The rules of the library and one more for each customer, as a table."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("Customer#"), C.padded(key, 9))
    own = C.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("field"), key.cast("int").alias("rule_no"),
        F.concat(F.lit(r"(?imU)^bill to:\s*("), name, F.lit(r")$")).alias("pattern"), F.lit(1).alias("group_no"),
        F.lit(0.9).alias("confidence"), F.lit("name").alias("reads"),
        F.array(F.array(F.lit("bill")), F.array(name)).alias("needs"),
    )
    rules = rules_as_table(spark).unionByName(own.to(rules_as_table(spark, []).schema))
    return rule_table_hits(C.rendered_invoices(spark, sf_dir), rules).select(
        "doc_id", "field", "rule_no", "confidence", "value", "winner_no"
    )


@query
def claim_conflicts(spark, sf_dir):
    docs, tokens, spans = _tagged(spark, sf_dir)
    return reports.conflict_report(reports.claims(rule_hits(docs), E.near_keywords(tokens, spans)))


# --- Entities -------------------------------------------------------------------


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _written(C.rendered_invoices(spark, sf_dir), "docs")
    cut = _written(E.annotated(docs), "cut")
    return docs, E.tokens(cut), E.tag_entities(cut)


@query
def entity_near_keyword(spark, sf_dir):
    _, tokens, spans = _tagged(spark, sf_dir)
    near = E.near_keywords(tokens, spans)
    amount = number_text(normalize_amount(F.col("text")))
    value = F.when(F.col("kind") == "total_amount", amount).otherwise(normalize_date(F.col("text")).cast("string"))
    return near.select("doc_id", "kind", "kw_no", "distance", "confidence", value.alias("value"))


@query
def entity_scores(spark, sf_dir):
    docs, tokens, spans = _tagged(spark, sf_dir)
    scored = E.score_orgs(spans, docs).unionByName(E.score_dates(spans)).unionByName(E.score_money(spans, tokens))
    label, text = F.col("label"), F.col("text")
    value = (
        F.when(label == "DATE", normalize_date(text).cast("string"))
        .when(label == "MONEY", number_text(normalize_amount(text)))
        .otherwise(text)
    )
    return scored.select("doc_id", "label", value.alias("value"), "confidence")


@query
def fused_fields(spark, sf_dir):
    return _shown(extract_invoices(C.rendered_invoices(spark, sf_dir), tagged=True))


@query
def fused_tables(spark, sf_dir):
    return _shown(extract_invoices(*_bucketed_tags(spark, sf_dir)))


#: Buckets of the entity tables: the fewest and the most, and the documents of one, whose tokens should fit a task.
BUCKETS, MOST_BUCKETS, BUCKET_DOCUMENTS = 16, 512, 100_000


def _buckets(documents: int) -> int:
    """A bucket is grouped by one task, in memory if it can be; too many buckets would be too many files."""
    return min(max(BUCKETS, -(-documents // BUCKET_DOCUMENTS)), MOST_BUCKETS)


def _bucketed_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rendered invoices, and spans and tokens of a tagger in tables bucketed by document."""
    docs = _written(C.rendered_invoices(spark, sf_dir), "docs")
    cut = _written(E.annotated(docs), "cut")
    made = {"spans": E.tag_entities(cut), "tokens": E.tokens(cut)}
    run, buckets = uuid.uuid4().hex, _buckets(docs.count())
    kept = {n: bucketed(t, f"{n}_{run}", scratch(spark, n), buckets) for n, t in made.items()}
    return docs, kept["spans"], kept["tokens"]


@query
def token_counts(spark, sf_dir):
    rows = E.tokens(C.prose(spark, sf_dir))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum(F.length("token")).alias("n_chars"),
        F.max("tok_no").alias("last_tok"),
    )


# --- Text -----------------------------------------------------------------------


@query
def text_corpus(spark, sf_dir):
    docs = read_text_corpus(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", raw_text_length(F.col("raw_text")).alias("raw_text_length"))


@query
def cleaned_text(spark, sf_dir):
    return C.messy_prose(spark, sf_dir).select("doc_id", clean_text(F.col("raw_text")).alias("clean_text"))


@query
def unix_newlines(spark, sf_dir):
    return C.messy_prose(spark, sf_dir).select("doc_id", norm_newlines(F.col("raw_text")).alias("text"))


@query
def line_counts(spark, sf_dir):
    all_lines = lines(F.col("raw_text"))
    return C.prose(spark, sf_dir).select(
        "doc_id",
        F.size(all_lines).alias("n_lines"),
        F.array_join(head_lines(F.col("raw_text"), 10), "\n").alias("head"),
    )


@query
def total_lines(spark, sf_dir):
    line = total_line(clean_text(F.col("raw_text")))
    return C.rendered_invoices(spark, sf_dir).select("doc_id", F.substring_index(line, ":", 1).alias("label"))


@query
def vendor_fallback(spark, sf_dir):
    clean = clean_text(F.col("raw_text"))
    return C.prose(spark, sf_dir).select("doc_id", clean.alias("clean")).select(
        "doc_id",
        suffix_line(F.col("clean")).alias("suffix_line"),
        first_name_line(F.col("clean")).alias("first_line"),
    )


@query
def currency_scan(spark, sf_dir):
    return C.prose(spark, sf_dir).select("doc_id", detect_currency(F.col("raw_text")).alias("currency"))


@query
def date_fallback(spark, sf_dir):
    return C.prose(spark, sf_dir).select(
        "doc_id", first_valid(F.col("raw_text"), V.DATE_ANYWHERE, normalize_date).alias("any_date")
    )


# --- Values ---------------------------------------------------------------------


def _exploded(frame: DataFrame, key: str, forms: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("form"), c.alias("raw")) for n, c in forms.items()])
    return frame.select(key, F.explode(rows).alias("f")).select(key, "f.*")


@query
def amount_styles(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    styles = ("plain", "us", "european", "indian", "spaced")
    prefixes = ("", "$", "EUR ", "Rs. ")
    forms = {
        f"{name}{no}": F.concat(F.lit(prefix), C.money_text(cents, F.lit(style)))
        for style, name in enumerate(styles)
        for no, prefix in enumerate(prefixes)
    }
    raw = _exploded(C.table(spark, sf_dir, "orders"), "o_orderkey", forms)
    return raw.select("o_orderkey", "form", normalize_amount(F.col("raw")).alias("amount"))


@query
def stripped_amounts(spark, sf_dir):
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    forms = {
        "code_before": F.concat(F.lit("GBP "), text),
        "code_behind": F.concat(text, F.lit(" usd ")),
        "symbol": F.concat(F.lit("₹"), text),
        "word": F.concat(F.lit("RM "), text),
    }
    raw = _exploded(C.table(spark, sf_dir, "orders"), "o_orderkey", forms)
    return raw.select("o_orderkey", "form", strip_currency(F.col("raw")).alias("amount_text"))


DATE_FORMS = {
    "iso": "yyyy-MM-dd", "iso_slash": "yyyy/M/d", "dmy": "dd/MM/yyyy", "dmy_dash": "d-M-yyyy", "dmy_dot": "dd.MM.yyyy",
    "long": "d MMMM yyyy", "us_long": "MMMM d, yyyy", "us_long_plain": "MMMM d yyyy", "short": "d MMM yyyy",
    "us_short": "MMM d, yyyy", "dash_month": "d-MMM-yyyy", "dash_month_yy": "d-MMM-yy", "dmy_yy": "dd/MM/yy",
}


@query
def date_styles(spark, sf_dir):
    day = F.to_date("o_orderdate")
    forms = {name: F.date_format(day, style) for name, style in DATE_FORMS.items()}
    raw = _exploded(C.table(spark, sf_dir, "orders"), "o_orderkey", forms)
    return raw.select("o_orderkey", "form", normalize_date(F.col("raw")).alias("day"))


@query
def month_first_dates(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return C.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        normalize_date(F.date_format(day, "MM/dd/yyyy"), prefer_dmy=False).alias("day"),
        normalize_date(F.date_format(day, "MM/dd/yyyy")).alias("dmy_reading"),
        compute_due_date(day, F.lit(30)).alias("due"),
    )


CURRENCY_WORDS = ["$", "us$", " USD ", "£", "Rs.", "rm", "hk$", "¥CN", "XYZ", "no", "", "12$"]


@query
def currency_words(spark, sf_dir):
    words = F.array(*map(F.lit, CURRENCY_WORDS))
    raw = F.element_at(words, (F.col("o_orderkey") % len(CURRENCY_WORDS) + 1).cast("int"))
    return C.table(spark, sf_dir, "orders").select("o_orderkey", normalize_currency(raw).alias("currency"))


@query
def value_texts(spark, sf_dir):
    codes = F.array(*map(F.lit, ["USD", "EUR", "CHF", "INR", "??"]))
    code = F.element_at(codes, (F.col("o_orderkey") % 5 + 1).cast("int"))
    mimes = F.array(*map(F.lit, ["application/pdf", "image/webp", "text/plain", ""]))
    return C.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        amount_text(F.col("o_totalprice"), code).alias("amount_text"),
        date_text(F.to_date("o_orderdate")).alias("date_text"),
        percent_text((F.col("o_orderkey") % 101) / 100).alias("percent_text"),
        file_size_text(F.col("o_orderkey") * F.col("o_orderkey")).alias("size_text"),
        file_type_label(F.element_at(mimes, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("type_label"),
    )


# --- Intake ---------------------------------------------------------------------


@query
def intake_status(spark, sf_dir):
    return intake.admit(C.document_files(spark, sf_dir)).select(
        "doc_id", "mime", "loader", "intake_status", "intake_reason"
    )


@query
def container_types(spark, sf_dir):
    return intake.admit(C.zipped_files(spark, sf_dir)).select("doc_id", "length", "mime", "loader", "intake_status")


@query
def upload_status(spark, sf_dir):
    return intake.admit(C.document_files(spark, sf_dir), endpoint="upload").select(
        "doc_id", "intake_status", "intake_reason"
    )


@query
def assembled_pages(spark, sf_dir):
    return assembly.assemble_pages(C.conversation_pages(spark, sf_dir))


@query
def page_stats(spark, sf_dir):
    return assembly.page_method_stats(C.conversation_pages(spark, sf_dir))


@query
def assembled_blocks(spark, sf_dir):
    return assembly.assemble_blocks(C.conversation_blocks(spark, sf_dir))


def _metadata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = intake.split_admitted(intake.admit(C.conversation_files(spark, sf_dir)))[0]
    return files, intake.doc_metadata(
        files, C.conversation_pages(spark, sf_dir), C.conversation_blocks(spark, sf_dir)
    )


def _texts(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    wanted = files.select("doc_id", "loader")
    return assembled_texts(wanted, C.conversation_pages(spark, sf_dir), C.conversation_blocks(spark, sf_dir))


@query
def file_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir)[1]


@query
def intake_records(spark, sf_dir):
    files, metadata = _metadata(spark, sf_dir)
    return intake.intake_record(files, _texts(spark, sf_dir, files), metadata).select(
        "doc_id", "filename", "file_type", "page_count", "char_count", "text",
        *[f"metadata.{c}" for c in ("file_size_bytes", "paragraph_count", "table_count", "is_encrypted")],
    )


@query
def merged_results(spark, sf_dir):
    files, metadata = _metadata(spark, sf_dir)
    texts = _texts(spark, sf_dir, files)
    records = intake.intake_record(files, texts, metadata)
    merged = intake.merge_results(records, extract_invoices(texts))
    return merged.select("doc_id", "filename", "char_count", "raw_text_length", "document_type")


@query
def pipeline_results(spark, sf_dir):
    run = run_pipeline(
        C.conversation_files(spark, sf_dir),
        C.conversation_pages(spark, sf_dir),
        C.conversation_blocks(spark, sf_dir),
    )
    return run.results.select("doc_id", "document_type", "raw_text_length")


@query
def merged_invoices(spark, sf_dir):
    docs = _written(C.rendered_invoices(spark, sf_dir), "docs")
    files = intake.split_admitted(intake.admit(C.invoice_files(spark, sf_dir)))[0]
    pages, blocks = C.invoice_pages(docs), C.invoice_blocks(docs)
    texts = assembled_texts(files.select("doc_id", "loader"), pages, blocks)
    records = intake.intake_record(files, texts, intake.doc_metadata(files, pages, blocks))
    return _shown(intake.merge_results(records, extract_invoices(texts)), "filename", "file_type", "page_count")


@query
def pipeline_invoices(spark, sf_dir):
    """Files, pages and blocks to results with the entity tables of a tagger."""
    docs, spans, tokens = _bucketed_tags(spark, sf_dir)
    run = run_pipeline(
        C.invoice_files(spark, sf_dir), C.invoice_pages(docs), C.invoice_blocks(docs), entities=spans, tokens=tokens
    )
    return _shown(run.results)


@query
def intake_days(spark, sf_dir):
    """Three days of uploads; the second is run again, with every other file."""
    path = scratch(spark, "intake")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 3).cast("int"))
    files = intake.admit(C.document_files(spark, sf_dir)).withColumn("intake_day", day)
    write_intake(files, path)
    write_intake(files.filter("doc_id % 3 = 1 AND doc_id % 2 = 0"), path)
    return spark.read.parquet(path).select("doc_id", "intake_day", "outcome", "intake_status")


# --- Files ----------------------------------------------------------------------


@query
def json_corpus(spark, sf_dir):
    path = scratch(spark, "json")
    C.table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    docs = read_text_corpus(spark, path, fmt="json", schema="doc_id bigint, text string")
    return docs.select("doc_id", F.md5("raw_text").alias("text_md5"))


def _turn_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one text file per conversation, a line a turn."""
    path = scratch(spark, "turns")
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("value"))
    lots = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "value")
    lots.write.partitionBy("conv_id").text(path)
    return path


def _conversation_of(path: Column) -> Column:
    return F.regexp_extract(path, r"conv_id=(\d+)", 1).cast("bigint").alias("doc_id")


@query
def text_files(spark, sf_dir):
    docs = read_text_corpus(spark, _turn_files(spark, sf_dir), fmt="text")
    return docs.select(_conversation_of(F.col("doc_id")), F.md5("raw_text").alias("text_md5"))


@query
def small_files(spark, sf_dir):
    files = read_files(spark, _turn_files(spark, sf_dir), pattern="*.txt", max_bytes=2000)
    return files.select(_conversation_of(F.col("path")), "length", F.hex("header").alias("header"))


@query
def quarantine_sink(spark, sf_dir):
    path = scratch(spark, "quarantine")
    rejected = intake.split_admitted(intake.admit(C.document_files(spark, sf_dir)))[1]
    write_quarantine(rejected, path)
    return spark.read.parquet(path).select("doc_id", "intake_status", "intake_reason")


@query
def result_sink(spark, sf_dir):
    path = scratch(spark, "results")
    results = _results(spark, sf_dir)
    write_results(results, path, fmt="json")
    stored = spark.read.schema(results.schema).json(path)
    return _shown(stored)


@query
def stream_results(spark, sf_dir):
    path = scratch(spark, "stream")
    # a table may be one file or a folder of them; a plain path would have to be a folder
    running = stream_extract(
        spark,
        f"{sf_dir}/documents.parque[t]",
        f"{path}/out",
        f"{path}/checkpoint",
        schema="doc_id bigint, text string",
        text_col="text",
    )
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "document_type", "raw_text_length")


#: Files of a lot, as many as a micro-batch takes, and the size of their parts that tasks can read by themselves.
LOT_FILES, LOT_PART_BYTES = 4, 1 << 20


def _land(lot: DataFrame, folder: str) -> None:
    """A lot as few files, so that the number of micro-batches doesn't grow with it, which all tasks can share."""
    lot.coalesce(LOT_FILES).write.mode("append").option("parquet.block.size", LOT_PART_BYTES).parquet(folder)


@query
def stream_invoices(spark, sf_dir):
    """Invoices that arrive in three lots, each after the stream was stopped; every start takes up where the last ended."""
    path = scratch(spark, "stream")
    lots = _written(C.rendered_invoices(spark, sf_dir).withColumn("lot", F.col("doc_id") % 3), "lots")
    for lot in range(3):
        _land(lots.filter(F.col("lot") == lot).drop("lot"), f"{path}/in")
        stream_extract(
            spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", with_entities=True, max_files_per_trigger=4
        ).awaitTermination()
    return _shown(spark.read.parquet(f"{path}/out"))
