"""Extraction of a corpus (R1, R3) and its field extractors.

Two narrow steps, with the optional evidence join between them:

1. ``rule_candidates`` reads every text once and reduces it to a small row of
   candidates.  The text ends here.
2. ``evidence`` rows, if there are any, are joined to those small rows, so a
   text never goes through a shuffle.
3. ``resolve`` fuses both sides and adds checks and scores.

Without evidence the whole job is one scan with projections, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions import rules as R
from invoicelake.functions.cascade import cascade, first_match, first_valid
from invoicelake.functions.columns import any_true, first_of, first_where, let, per_application, pinned
from invoicelake.functions.line_items import ITEM_TYPE, line_items
from invoicelake.functions.normalize import (
    ascii_digits,
    compute_due_date,
    detect_currency,
    normalize_amount,
    normalize_date,
    truncate_name,
)
from invoicelake.functions.scoring import (
    date_warning,
    extraction_warnings,
    fuse,
    fuse_vendor,
    items_total,
    number_text,
    overall_confidence,
    sum_warning,
)
from invoicelake.functions.text import (
    clean_text,
    fold,
    folded_pattern,
    head_lines,
    raw_text_length,
    strip,
    stripped,
    total_line,
)
from invoicelake.operators.entities import (
    evidence_type,
    head_text,
    keyword_list,
    tagged_rows,
    with_row_evidence,
    with_text_evidence,
)


#: How a field reads what its rules match: type of its values, reader, entities that can agree with it.
READERS = {
    "text": ("string", strip, None),
    "name": ("string", lambda c: truncate_name(strip(c)), None),
    "date": ("date", normalize_date, "DATE"),
    "amount": ("double", normalize_amount, "MONEY"),
}


@dataclass(frozen=True)
class Field:
    """A field that a document type adds to those all types know.

    Its rules are tried in order.  Dates and amounts may have ``keywords``: the
    entity within ``window`` tokens behind the first of them that has one is
    fused with what the rules read.
    """

    name: str
    rules: tuple[R.Rule, ...]
    reads: str = "text"
    keywords: tuple[str, ...] = ()
    window: int = 8

    @property
    def dtype(self) -> str:
        return READERS[self.reads][0]

    def nearby(self) -> list[tuple]:
        """Entries for the keyword search of its entities."""
        return keyword_list("x_" + self.name, list(self.keywords), READERS[self.reads][2], self.window)


@dataclass(frozen=True)
class DocType:
    """A document type is a name, its fields and its rules; the plan is built from them.

    Known fields that are left out come back null with confidence 0; ``extra``
    fields stand behind the known ones in a result's structs.  ``marks`` are
    lower-case words by which ``choose_type`` tells the type of a text.
    """

    name: str
    fields: tuple[str, ...]
    invoice_number: tuple[R.Rule, ...] = ()
    invoice_date: tuple[R.Rule, ...] = ()
    due_date: tuple[R.Rule, ...] = ()
    total_amount: tuple[R.Rule, ...] = ()
    vendor_name: tuple[R.Rule, ...] = ()
    extra: tuple[Field, ...] = ()
    marks: tuple[str, ...] = ()

    def has(self, field: str) -> bool:
        return field in self.fields

    def rules(self) -> list[R.Rule]:
        return [
            *self.invoice_number,
            *self.invoice_date,
            *self.due_date,
            *self.total_amount,
            *self.vendor_name,
            *[rule for field in self.extra for rule in field.rules],
        ]


INVOICE = DocType(
    name="invoice",
    fields=(*V.FIELDS, "line_items"),
    invoice_number=tuple(R.INVOICE_NUMBER),
    invoice_date=tuple(R.INVOICE_DATE),
    due_date=tuple(R.DUE_DATE),
    total_amount=tuple(R.TOTAL_AMOUNT),
    vendor_name=tuple(R.VENDOR_LABELED),
)

# A receipt has a receipt number, no due date and no terms.
RECEIPT = DocType(
    name="receipt",
    fields=("vendor_name", "invoice_number", "invoice_date", "total_amount", "currency", "line_items"),
    invoice_number=(R.INVOICE_NUMBER[2],),
    invoice_date=tuple(R.INVOICE_DATE),
    total_amount=tuple(R.TOTAL_AMOUNT),
    vendor_name=tuple(R.VENDOR_LABELED),
)

# An order names its own number and a day of delivery.
PURCHASE_ORDER = DocType(
    name="purchase_order",
    fields=("vendor_name", "total_amount", "currency", "line_items"),
    total_amount=tuple(R.TOTAL_AMOUNT),
    vendor_name=tuple(R.VENDOR_LABELED),
    extra=(
        Field("po_number", tuple(R.PO_NUMBER)),
        Field("delivery_date", tuple(R.DELIVERY_DATE), "date", ("delivery", "deliver")),
    ),
    marks=("purchase order", "po number"),
)

VALUE_TYPES = {
    "vendor_name": "string",
    "invoice_number": "string",
    "invoice_date": "date",
    "due_date": "date",
    "total_amount": "double",
    "currency": "string",
}
_WIN = "struct<value:{},confidence:double,rule_no:int>"

# Literals the extractors look for besides those of the rules.
_TOTAL_LINE_WORDS = ("total", "due")
_ITEM_HEADER_WORDS = ("description", "item", "particulars")
_NET_WORDS = ("net",)


# --- X6: the vendor without a label ------------------------------------------


def suffix_line(clean: Column) -> Column:
    """V3: first of the top lines with the legal form of a company."""
    found = first_where(
        head_lines(clean, V.VENDOR_SUFFIX_LINES), lambda x: stripped(x).rlike(V.ORG_SUFFIXES), V.VENDOR_SUFFIX_LINES
    )
    return truncate_name(strip(found))


def first_name_line(clean: Column) -> Column:
    """V4: first of the top lines that could be a name at all."""

    def usable(x: Column) -> Column:
        return (
            (F.length(x) >= V.VENDOR_FIRST_LINE_MIN_CHARS)
            & ~x.rlike(V.VENDOR_NOT_A_NAME)
            & ~x.rlike(V.VENDOR_NOT_A_NAME_START)
        )

    found = first_where(
        head_lines(clean, V.VENDOR_FIRST_LINES), lambda x: let(stripped(x), usable), V.VENDOR_FIRST_LINES
    )
    return truncate_name(strip(found))


def net_days(clean: Column) -> Column:
    """Days of the first "net N", null outside the accepted range."""
    low, high = V.NET_TERMS_DAYS
    days = ascii_digits(F.regexp_extract(clean, V.NET_TERMS, 1)).try_cast("int")
    return F.when(days.between(low, high), days)


# --- Step 1 -------------------------------------------------------------------


def _cascade_or_null(doc_type: DocType, field: str, build) -> Column:
    wanted = doc_type.has(field) and getattr(doc_type, field)
    typed = _WIN.format(VALUE_TYPES[field])
    return (build() if wanted else F.lit(None)).cast(typed)


Types = tuple[DocType, ...]


def choose_type(types: Types) -> Column:
    """Name of the first type of which the text has a mark, else of the last."""
    chosen = F.lit(types[-1].name)
    for t in reversed(types[:-1]):
        if t.marks:
            chosen = F.when(any_true([F.contains(F.col("_folded"), F.lit(m)) for m in t.marks]), t.name).otherwise(chosen)
    return chosen


def _by_type(types: Types, build: Callable[[DocType], Column]) -> Column:
    """What ``build`` makes for the type of a row."""
    if len(types) == 1:
        return build(types[0])
    return F.coalesce(*[F.when(F.col("document_type") == t.name, build(t)) for t in types])


def _extra(types: Types) -> list[Field]:
    """The fields that types add, those of one name once."""
    return list({field.name: field for t in types for field in t.extra}.values())


def _nearby(types: Types) -> tuple[tuple, ...]:
    return tuple(entry for field in _extra(types) for entry in field.nearby())


def _words(types: Types) -> R.Words:
    rules = [rule for t in types for rule in t.rules()]
    return R.Words(rules, (*_TOTAL_LINE_WORDS, *_ITEM_HEADER_WORDS, *_NET_WORDS))


@per_application
def _prepared_columns(types: Types) -> list[tuple[str, Column]]:
    clean, folded = F.col("clean_text"), F.col("_folded")
    return [
        ("clean_text", clean_text(F.col("raw_text"))),
        ("_folded", fold(clean)),
        ("_has", _words(types).column(folded)),
        ("document_type", choose_type(types)),
    ]


@per_application
def _rule_columns(types: Types) -> list[Column]:
    """Everything that is looked for in every text."""
    words = _words(types)
    clean, folded = F.col("clean_text"), F.col("_folded")

    def guarded(literals: tuple[str, ...], value: Column) -> Column:
        return F.when(any_true([words.has(w) for w in literals]), value)

    def read_by(reads: str, rules: tuple[R.Rule, ...]) -> Column:
        """Matches that are always readable end the search; others may have to go on."""
        read = READERS[reads][1]
        if reads in ("text", "name"):
            return first_match(clean, folded, list(rules), words, read)
        return cascade(folded, list(rules), words, read)

    def known(field: str, reads: str) -> Column:
        return _by_type(types, lambda t: _cascade_or_null(t, field, lambda: read_by(reads, getattr(t, field))))

    def added(field: Field) -> Column:
        typed = _WIN.format(field.dtype)
        own = [t for t in types if field in t.extra]
        found = read_by(field.reads, field.rules).cast(typed)
        return found if len(own) == len(types) else F.when(F.col("document_type").isin([t.name for t in own]), found)

    def if_has(field: str, value: Column) -> Column:
        return _by_type(types, lambda t: value if t.has(field) else F.lit(None))

    number = known("invoice_number", "text")
    date = known("invoice_date", "date")
    due = known("due_date", "date")
    total = known("total_amount", "amount")
    label = known("vendor_name", "name")
    on_total_line = guarded(_TOTAL_LINE_WORDS, detect_currency(total_line(folded, folded=True), folded=True))
    items = guarded(_ITEM_HEADER_WORDS, line_items(F.col("raw_text")))
    no_items = F.array().cast(ITEM_TYPE)

    return [
        raw_text_length(F.col("raw_text")).alias("raw_text_length"),
        number.alias("number"),
        date.alias("date"),
        due.alias("due"),
        total.alias("total"),
        label.alias("label"),
        if_has("currency", on_total_line).cast("string").alias("line_currency"),
        if_has("due_date", guarded(_NET_WORDS, net_days(folded))).cast("int").alias("net_days"),
        pinned(F.coalesce(if_has("line_items", items).cast(ITEM_TYPE), no_items)).alias("items"),
        *[added(field).alias("x_" + field.name) for field in _extra(types)],
    ]


@per_application
def _fallback_columns(types: Types) -> list[Column]:
    """What is looked for only where the rules found nothing."""
    clean, folded = F.col("clean_text"), F.col("_folded")
    no_label = F.col("label").isNull()

    def fallback(field: str, missing: Column, value: Column, dtype: str) -> Column:
        return _by_type(types, lambda t: F.when(missing, value) if t.has(field) else F.lit(None)).cast(dtype)

    return [
        fallback(
            "invoice_date", F.col("date").isNull(), first_valid(folded, folded_pattern(V.DATE_ANYWHERE), normalize_date), "date"
        ).alias("any_date"),
        fallback(
            "currency", F.col("line_currency").isNull(), detect_currency(folded, folded=True), "string"
        ).alias("text_currency"),
        fallback("vendor_name", no_label & F.col("suffix_line").isNull(), first_name_line(clean), "string").alias("first_line"),
    ]


@per_application
def _suffix_column(types: Types) -> Column:
    """The line with a legal form, of texts without a label; the first line is only looked for where there is none."""
    found = F.when(F.col("label").isNull(), suffix_line(F.col("clean_text")))
    return pinned(_by_type(types, lambda t: found if t.has("vendor_name") else F.lit(None)).cast("string"))


_CANDIDATES = ("raw_text_length", "number", "date", "due", "total", "label", "line_currency", "net_days", "items")


def rule_candidates(
    docs: DataFrame,
    doc_type: DocType | Types = INVOICE,
    keep: tuple[str, ...] = (),
    tagged: bool = False,
    head: bool = False,
) -> DataFrame:
    """What the rules, and with ``tagged`` the built-in tagger, find in each text, as one small row per document.

    Of several types each text gets one, by ``choose_type``, and only that type's rules are tried on it.  ``head``
    adds the head lines, which organisations of a given tagger are looked up in.
    """
    types = _types(doc_type)
    prepared = docs.select("doc_id", *keep, F.coalesce(F.col("raw_text"), F.lit("")).alias("raw_text"))
    for name, column in _prepared_columns(types):
        prepared = prepared.withColumn(name, column)
    if tagged:
        prepared, keep = with_text_evidence(prepared, _nearby(types)), (*keep, "evidence")
    if head:
        prepared, keep = prepared.withColumn("_top", head_text(F.col("clean_text"))), (*keep, "_top")
    ruled = prepared.select("doc_id", *keep, "document_type", "clean_text", "_folded", *_rule_columns(types))
    found = [*_CANDIDATES, *["x_" + field.name for field in _extra(types)]]
    ruled = ruled.withColumn("suffix_line", _suffix_column(types))
    return ruled.select("doc_id", *keep, "document_type", *found, "suffix_line", *_fallback_columns(types))


def _types(doc_type: DocType | Types) -> Types:
    return (doc_type,) if isinstance(doc_type, DocType) else tuple(doc_type)


# --- Step 2 -------------------------------------------------------------------


def _pick(value: Column, confidence, source: str, dtype: str) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        value.cast(dtype).alias("value"), conf.cast("double").alias("confidence"), F.lit(source).alias("source")
    )


def _resolved_date() -> Column:
    """Rule and entity fused, then any date of the text."""
    rule, near, best = F.col("date"), F.col("evidence.date_near"), F.col("evidence.date_best")
    entity_value = F.coalesce(near["value"], best["value"])
    entity_conf = F.when(near["value"].isNotNull(), near["confidence"]).otherwise(
        best["confidence"] * V.DATE_ENTITY_DISCOUNT
    )
    fused = fuse(rule["value"], rule["confidence"], entity_value, entity_conf)
    return (
        F.when(rule["value"].isNotNull() | entity_value.isNotNull(), fused)
        .when(
            F.col("any_date").isNotNull(),
            _pick(F.col("any_date"), V.DATE_ANYWHERE_CONFIDENCE, "regex", "date"),
        )
        .otherwise(_pick(F.lit(None), 0.0, "none", "date"))
    )


def _resolved_due(invoice_date: Column) -> Column:
    """Rule and entity fused, then net terms from the invoice date."""
    rule = F.col("due")
    others = F.filter(
        F.col("evidence.due_near"),
        lambda h: rule["value"].isNull() | (h["value"] != rule["value"]),
    )
    entity = first_of(others)
    fused = fuse(rule["value"], rule["confidence"], entity["value"], entity["confidence"])
    by_terms = compute_due_date(invoice_date, F.col("net_days"))
    return (
        F.when(rule["value"].isNotNull() | entity["value"].isNotNull(), fused)
        .when(by_terms.isNotNull(), _pick(by_terms, V.NET_TERMS_CONFIDENCE, "regex", "date"))
        .otherwise(_pick(F.lit(None), 0.0, "none", "date"))
    )


def _resolved_total() -> Column:
    """X4."""
    rule, near, best = F.col("total"), F.col("evidence.total_near"), F.col("evidence.money_best")
    value = F.coalesce(near["value"], best["value"])
    conf = F.when(near["value"].isNotNull(), near["confidence"]).otherwise(
        best["confidence"] * V.MONEY_ENTITY_DISCOUNT
    )
    return fuse(rule["value"], rule["confidence"], value, conf, number_text)


def _resolved_currency() -> Column:
    """Total line, then money entities, then the whole text."""
    line, entity, text = F.col("line_currency"), F.col("evidence.money_currency"), F.col("text_currency")
    at = V.CURRENCY_CONFIDENCE
    return (
        F.when(line.isNotNull(), _pick(line, at["total_line"], "regex", "string"))
        .when(entity.isNotNull(), _pick(entity, at["money_entity"], "nlp", "string"))
        .when(text.isNotNull(), _pick(text, at["text"], "regex", "string"))
        .otherwise(_pick(F.lit(None), 0.0, "none", "string"))
    )


def _resolved_vendor() -> Column:
    """Entity and label fused, then the two line heuristics."""
    org, label = F.col("evidence.org"), F.col("label")
    suffix, first = F.col("suffix_line"), F.col("first_line")
    return F.coalesce(
        fuse_vendor(org["value"], org["confidence"], label["value"], label["confidence"]),
        F.when(suffix.isNotNull(), _pick(suffix, V.VENDOR_SUFFIX_CONFIDENCE, "regex", "string")),
        F.when(first.isNotNull(), _pick(first, V.VENDOR_FIRST_LINE_CONFIDENCE, "regex", "string")),
        _pick(F.lit(None), 0.0, "none", "string"),
    )


def _resolved_number() -> Column:
    """Rules only."""
    number = F.col("number")
    return F.when(number.isNotNull(), _pick(number["value"], number["confidence"], "regex", "string")).otherwise(
        _pick(F.lit(None), 0.0, "none", "string")
    )


def _resolved_extra(field: Field) -> Column:
    """A field of one type: rule and entity fused."""
    rule = F.col("x_" + field.name)
    as_text = number_text if field.reads == "amount" else (lambda c: c.cast("string"))
    entity = F.col("evidence")["x_" + field.name] if field.keywords else F.lit(None).cast(f"struct<value:{field.dtype},confidence:double>")
    fused = fuse(rule["value"], rule["confidence"], entity["value"], entity["confidence"], as_text)
    return F.when(rule["value"].isNotNull() | entity["value"].isNotNull(), fused).otherwise(
        _pick(F.lit(None), 0.0, "none", field.dtype)
    )


@per_application
def _picks(types: Types) -> tuple[dict[str, Column], dict[str, Column]]:
    """The fields; the due date comes second, as it may need the invoice date."""

    def if_has(field: str, pick: Column) -> Column:
        """Entities may offer a value for a field that the type doesn't have."""
        having = [t.name for t in types if t.has(field) or field in [x.name for x in t.extra]]
        nothing = _pick(F.lit(None), 0.0, "none", VALUE_TYPES.get(field) or pick_types[field])
        if len(having) == len(types):
            return pick
        return F.when(F.col("document_type").isin(having), pick).otherwise(nothing) if having else nothing

    pick_types = {field.name: field.dtype for field in _extra(types)}
    picks = {
        "vendor_name": _resolved_vendor(),
        "invoice_number": _resolved_number(),
        "invoice_date": _resolved_date(),
        "total_amount": _resolved_total(),
        "currency": _resolved_currency(),
        **{field.name: _resolved_extra(field) for field in _extra(types)},
    }
    due = if_has("due_date", _resolved_due(F.col("p_invoice_date.value")))
    return (
        {"p_" + name: pinned(if_has(name, pick)) for name, pick in picks.items()},
        {"p_due_date": pinned(due), "items_total": items_total(F.col("items"))},
    )


@per_application
def _result_columns(types: Types) -> list[Column]:

    def part(field: str, name: str) -> Column:
        return F.col("p_" + field)[name]

    kinds = VALUE_TYPES | {field.name: field.dtype for field in _extra(types)}
    names = [*V.FIELDS, *[field.name for field in _extra(types)]]
    structs = {
        "fields": F.struct(
            *[part(f, "value").cast(kinds[f]).alias(f) for f in names],
            F.col("items").alias("line_items"),
        ),
        "confidence": F.struct(*[part(f, "confidence").alias(f) for f in names]),
        "source": F.struct(*[part(f, "source").alias(f) for f in names]),
    }
    return [
        F.col("document_type"),
        *[column.alias(name) for name, column in structs.items()],
        overall_confidence([part(f, "confidence") for f in names]).alias("overall_confidence"),
        extraction_warnings(
            date_warning(part("invoice_date", "value"), part("due_date", "value")),
            sum_warning(part("total_amount", "value"), F.col("items_total")),
        ).alias("extraction_warnings"),
        F.col("raw_text_length"),
    ]


def resolve(candidates: DataFrame, doc_type: DocType | Types = INVOICE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates, with or without evidence, to result rows."""
    types = _types(doc_type)
    if "evidence" not in candidates.columns:
        candidates = candidates.withColumn("evidence", F.lit(None).cast(evidence_type(_nearby(types))))
    for picks in _picks(types):
        candidates = candidates.withColumns(picks)
    return candidates.select("doc_id", *keep, *_result_columns(types))


# --- R1 -----------------------------------------------------------------------


def with_given_evidence(
    candidates: DataFrame, entities: DataFrame, tokens: DataFrame | None, doc_type: DocType | Types = INVOICE
) -> DataFrame:
    """Candidates (with ``head``) and the evidence of a tagger's tables.

    The tables are grouped by document and joined by it; bucketed by it, they
    stay where they are and only the candidates move.
    """
    if tokens is None:
        raise ValueError("entities come with the tokens they refer to")
    rows = candidates.join(tagged_rows(tokens, entities), "doc_id", "left")
    return with_row_evidence(rows, _nearby(_types(doc_type))).drop("_top")


def extract_documents(
    docs: DataFrame,
    doc_type: DocType | Types = INVOICE,
    entities: DataFrame | None = None,
    tokens: DataFrame | None = None,
    keep: tuple[str, ...] = (),
    tagged: bool = False,
) -> DataFrame:
    """``docs(doc_id, raw_text)`` to one result row per document.

    ``entities`` and ``tokens``, the tables of a tagger, switch the entity side
    on; so does ``tagged``, with the built-in tagger, in the scan that the rules
    need anyway.  Several types in ``doc_type`` are told apart per text, in one
    scan.  ``keep`` names columns of ``docs`` to carry along.
    """
    if tagged and entities is not None:
        raise ValueError("either tables of a tagger or the built-in one")
    candidates = rule_candidates(docs, doc_type, keep, tagged, head=entities is not None)
    if entities is not None:
        candidates = with_given_evidence(candidates, entities, tokens, doc_type)
    return resolve(candidates, doc_type, keep)


def extract_invoices(
    docs: DataFrame, entities: DataFrame | None = None, tokens: DataFrame | None = None, tagged: bool = False
) -> DataFrame:
    return extract_documents(docs, INVOICE, entities, tokens, tagged=tagged)
