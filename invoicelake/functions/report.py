"""Report formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.columns import let, lookup
from invoicelake.functions.normalize import round2


def amount_text(amount: Column, currency: Column) -> Column:
    """``$1,234.56``, always with two decimals.

    A code without a sign of its own stands before the number, parted by a
    no-break space; what is no currency code stands before the ungrouped number.
    """
    code = F.coalesce(F.when(currency != "", F.upper(currency)), F.lit("USD"))
    grouped = F.format_number(round2(amount), 2)
    sign = lookup(V.CURRENCY_SIGNS, code)
    text = (
        F.when(sign.isNotNull(), F.concat(sign, grouped))
        .when(code.rlike("^[A-Z]{3}$"), F.concat(code, F.lit(" "), grouped))
        .otherwise(F.concat(currency, F.lit(" "), F.format_string("%.2f", round2(amount))))
    )
    return F.when(amount.isNull(), F.lit(V.MISSING)).otherwise(text)


def date_text(d: Column) -> Column:
    """``Jan 15, 2024``."""
    return F.coalesce(F.date_format(d, "MMM d, yyyy"), F.lit(V.MISSING))


def percent_text(score: Column) -> Column:
    """Whole percent, halves up."""
    whole = F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5)
    return F.concat(whole.cast("string"), F.lit("%"))


def _one_decimal(x: Column) -> Column:
    """Halves of the exact value go up, so the doubled tenths decide."""
    return let(
        F.floor(x * 10.0 + 0.5),
        lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")),
    )


def file_size_text(size: Column) -> Column:
    """B, KB or MB with one decimal."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("0 B"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1_048_576, F.concat(_one_decimal(size / 1024), F.lit(" KB")))
        .otherwise(F.concat(_one_decimal(size / 1_048_576), F.lit(" MB")))
    )


def file_type_label(mime: Column) -> Column:
    """Short name of a MIME type; an unknown one stands for itself."""
    return F.coalesce(lookup(V.MIME_LABELS, mime), F.when(mime != "", mime), F.lit("File"))


def field_rows(results: DataFrame) -> DataFrame:
    """P5: one row per document and field, with label, display text and percent."""
    fields, conf = F.col("fields"), F.col("confidence")
    shown = {
        "vendor_name": fields["vendor_name"],
        "invoice_number": fields["invoice_number"],
        "invoice_date": F.when(fields["invoice_date"].isNotNull(), date_text(fields["invoice_date"])),
        "due_date": F.when(fields["due_date"].isNotNull(), date_text(fields["due_date"])),
        "total_amount": F.when(
            fields["total_amount"].isNotNull(), amount_text(fields["total_amount"], fields["currency"])
        ),
        "currency": fields["currency"],
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.lit(V.FIELD_LABELS[name]).alias("label"),
                shown[name].alias("display"),
                percent_text(conf[name]).alias("percent"),
            )
            for name in V.FIELDS
        ]
    )
    return results.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
