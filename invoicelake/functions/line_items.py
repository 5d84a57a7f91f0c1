"""Line items out of aligned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.columns import first_of, let
from invoicelake.functions.normalize import normalize_amount
from invoicelake.functions.text import contains_any, fold, lines, norm_newlines, strip

ITEM_TYPE = "array<struct<description:string,quantity:double,unit_price:double,amount:double>>"


def is_header(line: Column) -> Column:
    """L1: names the description column and a quantity or a price column."""
    return let(
        fold(line),
        lambda x: contains_any(x, V.ITEM_HEADER)
        & contains_any(x, V.ITEM_HEADER_QUANTITY + V.ITEM_HEADER_PRICE),
    )


def _with_first(found: Column, test) -> Column:
    """The lines, and the position of the first that passes the test, 0 if none does."""
    return let(
        found,
        lambda l: F.struct(
            l.alias("l"), F.array_position(F.transform(l, lambda x: test(x)), True).alias("at")
        ),
    )


def _behind_header(all_lines: Column) -> Column:
    return let(
        _with_first(all_lines, is_header),
        lambda t: F.when(t["at"] > 0, F.slice(t["l"], t["at"].cast("int") + 1, F.size(t["l"]))),
    )


def _before_stop(stripped: Column) -> Column:
    """L2: cut at the first line that opens the totals."""
    return let(
        _with_first(stripped, lambda x: x.rlike(V.ITEM_STOP)),
        lambda t: F.when(t["at"] > 0, F.slice(t["l"], 1, t["at"].cast("int") - 1)).otherwise(t["l"]),
    )


def _columns(stripped: Column) -> Column:
    """L3: cells between gaps of two or more blanks, or tabs.

    A gap takes all white space around it and the lines are stripped, so the
    cells come out stripped and none is empty.  Every tab is part of a gap, so
    gaps can be made tabs, by a pattern that is compiled once, and split there.
    """
    rows = F.transform(stripped, lambda x: F.split(F.regexp_replace(x, V.ITEM_COLUMN_GAP, "\t"), "\t"))
    return F.filter(rows, lambda cells: F.size(cells) >= 2)


def is_number(cell: Column) -> Column:
    """L4."""
    return cell.rlike(V.ITEM_NUMBER)


def _split_roles(cells: Column) -> Column:
    marked = F.transform(cells, lambda x: F.struct(x.alias("text"), is_number(x).alias("number")))
    return let(
        marked,
        lambda m: F.struct(
            F.array_join(F.filter(m, lambda x: ~x["number"])["text"], " ").alias("text"),
            F.transform(F.filter(m, lambda x: x["number"])["text"], lambda x: normalize_amount(x)).alias("numbers"),
        ),
    )


def _item(row: Column) -> Column:
    """Last number is the amount, the one before the unit price; of the rest the
    first whole one within the limit is the quantity."""
    numbers, count = row["numbers"], F.size(row["numbers"])
    rest = F.slice(numbers, 1, F.greatest(count - 2, F.lit(0)))
    whole = F.filter(rest, lambda v: (v == F.floor(v)) & (v <= V.ITEM_MAX_QUANTITY))
    text = row["text"]
    return F.struct(
        F.when(text != "", text).alias("description"),
        first_of(whole).alias("quantity"),
        F.when(count >= 2, F.try_element_at(numbers, F.lit(-2))).alias("unit_price"),
        F.try_element_at(numbers, F.lit(-1)).alias("amount"),
    )


def line_items(raw: Column) -> Column:
    """Items of the first table of a text; an empty array when there is none."""
    body = _behind_header(lines(norm_newlines(raw)))
    stripped = F.filter(F.transform(body, strip), lambda x: x != "")
    rows = _columns(_before_stop(stripped))
    parsed = F.filter(F.transform(rows, _split_roles), lambda r: F.size(r["numbers"]) > 0)
    items = F.filter(
        F.transform(parsed, _item),
        lambda i: i["description"].isNotNull() | i["quantity"].isNotNull() | i["amount"].isNotNull(),
    )
    return F.coalesce(items.cast(ITEM_TYPE), F.array().cast(ITEM_TYPE))


def explode_line_items(results: DataFrame, items: str = "fields.line_items") -> DataFrame:
    """One row per item with its number; documents without items give no row."""
    kept = results.select("doc_id", F.posexplode(items).alias("pos", "item"))
    return kept.select("doc_id", (F.col("pos") + 1).alias("item_no"), "item.*")


def item_columns(items: Column) -> Column:
    """Which of the optional item columns hold any value."""

    def known(name: str) -> Column:
        return F.exists(items, lambda i: i[name].isNotNull()).alias("has_" + name)

    return F.struct(*[known(name) for name in ("quantity", "unit_price", "amount")])
