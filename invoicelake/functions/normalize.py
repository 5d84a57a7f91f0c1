"""Value normalisers (N1-N9): short strings to dates, numbers and currency codes.

All of them return null for what they cannot read, and none can raise: every
cast is a ``try_cast`` behind a check of the string's shape.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.columns import let, lookup
from invoicelake.functions.text import folded_pattern, strip


def _foreign_digits() -> tuple[str, str]:
    """All decimal digits outside ASCII, and the ASCII digits they stand for."""
    chars = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.digit(ch)) for ch in chars)


_FOREIGN, _ASCII = _foreign_digits()


def ascii_digits(c: Column) -> Column:
    """Digits of other scripts to 0-9; plain ASCII strings are passed through."""
    return let(
        c,
        lambda x: F.when(F.length(x) == F.octet_length(x), x).otherwise(F.translate(x, _FOREIGN, _ASCII)),
    )


# --- Dates ------------------------------------------------------------------

_ISO_SHAPE = r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"
_NUM_SHAPE = r"^\d{1,2}([-/.])\d{1,2}\1\d{4}$"
_DAY_MONTH_YEAR = r"(?iU)^(\d{1,2})\s+(" + V.MONTHS + r")\s+(\d{4})$"
_MONTH_DAY_YEAR = r"(?iU)^(" + V.MONTHS + r")\s+(\d{1,2}),?\s+(\d{4})$"
_DAY_MON_YEAR = r"(?i)^(\d{1,2})-([a-z]{3})-(\d{4})$"
_SHORT_YEAR = r"(?i)^(\d{1,2}/\d{1,2}/|\d{1,2}-[a-z]{3}-)"
_THIS_CENTURY = _SHORT_YEAR + r"([0-5]\d|6[0-8])$"
_LAST_CENTURY = _SHORT_YEAR + r"(69|[7-9]\d)$"


def _reordered(c: Column, order: str) -> Column:
    iso = F.regexp_replace(c, r"^(\d+)[-/.](\d+)[-/.](\d+)$", order)
    return iso.try_cast("date")


def _dated(year: Column, month_name: Column, day: Column) -> Column:
    # concat, not concat_ws: an unknown month must make the whole null
    month = lookup(V.MONTH_NUMBERS, F.lower(month_name))
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


def _named_month(c: Column, shape: str, day: int, month: int) -> Column:
    return _dated(F.regexp_extract(c, shape, 3), F.regexp_extract(c, shape, month), F.regexp_extract(c, shape, day))


# Dates as they are written nearly always; each ends with its four digits of the year or starts with them.
_USUAL_ISO = r"\A\d{4}-\d{1,2}-\d{1,2}\z"
_USUAL_NUM = r"\A\d{1,2}([-/.])\d{1,2}\1\d{4}\z"
_USUAL_DAY_MONTH = r"\A\d{1,2} [A-Za-z]{3,9} \d{4}\z"
_USUAL_MONTH_DAY = r"\A[A-Za-z]{3,9} \d{1,2},? \d{4}\z"


def _numeric_date(c: Column, prefer_dmy: bool) -> Column:
    slashed = F.substring_index(c, "/", 2) != c
    dmy, mdy = _reordered(c, "$3-$2-$1"), F.when(slashed, _reordered(c, "$3-$1-$2"))
    return F.coalesce(dmy, mdy) if prefer_dmy else F.coalesce(mdy, dmy)


def _usual_date(c: Column, prefer_dmy: bool, otherwise: Column) -> Column:
    """Dates of the usual shapes by plain patterns in compiled code; all others the long way."""
    low, high = V.DATE_YEARS

    def in_range(year: Column, value: Column) -> Column:
        return F.when(year.cast("int").between(low, high), value)

    last = F.right(c, F.lit(4))
    word = F.substring_index(F.substring_index(c, " ", 2), " ", -1)
    return (
        F.when(c.rlike(_USUAL_ISO), in_range(F.left(c, F.lit(4)), c.try_cast("date")))
        .when(c.rlike(_USUAL_NUM), in_range(last, _numeric_date(c, prefer_dmy)))
        .when(c.rlike(_USUAL_DAY_MONTH), in_range(last, _dated(last, word, F.substring_index(c, " ", 1))))
        .when(
            c.rlike(_USUAL_MONTH_DAY),
            in_range(last, _dated(last, F.substring_index(c, " ", 1), F.rtrim(word, F.lit(",")))),
        )
        .otherwise(otherwise)
    )


def _parse_date(c: Column, prefer_dmy: bool) -> Column:
    return (
        F.when(c.rlike(_NUM_SHAPE), _numeric_date(c, prefer_dmy))
        .when(c.rlike(_ISO_SHAPE), F.replace(c, F.lit("/"), F.lit("-")).try_cast("date"))
        .when(c.rlike(_DAY_MONTH_YEAR), _named_month(c, _DAY_MONTH_YEAR, 1, 2))
        .when(c.rlike(_MONTH_DAY_YEAR), _named_month(c, _MONTH_DAY_YEAR, 2, 1))
        .when(c.rlike(_DAY_MON_YEAR), _named_month(c, _DAY_MON_YEAR, 1, 2))
    )


def normalize_date(c: Column, prefer_dmy: bool = True) -> Column:
    """Date string to DATE, null outside the accepted years.

    Two-digit years are spelled out first: up to 68 they belong to this
    century, from 69 on to the last.  Day before month is tried first; with
    ``prefer_dmy=False`` month first, but only for four-digit years.
    """
    raw = ascii_digits(F.rtrim(strip(c), F.lit(V.DATE_TRAILING_PUNCTUATION)))
    low, high = V.DATE_YEARS

    def read(r: Column) -> Column:
        full = F.regexp_replace(r, _THIS_CENTURY, "$120$2")
        full = F.regexp_replace(full, _LAST_CENTURY, "$119$2")
        if prefer_dmy:
            return let(full, lambda f: _parse_date(f, True))
        return let(
            full,
            lambda f: F.when(f == r, _parse_date(f, False)).otherwise(_parse_date(f, True)),
        )

    long_way = let(let(raw, read), lambda d: F.when(F.year(d).between(low, high), d))
    return _usual_date(c, prefer_dmy, long_way)


def compute_due_date(invoice_date: Column, days: Column) -> Column:
    """``days`` after the invoice date; a null date gives null."""
    return F.date_add(invoice_date, days)


# --- Amounts ----------------------------------------------------------------

_CODES = "|".join(V.CURRENCY_CODES)


def strip_currency(c: Column) -> Column:
    """One currency code at either end, then one leading symbol, Rs. or RM."""
    bare = F.regexp_replace(c, r"(?iU)\A\s*(?:" + _CODES + r")\b\s*", "")
    bare = F.regexp_replace(bare, r"(?iU)\s*\b(?:" + _CODES + r")\s*\z", "")
    return strip(F.regexp_replace(strip(bare), r"(?iU)\A(?:[\$£€₹¥]|Rs\.?\s*|RM\s*)", ""))


def round2(x: Column) -> Column:
    """Two decimals, rounded on the exact binary value, exact ties to even.

    ``round`` looks at the shortest decimal text instead, which differs only
    when that text has exactly three decimals, the last a 5.  There the sign of
    the difference between the double and its text decides; it comes from
    an error-free product (the double is split into two halves).
    """

    def tie(t: Column) -> Column:
        value, product, mills = t["x"], t["p"], t["k"]
        scaled = value * F.lit(134217729.0)
        high = scaled - (scaled - value)
        low = value - high
        error = (high * 1000.0 - product) + low * 1000.0
        rest = (product - mills) + error
        down = F.floor(mills / 10.0)
        up = (rest > 0) | ((rest == 0) & (down % 2 == 1))
        return (down + F.when(up, 1).otherwise(0)) / 100.0

    def decide(t: Column) -> Column:
        three_decimals = (t["k"] / 1000.0 == t["x"]) & (t["k"] % 10 == 5)
        return F.when(three_decimals, tie(t)).otherwise(F.round(t["x"], 2))

    product = F.struct(x.alias("x"), (x * 1000.0).alias("p"), F.rint(x * 1000.0).alias("k"))
    return let(product, decide)


_SPACED = r"(?U)^\d[\d ]*\d(?:[.,]\d+)?$"
_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"


def _decimal_text(t: Column) -> Column:
    """The separators of a number resolved, so that at most one dot is left."""
    comma, dot = F.lit(","), F.lit(".")
    no_comma, no_dot = F.replace(t, comma), F.replace(t, dot)
    commas, dots = F.length(t) - F.length(no_comma), F.length(t) - F.length(no_dot)
    behind_comma = F.length(F.substring_index(t, ",", -1))
    behind_dot = F.length(F.substring_index(t, ".", -1))
    return (
        F.when(
            (commas > 0) & (dots > 0),
            F.when(behind_comma < behind_dot, F.replace(no_dot, comma, dot)).otherwise(no_comma),
        )
        .when(
            commas > 0,
            F.when((commas == 1) & (behind_comma <= 2), F.replace(t, comma, dot)).otherwise(no_comma),
        )
        .when(dots > 1, no_dot)
        .otherwise(t)
    )


def parse_numeric(c: Column) -> Column:
    """Number with US, European, Indian or space separators to double."""
    text = F.replace(ascii_digits(strip(c)), F.lit("\u00a0"))
    packed = let(text, lambda t: F.when(t.rlike(_SPACED), F.replace(t, F.lit(" "))).otherwise(t))

    def read(t: Column) -> Column:
        return F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_")).try_cast("double"))

    value = let(let(packed, _decimal_text), read)
    return let(
        value, lambda v: F.when((v >= 0) & (v <= V.AMOUNT_LIMIT), round2(v))
    )


# An amount as it is written nearly always: a symbol or code, then digits that are plain or grouped in one way.
_USUAL_AMOUNT = (
    r"\A(?:[\$£€₹¥] ?|Rs\.? ?|(?:" + _CODES + r") )?("
    r"\d{1,12}(?:\.\d{1,2})?|\d{1,3}(?:,\d{2,3})*,\d{3}(?:\.\d{1,2})?|\d{1,3}(?:\.\d{3})+,\d{1,2}|\d{1,3}(?: \d{3})+(?:\.\d{1,2})?"
    r")\z"
)


def _usual_amount(c: Column) -> Column:
    """Amounts of the usual shapes by one plain pattern in compiled code; null for all others.

    At most two decimals and at most the limit, so there is nothing to round.
    """

    def read(number: Column) -> Column:
        european = number.rlike(r",\d{1,2}\z")
        plain = F.when(european, F.translate(number, ",.", ".")).otherwise(F.translate(number, ", ", ""))
        return F.when(number != "", plain.try_cast("double"))

    # the pattern runs once for an amount, also where Spark evaluates expressions without sharing their parts
    value = let(F.regexp_extract(c, _USUAL_AMOUNT, 1), read)
    return let(value, lambda v: F.when(v <= V.AMOUNT_LIMIT, v))


def normalize_amount(c: Column) -> Column:
    """Amount string, with or without currency and K or M, to double."""

    def read(s: Column) -> Column:
        suffixed = s.rlike(r"(?U)^[\d,. ]+\s*[KkMm]$")
        body = F.when(suffixed, F.left(s, F.length(s) - 1)).otherwise(s)
        factor = F.when(suffixed, lookup(V.MAGNITUDES, F.upper(F.right(s, F.lit(1)))))
        return F.struct(parse_numeric(body).alias("base"), factor.alias("factor"))

    def scale(t: Column) -> Column:
        return F.when(t["factor"].isNull(), t["base"]).otherwise(round2(t["base"] * t["factor"]))

    return F.coalesce(_usual_amount(c), let(let(strip_currency(c), read), scale))


# --- Currency ---------------------------------------------------------------


def normalize_currency(c: Column) -> Column:
    """Currency word or symbol to ISO code; other three-letter words pass through."""
    return let(
        strip(c),
        lambda s: F.coalesce(
            lookup(V.CURRENCY_MAP, F.lower(s)),
            F.when(F.upper(s).rlike("^[A-Z]{3}$"), F.upper(s)),
        ),
    )


def detect_currency(c: Column, folded: bool = False) -> Column:
    """First currency word or symbol of a text, or folded text, as ISO code."""
    pattern = folded_pattern(V.CURRENCY_IN_TEXT) if folded else V.CURRENCY_IN_TEXT
    return normalize_currency(F.regexp_extract(c, pattern, 0))


def truncate_name(c: Column) -> Column:
    """Names are cut to their maximal length."""
    return F.left(c, F.lit(V.VENDOR_MAX_CHARS))
