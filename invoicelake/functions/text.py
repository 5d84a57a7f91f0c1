"""Text projections and predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.columns import any_true, first_of, let


def stripped(x: Column) -> Column:
    """``strip`` for what is at hand, as an element of an array; it is read several times."""
    # only what begins with a visible ASCII character lies between these
    visible = (x >= "!") & (x < "\x7f") & F.substring(x, -1, 1).between("!", "~")
    return F.when(visible, x).otherwise(F.btrim(x, F.lit(V.WHITESPACE)))


def strip(c: Column) -> Column:
    """Both ends freed of all Unicode white space (plain ``trim`` only drops spaces).

    What begins and ends with a visible ASCII character stays as it is; trimming would look at all of it.
    """
    return let(c, stripped)


def norm_newlines(c: Column) -> Column:
    """CRLF and CR to LF; tabs and runs are kept, which tables need."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_text(c: Column) -> Column:
    """Newlines unified, blanks collapsed, at most one empty line in a row, stripped."""
    spaced = F.replace(norm_newlines(c), F.lit("\t"), F.lit(" "))
    for run, pattern, single in (("  ", " {2,}", " "), ("\n\n\n", "\n{3,}", "\n\n")):
        # the pattern only runs where there is something to collapse
        spaced = let(
            spaced,
            lambda x, run=run, pattern=pattern, single=single: F.when(
                F.contains(x, F.lit(run)), F.regexp_replace(x, pattern, single)
            ).otherwise(x),
        )
    return strip(spaced)


def lines(c: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    return let(
        F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), V.LINE_BREAK),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


def head_lines(c: Column, n: int) -> Column:
    """T5: the first ``n`` lines; the text behind them is cut off before splitting."""
    return F.slice(lines(F.substring_index(c, "\n", n)), 1, n)


def total_line(clean: Column, folded: bool = False) -> Column:
    """T4: first line naming a total, or null; of the folded text if that is given."""
    pattern = folded_pattern(V.TOTAL_LINE) if folded else V.TOTAL_LINE
    return first_of(F.filter(lines(clean), lambda x: x.rlike(pattern)))


def raw_text_length(c: Column) -> Column:
    """Characters of the uncleaned text."""
    return F.length(c)


def present(c: Column) -> Column:
    """Neither null nor the empty string."""
    return c.isNotNull() & (c.cast("string") != "")


def fields_found(fields: Column, with_items: bool = True) -> Column:
    """How many fields of a result struct hold a value."""
    found = [F.when(present(fields[name]), 1).otherwise(0) for name in V.FIELDS]
    if with_items:
        found.append(F.when(F.size(fields["line_items"]) > 0, 1).otherwise(0))
    total = found[0]
    for one in found[1:]:
        total = total + one
    return total


def fold(c: Column) -> Column:
    """Lower case, with the letters that case-insensitive matching takes for i and s.

    A pattern that ignores case finds exactly what its lower-case form finds in
    the folded text, but the latter is a plain search and several times faster.
    """
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.lower(c)


def folded_pattern(pattern: str) -> str:
    """Lower-case form of a pattern that ignores case, for use on folded text.

    The rule patterns hold no upper-case escapes, so all of it can be lowered.
    """
    flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    if re.search(r"\\[A-Z]", body):
        raise ValueError(f"upper-case escape in {pattern}")
    return flags.replace("i", "") + body.lower()


def contains_any(c: Column, words: list[str]) -> Column:
    return any_true([F.contains(c, F.lit(w)) for w in words])
