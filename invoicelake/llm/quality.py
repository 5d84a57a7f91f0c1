"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies and ablations work on the bits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicelake.functions.columns import pinned

# White space between words, symbols that are counted.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
_SPLIT, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Words of a window whose repetition counts.
WINDOW = 8

#: Rules in the order of their bits: name, and what fails. Measurements are n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.
RULES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("too_few_words", lambda: F.col("n_words") < 20),
    ("too_many_repeats", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    ("too_many_symbols", lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words")),
    ("too_many_equal_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    ("words_too_short", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("words_too_long", lambda: F.col("word_chars") > 20 * F.col("n_words")),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["too_many_repeats"]
#: Versions of the policy: which bits reject a document.
POLICIES: Mapping[str, int] = {
    "base": BASE,
    "v1": BASE | BITS["too_many_symbols"] | BITS["too_many_equal_lines"] | BITS["words_too_short"] | BITS["words_too_long"],
}


def _repeated_words() -> tuple[Column, Column]:
    """Windows as sorted (hash, place) pairs, and from those the places of the windows that occur twice or more.

    Windows are compared by a 64-bit hash. Few texts repeat one, so the sort runs only for those.
    """
    pairs = F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    places = F.filter(
        F.transform(
            "sorted_windows",
            lambda x, k: F.when(
                (F.get("sorted_windows", k - 1)["h"] == x["h"]) | (F.get("sorted_windows", k + 1)["h"] == x["h"]), x["k"]
            ),
        ),
        lambda k: k.isNotNull(),
    )
    return pairs, F.sort_array(places)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements of the whole text, computed in one projection without a shuffle.

    Null and empty texts have zero words, lines and symbols. Columns of the same names are replaced, others pass.
    n_symbols counts occurrences, n_dup_lines the lines with a word that equal an earlier line, n_repeat_words the
    words covered by 8-word windows found twice or more in the text, the first occurrence included.

    The last measurement is pinned, so a filter on any of them is not moved below, where it would compute them anew
    for every word.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = docs.columns
    pairs, places = _repeated_words()
    no_longs = F.array().cast("array<bigint>")
    out = (
        docs.withColumns(
            {
                "words": F.array_remove(F.split(body, _SPLIT), ""),
                "lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(_WORD)),
                "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            }
        )
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "n_lines": F.size("lines").cast("long"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
                "windows": F.when(
                    F.size("words") >= WINDOW,
                    F.transform(
                        F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))),
                        lambda k: F.xxhash64(F.slice("words", k, WINDOW)),
                    ),
                ).otherwise(no_longs),
            }
        )
        .withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
        .withColumn("sorted_windows", F.when(F.col("repeats"), pairs))
        .withColumn("places", F.when(F.col("repeats"), places))
        .withColumn(
            "n_repeat_words",
            F.when(
                F.col("repeats"),
                F.aggregate(
                    F.transform("places", lambda p, k: F.least(F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
            ).otherwise(F.lit(0).cast("long")),
        )
    )
    measured = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    taken = {m.lower() for m in measured}
    out = out.withColumn("n_repeat_words", pinned(F.col("n_repeat_words")))
    return out.select(*[c for c in kept if c.lower() not in taken], *measured)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`measure` with `failed_bits`: bit k is set if rule k fails. Every rule is evaluated once per document."""
    bits = None
    for k, (_, fails) in enumerate(RULES):
        bit = F.when(fails(), F.lit(1 << k)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed_bits", pinned(bits.cast("long")))


def passes(policy: str) -> Column:
    """Whether a document of a ledger passes a version of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def sole_rule(policy: str) -> Column:
    """Name of the rule that alone rejects a document under the policy; null if none or several do."""
    failed = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]))
    return F.coalesce(*[F.when(failed == bit, name) for name, bit in BITS.items()])


def ablations(book: DataFrame, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule of it: how many documents it rejects, and how many would be kept without that rule.

    The ledger is first counted by its bits, at most 2 ** rules rows, so policies cost nothing more.
    """
    counts = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    cases = [(p, name, POLICIES[p], BITS[name]) for p in policies for name in BITS if POLICIES[p] & BITS[name]]
    table = F.array(
        *[
            F.struct(
                F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(mask).alias("mask"), F.lit(bit).alias("bit")
            )
            for p, name, mask, bit in cases
        ]
    )
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return (
        counts.select("failed_bits", "n", F.inline(table))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("kept_without_rule"),
        )
    )
