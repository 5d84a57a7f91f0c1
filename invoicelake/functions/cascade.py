"""Rule cascades (C1, C4): the first rule whose value can be read wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, functions as F

from invoicelake.functions.columns import first_of, let
from invoicelake.functions.rules import Rule, Words
from invoicelake.functions.text import folded_pattern

Normalizer = Callable[[Column], Column]


def _winner(rule: Rule, value: Column) -> Column:
    return F.struct(
        value.alias("value"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.rule_no).alias("rule_no"),
    )


def first_match(
    text: Column, folded: Column, rules: list[Rule], words: Words, normalizer: Normalizer
) -> Column:
    """C1 for fields whose matches are always readable: stops at the first rule that hits.

    The search runs on the folded text; only the winner reads the text itself,
    for the case of its value.
    """
    return F.coalesce(
        *[
            F.when(
                words.may_match(rule) & folded.rlike(folded_pattern(rule.pattern)),
                _winner(rule, normalizer(F.regexp_extract(text, rule.pattern, rule.group))),
            )
            for rule in rules
        ]
    )


def _hit(text: Column, rule: Rule) -> Column:
    return F.struct(
        F.regexp_extract(text, rule.pattern, rule.group).alias("raw"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.rule_no).alias("rule_no"),
    )


def hits(text: Column, rules: list[Rule], words: Words) -> Column:
    """All rules that hit, in order: array of (raw, confidence, rule_no)."""
    found = [F.when(words.may_match(rule), _hit(text, rule)) for rule in rules]
    return F.filter(F.array(*found), lambda h: h["raw"] != "")


def cascade(folded: Column, rules: list[Rule], words: Words, normalizer: Normalizer) -> Column:
    """Struct (value, confidence, rule_no) of the first rule whose value can be read.

    The first rule that hits is nearly always readable, and then the rules
    behind it are not tried.  Otherwise all hits are collected and read in order.
    """
    patterns = [replace(rule, pattern=folded_pattern(rule.pattern)) for rule in rules]

    def read(h: Column) -> Column:
        return F.struct(normalizer(h["raw"]).alias("value"), h["confidence"], h["rule_no"])

    def readable(found: Column) -> Column:
        return first_of(F.filter(F.transform(found, lambda h: read(h)), lambda h: h["value"].isNotNull()))

    first = F.coalesce(
        *[
            F.when(words.may_match(rule), let(_hit(folded, rule), lambda h: F.when(h["raw"] != "", h)))
            for rule in patterns
        ]
    )
    return let(
        first,
        lambda h: F.when(
            h.isNotNull(), F.coalesce(readable(F.array(h)), readable(hits(folded, patterns, words)))
        ),
    )


def first_valid(text: Column, pattern: str, normalizer: Normalizer) -> Column:
    """C4: of all matches of a pattern, the value of the first that can be read."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return first_of(F.filter(F.transform(matches, lambda m: normalizer(m)), lambda v: v.isNotNull()))
