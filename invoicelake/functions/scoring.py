"""Fusion, checks and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.normalize import round2


def _found(value: Column, confidence: Column) -> Column:
    return value.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) > 0)


def boosted(confidence: Column) -> Column:
    return F.least(confidence + F.lit(V.AGREEMENT_BONUS), F.lit(1.0))


def agree(a: Column, b: Column) -> Column:
    """One text contains the other, whatever the case."""
    left, right = F.lower(a), F.lower(b)
    return F.contains(left, right) | F.contains(right, left)


def number_text(c: Column) -> Column:
    """A rounded number the way it is compared: at least one decimal, no idle zero."""
    return F.regexp_replace(F.format_string("%.2f", c), "0$", "")


def fuse(
    rule_value: Column,
    rule_confidence: Column,
    entity_value: Column,
    entity_confidence: Column,
    as_text=lambda c: c.cast("string"),
) -> Column:
    """the rule wins; agreement of both raises its confidence."""
    by_rule = _found(rule_value, rule_confidence)
    by_entity = _found(entity_value, entity_confidence)
    same = agree(F.trim(as_text(rule_value)), F.trim(as_text(entity_value)))

    def outcome(value: Column, confidence: Column, source: str) -> Column:
        return F.struct(
            value.alias("value"), confidence.alias("confidence"), F.lit(source).alias("source")
        )

    return (
        F.when(by_rule & by_entity & same, outcome(rule_value, boosted(rule_confidence), "regex+nlp"))
        .when(by_rule, outcome(rule_value, rule_confidence, "regex"))
        .when(by_entity, outcome(entity_value, entity_confidence, "nlp"))
        .otherwise(outcome(F.lit(None), F.lit(0.0), "none"))
    )


def fuse_vendor(
    entity_value: Column, entity_confidence: Column, label_value: Column, label_confidence: Column
) -> Column:
    """V2: on agreement the more certain name, the entity on a tie; else the label."""
    both = entity_value.isNotNull() & label_value.isNotNull() & (entity_value != "") & (label_value != "")

    def outcome(value: Column, confidence: Column, source: str) -> Column:
        return F.struct(
            value.alias("value"), confidence.alias("confidence"), F.lit(source).alias("source")
        )

    entity_first = entity_confidence >= label_confidence
    same = agree(entity_value, label_value)
    return (
        F.when(both & same & entity_first, outcome(entity_value, boosted(entity_confidence), "regex+nlp"))
        .when(both & same, outcome(label_value, boosted(label_confidence), "regex+nlp"))
        .when(label_value.isNotNull() & (label_value != ""), outcome(label_value, label_confidence, "regex"))
        .when(entity_value.isNotNull(), outcome(entity_value, entity_confidence, "nlp"))
    )


def date_warning(invoice_date: Column, due_date: Column) -> Column:
    """text when the due date lies before the invoice date, else null."""
    return F.when(
        due_date < invoice_date,
        F.format_string(V.DATE_WARNING, due_date.cast("string"), invoice_date.cast("string")),
    )


def items_total(items: Column) -> Column:
    """Sum of the item amounts that are known, 0.0 if none is."""
    known = F.filter(items, lambda i: i["amount"].isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda total, i: total + i["amount"])


def sum_warning(total_amount: Column, total_of_items: Column) -> Column:
    """text when the total falls short of the items by more than the slack, else null."""
    short = (total_of_items > 0) & (total_amount < total_of_items * F.lit(V.SUM_CHECK_SLACK))
    amounts = [F.format_string("%.2f", round2(c)) for c in (total_amount, total_of_items)]
    return F.when(short, F.format_string(V.SUM_WARNING, *amounts))


def extraction_warnings(*warnings: Column) -> Column:
    """the warnings that are there, in order."""
    return F.filter(F.array(*warnings), lambda w: w.isNotNull())


def overall_confidence(confidences: list[Column]) -> Column:
    """mean of the confidences above zero, two decimals, 0.0 if there is none."""
    scores = F.filter(F.array(*confidences), lambda x: x > 0)
    mean = F.aggregate(
        scores,
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((acc["total"] + x).alias("total"), (acc["n"] + 1).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"]).otherwise(F.lit(0.0)),
    )
    return round2(mean)


def tier(confidence: Column, scale: str = "display") -> Column:
    """name of the confidence band on one of the two scales."""
    bands = V.TIER_SCALES[scale]
    named = F.when(confidence >= bands[0][0], bands[0][1])
    for low, name in bands[1:]:
        named = named.when(confidence >= low, name)
    if scale == "display":
        named = named.when(confidence > 0, "low")
    else:
        named = named.when(confidence > 0, "weak")
    return named.otherwise("not_found")
