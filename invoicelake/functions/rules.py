"""Rule sets as data, and the pre-checks that make them cheap.

A rule is one pattern of one field.  ``needs`` lists literals without which
the pattern cannot match: every group must have at least one member in the
folded text.  The check is exact, so it only saves work: a text without the
word "total" never starts the total patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from invoicelake.functions import fixed_values as V
from invoicelake.functions.columns import all_true, any_true

Needs = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Rule:
    field: str
    rule_no: int
    pattern: str
    group: int
    confidence: float
    needs: Needs = ()


def rule_set(
    field: str,
    patterns: list[tuple[str, float]],
    group: int = 1,
    needs: list[Needs] | None = None,
) -> list[Rule]:
    """Number the patterns of a field in their order; the order decides, not the confidence."""
    return [
        Rule(field, no, pattern, group, confidence, needs[no] if needs else ())
        for no, (pattern, confidence) in enumerate(patterns)
    ]


_INVOICE_DATE_NEEDS: Needs = (("invoice",), ("date",))
_ISSUED_NEEDS: Needs = (("date", "issue"),)
_DATE_NEEDS: Needs = (("date",),)
_DUE_DATE_NEEDS: Needs = (("due",), ("date",))
_PAY_BY_NEEDS: Needs = (("due", "pay"),)

INVOICE_NUMBER = rule_set(
    "invoice_number",
    V.INVOICE_NUMBER,
    needs=[(("invoice",),), (("bill",),), (("receipt",),), (("ref",),), ()],
)
INVOICE_DATE = rule_set(
    "invoice_date",
    V.INVOICE_DATE,
    needs=[_INVOICE_DATE_NEEDS] * 4 + [_ISSUED_NEEDS] * 3 + [_DATE_NEEDS] * 4,
)
DUE_DATE = rule_set(
    "due_date",
    V.DUE_DATE,
    needs=[_DUE_DATE_NEEDS] * 3
    + [(("payment",), ("due",))]
    + [_PAY_BY_NEEDS] * 2
    + [(("payment",), ("date",))],
)
TOTAL_AMOUNT = rule_set(
    "total_amount",
    V.TOTAL_AMOUNT,
    group=V.TOTAL_AMOUNT_GROUP,
    needs=[
        (("grand",), ("total",)),
        (("total",), ("amount",), ("due",)),
        (("amount",), ("due",)),
        (("due",), ("balance", "net", "total")),
        (("payable",),),
        (("total",),),
    ],
)
VENDOR_LABELED = rule_set(
    "vendor_name",
    V.VENDOR_LABELED,
    needs=[
        (("from", "vendor", "bill", "seller", "supplier"),),
        (("company",),),
        (("service",), ("provider",)),
    ],
)
PO_NUMBER = rule_set("po_number", V.PO_NUMBER, needs=[(("po",), ("no", "num", "#")), (("order",), ("no", "num", "#"))])
DELIVERY_DATE = rule_set("delivery_date", V.DELIVERY_DATE, needs=[(("deliver",),)] * len(V.DELIVERY_DATE))
INVOICE_RULES = INVOICE_NUMBER + INVOICE_DATE + DUE_DATE + TOTAL_AMOUNT + VENDOR_LABELED


class Words:
    """Which literals a text holds, as boolean columns computed once per row."""

    def __init__(self, rules: list[Rule], extra: tuple[str, ...] = (), prefix: str = "_has"):
        found = {word for rule in rules for group in rule.needs for word in group}
        self.words = sorted(found | set(extra))
        self.prefix = prefix

    def column(self, folded: Column) -> Column:
        return F.struct(*[F.contains(folded, F.lit(w)).alias(w) for w in self.words])

    def has(self, word: str) -> Column:
        return F.col(self.prefix)[word]

    def may_match(self, rule: Rule) -> Column:
        if not rule.needs:
            return F.lit(True)
        return all_true([any_true([self.has(w) for w in group]) for group in rule.needs])
