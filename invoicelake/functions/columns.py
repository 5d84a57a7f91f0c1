"""Small Column idioms shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F


def per_application(build: Callable) -> Callable:
    """Keep what ``build`` returns for as long as the application lives.

    Columns are immutable and know nothing of the frames they are used on.
    Putting a large one together takes thousands of calls to the JVM, so the
    large ones are made once and used by every query.
    """
    kept: dict = {}

    @wraps(build)
    def cached(*args):
        context = SparkContext._active_spark_context
        key = (context.applicationId, context.startTime, args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return cached


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def pinned(value: Column) -> Column:
    """Keep a costly column where it is computed.

    The optimizer writes filters, also those it infers for an explode, in terms
    of a projection's inputs and moves them below it, so all that the filter
    reads would be computed twice.  It does not do so for columns that depend on
    the partition, as this one formally does.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def first_of(items: Column) -> Column:
    """First array element, null for an empty array."""
    return F.try_element_at(items, F.lit(1))


def first_where(items: Column, test: Callable[[Column], Column], most: int) -> Column:
    """First of up to ``most`` elements that passes the test, else null.

    A filter tests every element; here the first one, the next few and the rest follow each other only if they must.
    """
    cuts = [n for n in (0, 1, 4) if n < most] + [most]
    spans = list(zip(cuts, cuts[1:], strict=False))
    return let(
        items, lambda x: F.coalesce(*[first_of(F.filter(F.slice(x, low + 1, high - low), test)) for low, high in spans])
    )


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null when it is missing."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def any_true(conditions: list[Column]) -> Column:
    result = conditions[0]
    for one in conditions[1:]:
        result = result | one
    return result


def all_true(conditions: list[Column]) -> Column:
    result = conditions[0]
    for one in conditions[1:]:
        result = result & one
    return result
