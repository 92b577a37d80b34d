"""Text shown next to a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names on axis labels.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def plain_label(value: Column) -> Column:
    return value.cast("string")


def month_label(value: Column) -> Column:
    number = value.cast("int")
    return F.when(number.between(1, 12), F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), number))


def hour_label(value: Column) -> Column:
    return F.concat(F.lpad(value.cast("int").cast("string"), 2, "0"), F.lit(":00"))


def percent_label(value: Column) -> Column:
    return F.concat(value.cast("int").cast("string"), F.lit("%"))


def degree_label(value: Column) -> Column:
    return F.concat(value.cast("int").cast("string"), F.lit("°C"))


def item_text(items: Column | str) -> Column:
    """Item set as one text: sorted, comma separated."""
    return F.array_join(F.array_sort(items), ", ")


def sentence_case(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000)))
