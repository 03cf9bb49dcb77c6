"""Numbers from text, and the ratios that reports show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, trimmed

# Currency signs dropped from amounts, and the bounds of the year-over-year classes.
CURRENCY_SIGNS = "$€£¥₹₩₫₱฿₦₴₽₪₺₡₲₵₭₮₸₼₾₿"
CLASSES = ((0.10, "within_10"), (0.30, "within_30"), (0.50, "within_50"))


def with_separator(c: Column, separator: Column) -> Column:
    """A number's text with its decimal separator (',' or '.') made a point and the other dropped; others unchanged."""
    comma = F.replace(F.replace(trimmed(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    point = F.when(c.contains(","), F.replace(trimmed(c), F.lit(","), F.lit(""))).otherwise(c)
    mark = trimmed(separator)
    return F.when(mark == ",", comma).when(mark == ".", point).otherwise(c)


def clean_amount(c: Column, separator: Column) -> Column:
    """An amount without runs of two to five letters and currency signs."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), "[A-Za-z]{2,5}", ""), f"[{CURRENCY_SIGNS}]", ""))
    return F.when(is_blank(c), c).otherwise(with_separator(bare, separator))


def clean_quantity(c: Column, separator: Column) -> Column:
    """The first number in a text. Dashes become blanks first, so a minus sign is lost; without a number the text stays."""
    text = F.regexp_replace(trimmed(c), "[-‐-―−]", " ")
    # runs of digits with blanks or one mark between them, or a fraction without a whole part
    number = F.regexp_extract(text, r"\d++(?:\s*+[.,]?\s*+\d++)*|[.,]\s*\d+", 0)
    found = F.when(number != "", F.regexp_replace(number, r"\s+", "")).otherwise(text)
    return F.when(is_blank(c), c).otherwise(with_separator(found, separator))


def to_number(c: Column) -> Column:
    """A finite double from text without thousands commas; null where it is none."""
    text = F.replace(trimmed(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def percent_difference(current: Column, previous: Column) -> Column:
    """(current - previous) / |previous|; null if either is missing; from zero: 0 to zero, else infinite."""
    from_zero = F.when(current == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    safe = F.when(previous != 0, F.abs(previous))
    return F.when(current.isNull() | previous.isNull(), None).when(previous == 0, from_zero).otherwise((current - previous) / safe)


def difference_class(p: Column) -> Column:
    out = F.when(p.isNull(), "missing")
    for bound, name in CLASSES:
        out = out.when(F.abs(p) <= bound, name)
    return out.otherwise("over_50")


def completeness_class(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "missing").when(ratio >= 1, "complete").when(ratio >= 0.5, "over_half").when(ratio >= 0.25, "over_quarter").otherwise("low")


def shown_difference(p: Column) -> Column:
    """A difference as a dashboard shows it: a signed percentage, >999% where it is infinite."""
    return F.when(p.isNull(), "missing").when(F.abs(p) == float("inf"), ">999%").otherwise(F.format_string("%+.1f%%", p * 100))


def exported_difference(p: Column) -> Column:
    """A difference as an export holds it: four decimals, null where it is missing or infinite."""
    return F.when(F.abs(p) != float("inf"), F.round(p, 4))
