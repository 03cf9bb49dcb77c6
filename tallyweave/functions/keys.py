"""Keys for duplicate marking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, trimmed

# Date formats tried in this order; day first.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd/MM/yy", "MM/dd/yy", "dd.MM.yyyy", "dd.MM.yy", "d MMM yyyy", "d MMMM yyyy")


def key_date(c: Column) -> Column:
    """A date's text in ISO form by the first format that fits; other text as key_text()."""
    text = trimmed(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(F.date_format(F.coalesce(*(F.try_to_date(text, f) for f in DATE_FORMATS)), "yyyy-MM-dd"), _filled(key_text(c)))


def key_number(c: Column) -> Column:
    """A number's text to six decimals without trailing zeros; text that is no number keeps its digits and minus signs.

    Of ',' and '.' the later is the decimal mark. Alone, ',' is one before one or two digits, '.' is none before three or more.
    """
    t = F.regexp_replace(c, r"[^0-9,.\-]", "")
    comma, point = t.contains(","), t.contains(".")
    point_last = F.instr(F.reverse(t), ".") < F.instr(F.reverse(t), ",")
    decimal = F.when(comma & point, F.when(point_last, ".").otherwise(",")).when(comma & t.rlike(r",\d{1,2}$"), ",").when(point & ~comma & ~t.rlike(r"\.\d{3,}$"), ".").otherwise("")
    plain = F.when(decimal == ",", F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(decimal == ".", F.replace(t, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(t, "[.,]", ""))
    return _bound(plain, lambda x: F.coalesce(plain_number(F.when(x.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), x).try_cast("double")), _filled(F.regexp_replace(x, "[^0-9\\-]", ""))))


def plain_number(c: Column) -> Column:
    """A double as key_number() writes it."""
    return _bound(c, lambda x: F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _bound(c: Column, use) -> Column:
    """use(c), with c computed once however often it is read."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def key_text(c: Column) -> Column:
    """Letters a to z and digits; all others are dropped."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def business_key(dates: dict[str, Column], numbers: dict[str, Column], texts: dict[str, Column], typed: bool = False) -> Column:
    """SHA-256 of name=value parts; null with fewer than three parts, or without a date or number.

    typed: dates and numbers are columns of those types, not texts, and need no parsing; their keys are the same.
    """
    date, number = (lambda c: F.date_format(c, "yyyy-MM-dd"), plain_number) if typed else (key_date, key_number)
    strong = [F.concat(F.lit(f"{k}="), date(c)) for k, c in dates.items()] + [F.concat(F.lit(f"{k}="), number(c)) for k, c in numbers.items()]
    weak = [F.when(~is_blank(c), F.concat(F.lit(f"{k}="), key_text(c))) for k, c in texts.items()]
    parts = F.struct(F.array_compact(F.array(*strong)).alias("strong"), F.array_compact(F.array(*weak)).alias("weak"))

    def hashed(p: Column) -> Column:
        enough = (F.size(p["strong"]) >= 1) & (F.size(p["strong"]) + F.size(p["weak"]) >= 3)
        return F.when(enough, F.sha2(F.concat_ws("|", F.array_sort(F.concat(p["strong"], p["weak"]))), 256))

    return _bound(parts, hashed)


def hash128(*columns: Column) -> Column:
    """Two 64-bit hashes of typed columns as 32 hex digits; nulls differ from all values. Far cheaper than a digest of their texts, for grouping equal rows."""
    there = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)))
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), there, *columns)), 16, "0") for seed in (17, 71)))


def typed_key(dates: list[Column], numbers: list[Column], texts: list[Column]) -> Column:
    """business_key() of columns that are dates and numbers already, as a hash128(): the same rows have equal keys, and the same have none."""
    strong = [*dates, *(F.round(n, 6) + F.lit(0.0) for n in numbers)]
    weak = [F.when(~is_blank(t), key_text(t)) for t in texts]
    n = lambda cs: reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cs))
    return F.when((n([*dates, *numbers]) >= 1) & (n([*dates, *numbers]) + n(texts) >= 3), hash128(*strong, *weak))


def row_hash(*columns: str) -> Column:
    """SHA-256 of columns by name, for rows that are no JSON text: names are sorted, so their order does not matter."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def content_hash(json_text: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and plain numbers, so that spelling and order do not matter."""
    return F.sha2(F.to_json(F.try_parse_json(json_text)), 256)
