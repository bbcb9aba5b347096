"""Typed conversion of cell texts: each gives (value, error); a null text gives neither."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DATES, TIMES
from .text import NULL_TOKENS, clean_text, norm_text

Pair = tuple[Column, Column]
#: Default tokens of booleans.
TRUE = ("true", "是", "y", "yes", "1", "√", "✓", "开", "on")
FALSE = ("false", "否", "n", "no", "0", "×", "✗", "关", "off")


def _pair(text: Column, value: Column, code: str) -> Pair:
    return value, F.when(text.isNotNull() & value.isNull(), F.lit(code))


def cell(text: Column, null_tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """A cleaned text, null for null tokens."""
    own = clean_text(text)
    return F.when(~own.isin(*null_tokens), own)


def to_int(text: Column, bits: int = 64) -> Pair:
    """Whole numbers, with thousands commas; `bits` bounds the range."""
    number = F.regexp_replace(text, ",", "").try_cast("decimal(38,10)")
    whole = number.cast("decimal(38,0)")
    return _pair(text, F.when(number % 1 == 0, whole.try_cast("int" if bits == 32 else "long")), "INT_INVALID")


def to_double(text: Column) -> Pair:
    return _pair(text, F.regexp_replace(text, ",", "").try_cast("double"), "FLOAT_INVALID")


def to_decimal(text: Column, precision: int = 38, scale: int = 10) -> Pair:
    """Half-up at the scale; too many digits before the point are an error."""
    return _pair(text, F.regexp_replace(text, ",", "").try_cast(f"decimal({precision},{scale})"), "DECIMAL_INVALID")


def to_bool(text: Column, true: Sequence[str] = TRUE, false: Sequence[str] = FALSE) -> Pair:
    own = F.lower(norm_text(text))
    return _pair(text, F.when(own.isin(*true), True).when(own.isin(*false), False), "BOOL_INVALID")


def to_date(text: Column, formats: Sequence[str] = DATES, base_1904: bool = False) -> Pair:
    """Dates in any of the formats, or a serial number of days."""
    days = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in (*formats, *TIMES)]).cast("date")
    serial = F.date_add(F.lit("1904-01-01" if base_1904 else "1899-12-30").cast("date"), F.floor(text.try_cast("double")).try_cast("int"))
    return _pair(text, F.coalesce(days, F.when(text.rlike(r"^\d{1,5}(\.\d+)?$"), serial)), "DATE_INVALID")


def to_enum(text: Column, values: Mapping[str, int | str]) -> Pair:
    own = norm_text(text)
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return _pair(text, F.try_element_at(table, own), "ENUM_UNKNOWN")


def to_list(text: Column, item: str = "string", separator: str = "|") -> Pair:
    """Items of one type; one that fails makes the cell fail."""
    parts = F.transform(F.split(text, "\\Q" + separator + "\\E", -1), lambda x: F.trim(x).try_cast(item))
    return _pair(text, F.when(~F.exists(parts, lambda x: x.isNull()), parts), "LIST_INVALID")


def to_struct(text: Column, fields: Mapping[str, str], separator: str = ":") -> Pair:
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    values = [F.trim(F.get(parts, F.lit(i))).try_cast(t).alias(f) for i, (f, t) in enumerate(fields.items())]
    fine = F.size(parts) == len(fields)
    for v in values:
        fine = fine & v.isNotNull()
    return _pair(text, F.when(fine, F.struct(*values)), "STRUCT_INVALID")


def to_json(text: Column) -> Pair:
    return _pair(text, F.try_parse_json(text), "JSON_INVALID")
