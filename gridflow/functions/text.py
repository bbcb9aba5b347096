"""Normalisation of texts, keys and values, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Invisible characters that are deleted, and the default null tokens.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060"
NULL_TOKENS = ("", "-", "N/A", "NULL")
SPACE = r"(?U)\s+"
#: What a text has that cleaning or normalising may change: anything but visible ASCII and single spaces between.
ENDS, ROUGH = r"[^ -~]|^ | $", r"[^ -~]|^ | $|  "


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC; Spark has no built-in one, so non-ASCII texts go through an Arrow function."""
    return _nfkc(text)


def strip(text: Column) -> Column:
    """Without white space at the ends, any Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column, width: bool = False) -> Column:
    """No-break spaces to spaces, invisible characters deleted, ends stripped; inner white space stays."""
    text = text.cast("string")
    out = nfkc(text) if width else text
    return F.when(text.rlike(ENDS), strip(F.translate(F.replace(out, F.lit("\u00a0"), F.lit(" ")), INVISIBLE, ""))).otherwise(text)


def norm_text(text: Column, width: bool = False) -> Column:
    """Invisible characters deleted, white space runs to one space, ends stripped; NFKC first with `width`."""
    text = text.cast("string")
    out = nfkc(F.translate(text, INVISIBLE, "")) if width else F.translate(text, INVISIBLE, "")
    return F.when(text.rlike(ROUGH), strip(F.regexp_replace(out, SPACE, " "))).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether `norm_text` leaves anything of a text: it has a character that is neither white space nor invisible; false for null."""
    return F.coalesce(text.rlike(rf"(?U)[^\s{INVISIBLE}]"), F.lit(False))


def is_blank(value: Column) -> Column:
    """Null, NaN or text of white space and invisible characters only."""
    text = value.cast("string")
    return text.isNull() | (norm_text(text) == "") | (text == "NaN")


def key_norm(value: Column, kind: T.DataType, width: bool = False) -> Column:
    """A key's text form, so that 1, 1.0, '1' and ' 1 ' meet: booleans as True or False, whole floats without a point; decimals keep their digits."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e18)
        return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))
    if isinstance(kind, T.StringType):
        return norm_text(value, width)
    return value.cast("string")


def key_columns(df: DataFrame, fields: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """`df` with the normalised keys of `fields` as new columns, and their names."""
    names = [f"{prefix}{i}" for i in range(len(fields))]
    return df.withColumns({n: key_norm(F.col(f"`{f}`"), df.schema[f].dataType) for n, f in zip(names, fields, strict=True)}), names


def norm_value(value: Column, kind: T.DataType) -> Column:
    """A value's text form for change detection: booleans 1 or 0, whole numbers without a point, decimals without end zeros, dates as text, times to the second."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "1").when(~value, "0")
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, T.DecimalType):
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.regexp_replace(value.cast("string"), r"0+$", ""))
    return key_norm(value, kind)
