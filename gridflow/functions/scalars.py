"""The scalar functions of derived columns and rules, as Column expressions.

Expressions are Spark columns or Spark SQL; these functions give the semantics that Spark's own do not have.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Accepted date and timestamp forms.
DATES = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "yyyy年M月d日")
TIMES = ("yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m")
MAX_PATTERN = 200


def null_if_any(value: Column, *fields: Column) -> Column:
    """The null rule of expressions: any null field makes the result null, under `or`, `and` and conditions too."""
    some = fields[0].isNull()
    for f in fields[1:]:
        some = some | f.isNull()
    return F.when(~some, value)


Pair = tuple[Column, Column]


def both(p: Pair, q: Pair) -> Pair:
    """Logical and of (value, error) pairs: a false side decides, whatever the other's error."""
    decided = F.coalesce(p[1].isNull() & ~p[0], F.lit(False)) | F.coalesce(q[1].isNull() & ~q[0], F.lit(False))
    error = F.when(~decided, F.coalesce(p[1], q[1]))
    return F.when(decided, False).when(error.isNull(), p[0] & q[0]), error


def either(p: Pair, q: Pair) -> Pair:
    """Logical or of pairs: a true side decides."""
    decided = F.coalesce(p[1].isNull() & p[0], F.lit(False)) | F.coalesce(q[1].isNull() & q[0], F.lit(False))
    error = F.when(~decided, F.coalesce(p[1], q[1]))
    return F.when(decided, True).when(error.isNull(), p[0] | q[0]), error


def chosen(condition: Pair, yes: Pair, no: Pair) -> Pair:
    """One of two pairs by a condition; an error of the side that is not taken does not count."""
    fine = condition[1].isNull()
    value = F.when(fine & condition[0], yes[0]).when(fine & ~condition[0], no[0])
    return value, F.when(~fine, condition[1]).when(condition[0], yes[1]).when(~condition[0], no[1])


def text_len(s: Column) -> Column:
    return F.length(F.coalesce(s, F.lit(""))).cast("long")


def trim(s: Column) -> Column:
    return strip(s)


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """Zero-based slice; a negative start counts from the end."""
    size = F.length(s)
    begin = F.lit(start) if start >= 0 else F.greatest(F.lit(0), size + start)
    if length is None:
        return F.substring(s, begin + 1, size)
    stop = begin + length if start + length >= 0 or start >= 0 else begin
    return F.when(stop > begin, F.substring(s, begin + 1, F.lit(length))).otherwise("") if length > 0 else F.when(s.isNotNull(), F.lit(""))


def replace(s: Column, old: str, new: str) -> Column:
    """Literal replacement; an empty `old` puts `new` between all characters."""
    return F.replace(s, F.lit(old), F.lit(new)) if old else F.regexp_replace(s, "", new.replace("\\", "\\\\").replace("$", "\\$"))


def split(s: Column, separator: str) -> Column:
    if not separator:
        raise ValueError("empty separator")
    return F.split(s, re.escape(separator), -1)


def join(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def format_text(template: str, *values: Column) -> Column:
    """`{}` and `{n}` of a template filled with values; other forms are rejected."""
    parts: list[Column] = []
    at = 0
    turn = 0
    for m in re.finditer(r"\{\{|\}\}|\{(\d*)\}|[{}]", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[0] in ("{{", "}}"):
            parts.append(F.lit(m[0][0]))
        elif m[1] is None:
            raise ValueError(f"unsupported placeholder in {template!r}")
        else:
            parts.append(values[int(m[1]) if m[1] else turn].cast("string"))
            turn += not m[1]
    return F.concat(*parts, F.lit(template[at:]))


def full_pattern(pattern: str) -> str:
    """A pattern that must match the whole text, in Java's dialect."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError("pattern too long")
    return r"\A(?:" + pattern.replace("(?P<", "(?<") + r")\z"


def regex_match(s: Column, pattern: str) -> Column:
    return s.rlike(full_pattern(pattern))


def round_half_up(x: Column, digits: int = 0) -> Column:
    return F.round(x.cast("double"), digits)


def floor_int(x: Column) -> Column:
    return F.floor(x).cast("long")


def ceil_int(x: Column) -> Column:
    return F.ceil(x).cast("long")


def least(*values: Column) -> Column:
    """The smallest; null if any is null."""
    return null_if_any(F.least(*values), *values)


def greatest(*values: Column) -> Column:
    return null_if_any(F.greatest(*values), *values)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return null_if_any(F.greatest(low, F.least(high, x)), x, low, high)


def to_datetime(s: Column) -> Column:
    """A timestamp without zone from any of the accepted forms; null where none fits."""
    own = strip(s)
    return F.coalesce(*[F.try_to_timestamp(own, F.lit(f)) for f in (*TIMES, *DATES)]).cast("timestamp_ntz")


def add_days(d: Column, n: Column | int) -> Column:
    return d + F.make_dt_interval(days=F.lit(n) if isinstance(n, int) else n)


def diff_days(a: Column, b: Column) -> Column:
    """Whole days from b to a, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", b.cast("timestamp_ntz"), a.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


#: Strftime letters and their date_format forms.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%p": "a", "%I": "hh", "%%": "'%'"}


def format_date(d: Column, pattern: str) -> Column:
    parts = re.split(r"(%.)", pattern)
    unknown = [p for p in parts if p.startswith("%") and p not in STRFTIME]
    if unknown:
        raise ValueError(f"unsupported {unknown[0]} in {pattern!r}")
    return F.date_format(d, "".join(STRFTIME[p] if p in STRFTIME else "'" + p.replace("'", "''") + "'" if p else "" for p in parts))


def sum_list(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("double"), lambda a, x: a + x)


def int_div(a: Column, b: Column) -> tuple[Column, Column]:
    """Truncating division and its error: (value, message)."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b).otherwise(F.lit(1)))), F.when(b == 0, F.lit("division by zero"))


def safe_div(a: Column, b: Column) -> tuple[Column, Column]:
    return F.try_divide(a, b), F.when(b == 0, F.lit("division by zero"))
