"""Cells to typed fields: a column spec says which header a field comes from, its type, and what an empty cell means.

A cell here is a struct (value, kind, flags) as the workbook reader gives it; a null struct is an absent cell.  Nothing
fails in a task: a field is a (value, error) pair, and a row with any error goes to the side output.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as _field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert
from ..functions.text import NULL_TOKENS, clean_text, has_text, norm_text
from .rows import NAME, RESERVED

#: Fixed value: whole numbers from here on may have lost their last digits in a workbook.
PRECISION = 1e15
#: Cell flags of the workbook reader that make a cell fail.
ERROR, NO_CACHE = 8, 16
#: The types that a spec may name; decimal, list and struct take more in `options`.
TYPES = ("string", "int", "long", "float", "decimal", "bool", "date", "datetime", "enum", "json", "list", "struct")
CELL = "struct<value:string,kind:string,flags:int>"


@dataclass(frozen=True)
class Spec:
    """One field.  source: its header, or an expression between slashes; options: those of the type's conversion."""

    field: str
    source: str | None = None
    type: str = "string"
    required: bool = False
    default: object = None
    nulls: Sequence[str] = NULL_TOKENS
    options: Mapping[str, object] = _field(default_factory=dict)

    @property
    def header(self) -> str:
        return self.source or self.field


def spec_problems(specs: Sequence[Spec]) -> list[str]:
    """What is wrong with specs as such: names that are none, reserved or repeated, and unknown types."""
    out, seen = [], set()
    for s in specs:
        if not re.match(NAME, s.field):
            out.append(f"{s.field}: not a name")
        if s.field in RESERVED:
            out.append(f"{s.field}: reserved")
        if s.field in seen:
            out.append(f"{s.field}: repeated")
        if s.type not in TYPES:
            out.append(f"{s.field}: unknown type {s.type}")
        seen.add(s.field)
    return out


def matches(header: Column, spec: Spec) -> Column:
    """Whether a normalised header is a spec's: equal as normalised text, or a match of the whole expression."""
    s = spec.header
    if len(s) > 2 and s[0] == s[-1] == "/":
        return header.rlike(r"\A(?:" + s[1:-1] + r")\z")
    return header == norm_text(F.lit(s))


def lone(value: Column, kind: str = "s", flags: int = 0) -> Column:
    """A text as a cell."""
    return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(flags).cast("int").alias("flags"))


def as_text(text: Column, kind: Column, base_1904: bool) -> convert.Pair:
    """Whole numbers without a point, dates without a midnight, booleans by word; a number too long to be trusted fails."""
    number = text.try_cast("double")
    whole = (kind == "n") & (number == F.floor(number))
    lost = whole & (F.abs(number) >= PRECISION)
    moment = _moment(text, base_1904)
    day = F.when(moment == F.date_trunc("day", moment), F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    value = (
        F.when(lost, F.lit(None).cast("string")).when(whole, number.cast("decimal(20,0)").cast("string"))
        .when(kind == "b", F.when(text.isin("1", "true", "TRUE"), "true").otherwise("false")).when((kind == "d") & moment.isNotNull(), day).otherwise(text)
    )
    return value, F.when(lost, F.lit("ID_PRECISION_LOST"))


def _moment(text: Column, base_1904: bool) -> Column:
    """A serial number of days as a timestamp, to the second."""
    first = F.lit("1904-01-01 00:00:00" if base_1904 else "1899-12-30 00:00:00").cast("timestamp_ntz")
    seconds = F.round(text.try_cast("double") * 86400).try_cast("long")
    return first + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def converted(text: Column, kind: Column, spec: Spec, base_1904: bool = False) -> convert.Pair:
    """A cleaned text of a spec's type, with the error code of a cell."""
    o = dict(spec.options)
    number = text.try_cast("double")
    if spec.type == "string":
        return as_text(text, kind, base_1904)
    if spec.type in ("int", "long"):
        value, error = convert.to_int(text, 32 if spec.type == "int" else 64)
        lost = (kind == "n") & (F.abs(number) >= PRECISION)
        return F.when(~F.coalesce(lost, F.lit(False)), value), F.when(lost, F.lit("ID_PRECISION_LOST")).otherwise(_coded(error))
    if spec.type in ("float", "decimal"):
        value, error = convert.to_double(text) if spec.type == "float" else convert.to_decimal(text, int(o.get("precision", 38)), int(o.get("scale", 10)))
        return F.when(kind != "b", value), F.when(kind == "b", F.lit("TYPE_COERCE_FAILED")).otherwise(_coded(error))
    if spec.type == "bool":
        value, error = convert.to_bool(text, o.get("true", convert.TRUE), o.get("false", convert.FALSE))
    elif spec.type == "date":
        value, error = convert.to_date(text, base_1904=base_1904)
    elif spec.type == "datetime":
        value = F.coalesce(F.when(kind.isin("n", "d"), _moment(text, base_1904)), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in (*convert.TIMES, *convert.DATES)])
        error = F.when(value.isNull(), F.lit("DATE_INVALID"))
    elif spec.type == "enum":
        value, error = convert.to_enum(text, o["values"])
        return value, error
    elif spec.type == "json":
        value, error = convert.to_json(text)
    elif spec.type == "list":
        value, error = convert.to_list(text, str(o.get("item", "string")), str(o.get("separator", "|")))
    else:
        value, error = convert.to_struct(text, o["fields"], str(o.get("separator", ":")))
    return value, _coded(error)


def _coded(error: Column) -> Column:
    return F.when(error.isNotNull(), F.lit("TYPE_COERCE_FAILED"))


def text_of(cell: Column, spec: Spec) -> Column:
    """A cell's cleaned text, null for null tokens and blanks."""
    text = clean_text(cell["value"])
    return F.when(~text.isin(*spec.nulls) & has_text(text), text)


def coerce(cell: Column, spec: Spec, bound: Column | None = None, base_1904: bool = False, text: Column | None = None) -> convert.Pair:
    """A cell's value and error.

    bound: whether the spec's header was found; if not, the value is the default and no cell is asked.  text: `text_of` the
    cell where it is a column already, since many places ask for it.
    """
    text = text_of(cell, spec) if text is None else text
    kind, flags = F.coalesce(cell["kind"], F.lit("s")), F.coalesce(cell["flags"], F.lit(0))
    value, error = converted(text, kind, spec, base_1904)
    flagged = F.when(flags.bitwiseAND(NO_CACHE) != 0, F.lit("CELL_FORMULA_NO_CACHE")).when(flags.bitwiseAND(ERROR) != 0, F.lit("CELL_ERROR_VALUE"))
    empty = F.lit("REQUIRED_EMPTY") if spec.required else F.lit(None).cast("string")
    error = F.coalesce(flagged, F.when(text.isNull(), empty).otherwise(error))
    if spec.default is not None:
        value = F.when(text.isNull(), F.lit(spec.default)).otherwise(value)
    if bound is None:
        return value, error
    return F.when(bound, value).otherwise(F.lit(spec.default)) if spec.default is not None else F.when(bound, value), F.when(bound, error)


def coerce_rows(df: DataFrame, cells: Mapping[str, Column], specs: Sequence[Spec], keep: Sequence[str] = (), bound: Mapping[str, Column] | None = None, base_1904: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed rows, failing cells): the columns `keep` and the fields; keep, field, code and value of each cell that fails, whose row is dropped."""
    texts = {s.field: f"_text{i}" for i, s in enumerate(specs)}
    if texts:  # a generator's columns are made once a row, however often they are asked for, also by filters
        df = df.select("*", F.inline(F.array(F.struct(*[text_of(cells[s.field], s).alias(texts[s.field]) for s in specs]))))
    pairs = {s.field: coerce(cells[s.field], s, (bound or {}).get(s.field), base_1904, F.col(texts[s.field])) for s in specs}
    if not pairs:
        return df.select(*keep), df.select(*keep, *[F.lit(None).cast("string").alias(c) for c in ("field", "code", "value")]).where("false")
    columns = [v.alias(s) for s, (v, _) in pairs.items()] + [e.alias(f"_e{i}") for i, (_, e) in enumerate(pairs.values())] + [cells[s]["value"].alias(f"_v{i}") for i, s in enumerate(pairs)]
    made = df.select(*keep, F.inline(F.array(F.struct(*columns))))
    names = list(pairs)
    errors = F.array_compact(F.array(*[F.when(F.col(f"_e{i}").isNotNull(), F.struct(F.lit(s).alias("field"), F.col(f"_e{i}").alias("code"), F.col(f"_v{i}").alias("value"))) for i, s in enumerate(names)]))
    fine = F.forall(F.array(*[f"_e{i}" for i in range(len(names))]), lambda e: e.isNull())
    bad = made.where(~fine).select(*keep, F.explode(errors).alias("_e")).select(*keep, "_e.field", "_e.code", "_e.value")
    return made.where(fine).select(*keep, *names), bad
