"""What the fields of a region look like: names, types, lists of values and keys, from one aggregation over all columns.

The aggregation holds sketches that merge (frequent values, distinct values), so no column's values are gathered; what only
looks like a key by the sketch is then counted exactly, for those columns alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert
from ..functions.text import has_text, norm_text
from .places import Region, lines, places
from .source import _Cut, header_names

#: Distinct values of a list at most; values that the sketch of frequent ones tracks; how far the count of distinct ones may be off.
MOST_VALUES, TRACKED, ERROR = 20, 400, 0.02
#: Letters that a header has at least to give a field its name.
LETTERS = 4


def field_names(heads: DataFrame, by: Sequence[str] = ("sheet",), prefix: str = "col") -> DataFrame:
    """`heads` (by, col, name) with field: English words of a header in camel case, words of digits last; else the prefix and its ordinal; repeats are numbered."""
    words = F.regexp_extract_all("name", F.lit("[A-Za-z][A-Za-z0-9]*|[0-9]+"), F.lit(0))
    alpha, digits = F.filter(words, lambda w: w.rlike("^[A-Za-z]")), F.filter(words, lambda w: w.rlike("^[0-9]"))
    letters = F.aggregate(alpha, F.lit(0), lambda n, w: n + F.length(w))
    parts = F.concat(alpha, digits)
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    camel = F.substring(F.concat(F.lower(F.try_element_at(parts, F.lit(1))), F.array_join(tail, "")), 1, 40)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("col"))
    named = heads.withColumn("field", F.when(letters >= LETTERS, camel).otherwise(F.concat(F.lit(prefix), place)))
    turn = F.row_number().over(Window.partitionBy(*by, "field").orderBy("col"))
    return named.withColumn("_turn", turn).withColumn("field", F.when(F.col("_turn") > 1, F.concat_ws("_", "field", "_turn")).otherwise(F.col("field"))).drop("_turn")


def fields(cells: DataFrame, region: Region) -> DataFrame:
    """sheet, col, source (the header), field, type, filled, values (a sorted list where few repeat), is_key: the columns of a region with a header.

    type: the narrowest of int, long, float, date and bool that all texts of a column fit, else string; string for a blank column.
    is_key: no row is blank there and none repeats another.
    """
    own = lines(cells)
    cut = _Cut(own, places(own, [region]), 0, [region])
    k = max(1, region.header_rows)
    head = cut.view().where(F.col("row") < F.col("top") + k).select("sheet", "row", "top", F.explode("line").alias("col", "cell"))
    heads = header_names(head.withColumn("value", F.col("cell.value")), cut.rect, region).select("sheet", "col", "name")
    body = cut.view().where(F.col("row") >= F.col("top") + k).select("sheet", "row", F.explode("line").alias("col", "cell"))
    body = body.where(has_text(F.col("cell.value"))).select("sheet", "row", "col", norm_text(F.col("cell.value")).alias("t"))
    fits = {"int": convert.to_int(F.col("t"), 32)[0], "long": convert.to_int(F.col("t"), 64)[0], "float": convert.to_double(F.col("t"))[0], "date": convert.to_date(F.col("t"))[0], "bool": convert.to_bool(F.col("t"))[0]}
    found = body.groupBy("sheet", "col").agg(
        F.count("*").alias("filled"), *[F.count(v).alias(f"is_{n}") for n, v in fits.items()], F.approx_count_distinct("t", ERROR).alias("about"), F.expr(f"approx_top_k(t, {MOST_VALUES + 1}, {TRACKED})").alias("top")
    )
    kind: Column = F.lit("string")
    for n in reversed(fits):
        kind = F.when(F.col(f"is_{n}") == F.col("filled"), n).otherwise(kind)
    listed = F.array_sort(F.transform("top", lambda x: x["item"]))
    # the sketch lacks nothing while its values are within what it tracks; beyond, it names some of the frequent ones or none
    few = (F.col("about") <= TRACKED // 2) & (F.size("top") <= MOST_VALUES) & (F.col("filled") >= 2 * F.size("top"))
    rows = body.groupBy("sheet").agg(F.count_distinct("row").alias("rows"))
    seen = found.join(rows, "sheet").select("sheet", "col", "filled", kind.alias("type"), F.when(few, listed).alias("values"), ((F.col("filled") == F.col("rows")) & (F.col("about") >= (1 - 4 * ERROR) * F.col("filled"))).alias("maybe"))
    again = body.join(seen.where("maybe").select("sheet", "col"), ["sheet", "col"], "left_semi").groupBy("sheet", "col", "t").count().where("count > 1").select("sheet", "col", F.lit(True).alias("again")).distinct()
    out = field_names(heads).join(seen, ["sheet", "col"], "left").join(again, ["sheet", "col"], "left")
    return out.select(
        "sheet", "col", F.col("name").alias("source"), "field", F.coalesce("type", F.lit("string")).alias("type"), F.coalesce("filled", F.lit(0)).alias("filled"), "values",
        (F.coalesce("maybe", F.lit(False)) & F.col("again").isNull()).alias("is_key"),
    )


def matrix_names(corner: str | None) -> tuple[str, str]:
    """Names of a matrix's row and column dimension from its corner: two words with a stroke between name both, one names the columns."""
    parts = [p.strip() for p in re.split(r"[\\/]", " ".join((corner or "").split())) if p.strip()]
    own = [re.sub(r"\W+", "_", p).strip("_") for p in parts]
    return (own[0], own[1]) if len(own) == 2 else ("item", own[0] if len(own) == 1 and own[0] else "col")


def binding_problems(own: T.StructType, target: T.StructType, mapping: Mapping[str, str], unique: Sequence[Sequence[str]] = (), keys: Sequence[str] = (), partitions: Sequence[str] | None = None) -> tuple[list[str], list[str] | None]:
    """(problems, suggested key) of writing fields to a target's columns.  mapping: field to column; unique: the target's unique keys; partitions: the fields of a write by partition.

    A text takes any field, a number takes a number no wider in kind (whole to whole, decimal or floating), a time takes a date.
    The first of the target's unique keys whose columns are all mapped is suggested where no key is given.
    """
    have, want = {f.name: f.dataType for f in own}, {f.name: f for f in target}
    out = [f"no column {c}" for c in mapping.values() if c not in want] + [f"no field {f}" for f in mapping if f not in have]
    for f, c in mapping.items():
        if f in have and c in want and not fits_in(have[f], want[c].dataType):
            out.append(f"{f} ({have[f].simpleString()}) does not fit {c} ({want[c].dataType.simpleString()})")
    out += [f"column {n} needs a field" for n, f in want.items() if not f.nullable and n not in mapping.values()]
    if partitions is not None:
        out += ["no partition fields"] if not partitions else [f"partition field {f} is not mapped" for f in partitions if f not in mapping]
    by = {c: f for f, c in mapping.items()}
    suggested = next(([by[c] for c in key] for key in unique if all(c in by for c in key)), None) if not keys else None
    return out, suggested


def fits_in(own: T.DataType, target: T.DataType) -> bool:
    whole, exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), T.DecimalType
    if own == target or isinstance(target, T.StringType):
        return True
    if isinstance(own, whole):
        return isinstance(target, (*whole, exact, T.FloatType, T.DoubleType))
    if isinstance(own, (exact, T.FloatType, T.DoubleType)):
        return isinstance(target, (exact, T.FloatType, T.DoubleType))
    if isinstance(own, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return isinstance(target, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return isinstance(own, T.BooleanType) and isinstance(target, whole)
