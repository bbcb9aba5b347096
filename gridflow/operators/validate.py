"""Data-quality rules: rows that break an ERROR rule go to the side output, each broken rule is an issue.

Row rules are conditions over a row; UNIQUE adds a window on its key, FOREIGN_KEY a join on distinct keys.  All flags
are computed in one pass over the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import full_pattern
from ..functions.text import is_blank, key_columns, key_norm
from .rows import Flow, pair

Break = Callable[[DataFrame, str], tuple[DataFrame, Column]]


@dataclass
class Rule:
    """A rule: `breaks` gives the input with what it needs, and the condition of a broken row."""

    name: str
    breaks: Break
    severity: str = "ERROR"
    enabled: bool = True


def _row(condition: Callable[[DataFrame], Column]) -> Break:
    return lambda df, _: (df, F.coalesce(condition(df), F.lit(False)))


def not_null(name: str, fields: Sequence[str], **more: object) -> Rule:
    """Null or blank text breaks it."""
    def bad(df: DataFrame) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | (is_blank(F.col(f)) if isinstance(df.schema[f].dataType, T.StringType) else F.col(f).isNull())
        return out

    return Rule(name, _row(bad), **more)


def in_range(name: str, field: str, low: float | None = None, high: float | None = None, inclusive: bool = True, **more: object) -> Rule:
    """Null passes."""
    def bad(df: DataFrame) -> Column:
        c, out = F.col(field), F.lit(False)
        if low is not None:
            out = out | (c < low if inclusive else c <= low)
        if high is not None:
            out = out | (c > high if inclusive else c >= high)
        return out

    return Rule(name, _row(bad), **more)


def matches(name: str, field: str, pattern: str, **more: object) -> Rule:
    """The whole text must match; null passes."""
    return Rule(name, _row(lambda df: ~F.col(field).cast("string").rlike(full_pattern(pattern))), **more)


def one_of(name: str, field: str, values: Sequence[str], **more: object) -> Rule:
    """The normalised value must be listed; null passes."""
    return Rule(name, _row(lambda df: ~key_norm(F.col(field), df.schema[field].dataType).isin(*values)), **more)


def unique(name: str, fields: Sequence[str], **more: object) -> Rule:
    """Every row of a repeated key breaks it; rows with a null in the key pass."""
    def bad(df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        own, names = key_columns(df, list(fields), f"_u{tag}_")
        some = F.lit(True)
        for n in names:
            some = some & F.col(n).isNotNull()
        # counted by key and joined back, so that one frequent key is not a single window
        counts = own.where(some).groupBy(*names).agg(F.count("*").alias(f"_n{tag}")).where(f"_n{tag} > 1")
        return own.join(counts, names, "left"), F.col(f"_n{tag}").isNotNull()

    return Rule(name, bad, **more)


def foreign_key(name: str, field: str, other: DataFrame, key: str, **more: object) -> Rule:
    """The key must be among another input's; null passes."""
    def bad(df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        own, names = key_columns(df, [field], f"_f{tag}_")
        there = key_columns(other, [key], f"_f{tag}_")[0].select(*names).dropna().distinct().withColumn(f"_h{tag}", F.lit(True))
        return own.join(there, names, "left"), F.col(f"_h{tag}").isNull() & F.col(names[0]).isNotNull()

    return Rule(name, bad, **more)


def expression(name: str, condition: Column | tuple[Column, Column], **more: object) -> Rule:
    """False or an error breaks it; null passes."""
    value, error = pair(condition)
    return Rule(name, _row(lambda df: (value == F.lit(False)) | error.isNotNull()), **more)


def validate(df: DataFrame, rules: Sequence[Rule]) -> Flow:
    """Rows that pass, rows that break an ERROR rule (with their rules' names in `_broken`), and issues by rule."""
    fields = df.columns
    out, broken = df, {}
    for i, rule in enumerate(r for r in rules if r.enabled):
        out, bad = rule.breaks(out, str(i))
        out = out.withColumn(f"_b{i}", bad)
        broken[f"_b{i}"] = rule
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(r.name)) for c, r in broken.items()])) if broken else F.array().cast("array<string>")
    fatal = F.lit(False)
    for c, r in broken.items():
        if r.severity == "ERROR":
            fatal = fatal | F.col(c)
    out = out.select(*fields, names.alias("_broken"), fatal.alias("_fatal"))
    severity = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.severity)]) if rules else F.create_map().cast("map<string,string>")
    found = out.select(F.explode("_broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).withColumn("severity", severity[F.col("rule")])
    return Flow(out.where("not _fatal").select(*fields), out.where("_fatal").select(*fields, "_broken"), found)


def reconcile(df: DataFrame, agg: str, field: str, target: Column | float | None, tolerance: float = 0.0) -> DataFrame:
    """One row: actual, target, ok.  An aggregate of nothing is 0; `count` counts all rows; a null target is a mismatch."""
    made = {"sum": F.sum, "min": F.min, "max": F.max}.get(agg)
    actual = F.count("*").cast("double") if made is None else F.coalesce(made(F.col(field)).cast("double"), F.lit(0.0))
    want = target if isinstance(target, Column) else F.lit(target).cast("double")
    return df.agg(actual.alias("actual")).select("actual", want.alias("target")).withColumn("ok", F.coalesce(F.abs(F.col("actual") - F.col("target")) <= tolerance, F.lit(False)))


def row_count(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row: rows, ok."""
    n = F.col("rows")
    return df.agg(F.count("*").alias("rows")).withColumn("ok", (n >= (low or 0)) & (n <= (high if high is not None else 2**62)))


def duplicate_keys(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys of a sink that occur more than once, nulls included: key fields and n."""
    own, names = key_columns(df, list(fields), "_s")
    return own.groupBy(*names).agg(F.count("*").alias("n"), *[F.min(f).alias(f) for f in fields]).where("n > 1").select(*fields, "n")
