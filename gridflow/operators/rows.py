"""Row operators: filter, derive, select, union.

Problems are never exceptions in a task.  A column that can fail is given as (value, error); failing rows go to a side
output, and issues are rows of a common form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = Column | tuple[Column, Column]
#: Names that a field cannot have.
RESERVED = frozenset((
    "params", "meta", "in", "as", "break", "const", "continue", "else", "for", "function", "if", "import", "let",
    "loop", "package", "namespace", "return", "var", "void", "while", "null", "true", "false",
))
NAME = r"^[a-zA-Z_][a-zA-Z0-9_]*$"


class Flow:
    """An operator's main output, its side output, and its issues (node, severity, code, message, field, n).

    issues may be given as a function; its plan is made when it is first asked for.
    """

    def __init__(self, out: DataFrame, reject: DataFrame | None = None, issues: DataFrame | Callable[[], DataFrame | None] | None = None) -> None:
        self.out, self.reject, self._issues = out, reject, issues

    @property
    def issues(self) -> DataFrame | None:
        if callable(self._issues):
            self._issues = self._issues()
        return self._issues


def pair(value: Value) -> tuple[Column, Column]:
    return value if isinstance(value, tuple) else (value, F.lit(None).cast("string"))


def issues(rows: DataFrame, node: str, code: str, severity: str = "ERROR", field: Column | None = None, message: Column | None = None) -> DataFrame:
    """Issues of one code, counted by field and message."""
    named = rows.select((field if field is not None else F.lit(None).cast("string")).alias("field"), (message if message is not None else F.lit(None).cast("string")).alias("message"))
    return named.groupBy("field", "message").agg(F.count("*").alias("n")).select(F.lit(node).alias("node"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), "message", "field", "n")


def filter_rows(df: DataFrame, condition: Value, node: str = "filter") -> Flow:
    """Rows whose condition is true; null drops a row, an error drops it with an issue."""
    value, error = pair(condition)
    kept = df.where(F.coalesce(value, F.lit(False)) & error.isNull())
    return Flow(kept, issues=issues(df.where(error.isNotNull()), node, "EXPR_EVAL_FAILED", message=error))


def derive(df: DataFrame, columns: Mapping[str, Value], on_error: str = "ERROR", node: str = "derive") -> Flow:
    """New or replaced columns in order, each of which may use those before it.

    With on_error ERROR a failing row goes to the side output with its first error; with NULL the value is null.
    """
    if on_error not in ("ERROR", "NULL"):
        raise ValueError(on_error)
    out, error, field = df, F.lit(None).cast("string"), F.lit(None).cast("string")
    marked = out.withColumns({"_error": error, "_error_field": field})
    for name, value in columns.items():
        v, e = pair(value)
        fails = e.isNotNull()
        changed = {name: F.when(~fails, v)}
        if on_error == "ERROR":
            changed |= {"_error": F.coalesce(F.col("_error"), e), "_error_field": F.coalesce(F.col("_error_field"), F.when(fails, F.lit(name)))}
        marked = marked.withColumns(changed)
    good, bad = marked.where("_error is null").drop("_error", "_error_field"), marked.where("_error is not null")
    return Flow(good, bad, issues(bad, node, "EXPR_EVAL_FAILED", field=F.col("_error_field"), message=F.col("_error")))


def select_rename(df: DataFrame, fields: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Fields picked, renamed (field: new name) and put in order."""
    pairs = list(fields.items()) if isinstance(fields, Mapping) else [(f, f) for f in fields]
    names = [n for _, n in pairs]
    if len(set(names)) < len(names):
        raise ValueError("duplicate names")
    for n in names:
        if n in RESERVED or not re.match(NAME, n):
            raise ValueError(f"reserved name or none: {n}")
    return df.select(*[F.col(f"`{f}`").alias(n) for f, n in pairs])


def sink(df: DataFrame, mapping: Mapping[str, str], keys: Sequence[str], node: str = "sink") -> Flow:
    """The columns of a target (field: column) with their keys checked: every row of a repeated key, null ones included, is an issue."""
    from ..functions.text import key_columns

    for k in keys:
        if k not in mapping:
            raise ValueError(f"KEY_NOT_MAPPED: {k}")
    out = select_rename(df, mapping)
    own, names = key_columns(df, list(keys), "_k")
    again = own.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("n")).where("n is not null")
    none = F.lit(None).cast("string")
    return Flow(out, issues=again.select(F.lit(node).alias("node"), F.lit("ERROR").alias("severity"), F.lit("SINK_DUPLICATE_KEY").alias("code"), none.alias("message"), F.lit(",".join(keys)).alias("field"), "n"))


def union_by_name(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, aligned by name; missing fields are null, and the first input's type holds."""
    kinds: dict[str, T.DataType] = {}
    for df in inputs:
        for f in df.schema:
            kinds.setdefault(f.name, f.dataType)
    cast = [df.select(*[F.col(f"`{f.name}`") if kinds[f.name] == f.dataType else F.col(f"`{f.name}`").try_cast(kinds[f.name]).alias(f.name) for f in df.schema]) for df in inputs]
    out = cast[0]
    for df in cast[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_params(df: DataFrame, params: DataFrame, alias: str) -> DataFrame:
    """Fields of a side input of exactly one row on every row, as alias_field."""
    first = params.take(2)
    if len(first) != 1:
        raise ValueError(f"PARAM_NOT_SINGLE_ROW: {alias} has {'no row' if not first else 'several rows'}")
    return df.withColumns({f"{alias}_{f.name}": F.lit(first[0][f.name]).cast(f.dataType) for f in params.schema})


def distinct_values(df: DataFrame, field: str, order: str, most: int = 500) -> DataFrame:
    """value, n, in order of first appearance: the report that pivot columns are made from, at most 500 rows."""
    from ..functions.text import key_norm

    return df.groupBy(key_norm(F.col(field), df.schema[field].dataType).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy("first", "value").limit(most)
