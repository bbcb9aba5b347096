"""Where rows and fields come from.

A row that carries its lineage has two more columns: _rid, which names it, and _cells, a map from a field to the addresses of
the cells that it was made of.  The source node gives both (`lineage=True`); filters, pages, selections of rows and unions carry
them as they carry any column, and the functions here do for derived fields and joins.  Fields made of header texts or
defaults name no cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, rows
from .rows import Flow, Value

RID, CELLS = "_rid", "_cells"
#: The type of _cells.
TYPE = "map<string,array<string>>"


def used(df: DataFrame, value: Column) -> list[str]:
    """The columns that an expression refers to: those without which it has no meaning."""
    out = []
    for c in df.columns:
        try:
            df.drop(c).select(value)
        except AnalysisException:
            out.append(c)
    return out


def of(field: str) -> Column:
    """The cells of a field, none if it has none."""
    return F.coalesce(F.try_element_at(CELLS, F.lit(field)), F.array().cast("array<string>"))


def with_cells(df: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    """The rows with the cells of some fields replaced."""
    others = F.map_filter(CELLS, lambda f, _: ~f.isin(*made))
    return df.withColumn(CELLS, F.map_concat(others, F.map_from_arrays(F.array(*[F.lit(f) for f in made]), F.array(*made.values()))))


def derive(df: DataFrame, columns: Mapping[str, Value], on_error: str = "ERROR", node: str = "derive", uses: Mapping[str, Sequence[str]] | None = None) -> Flow:
    """`rows.derive`; a derived field's cells are those of the columns that its expression refers to (`uses`, or found out)."""
    names: dict[str, list[str]] = {}
    shape = df
    for n, value in columns.items():
        own = rows.pair(value)[0]
        names[n] = list(uses[n]) if uses and n in uses else used(shape, own)
        shape = shape.withColumn(n, own)
    flow = rows.derive(df, columns, on_error, node)
    out = flow.out
    for n, own in names.items():  # in order, as each may use those before it
        out = with_cells(out, {n: F.array_distinct(F.flatten(F.array(*[of(c) for c in own], F.array().cast("array<string>"))))})
    return Flow(out, flow.reject, lambda: flow.issues)


def join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "INNER", unmatched: str = "SIDE_OUTPUT", prefix: str = "right", **more: object) -> Flow:
    """`joins.join` of rows with lineage: _rid is both names with a plus between them, _cells those of both sides' fields as they are called in the result."""
    names = {"select": more.get("select"), "aliases": more.get("aliases"), "merge": more.get("merge", True)}
    plain = [[c for c in df.columns if c not in (RID, CELLS)] for df in (left, right)]
    plan = joins.column_plan(*plain, left_on, right_on, prefix, **names)
    wanted = [*(f"{side}.{field}" for side, field, _ in plan), *(f"{side}.{c}" for side in ("left", "right") for c in (RID, CELLS))]
    called = {f"{side}.{field}": name for side, field, name in plan} | {f"{side}.{c}": f"{c}_{side}" for side in ("left", "right") for c in (RID, CELLS)}
    flow = joins.join(left, right, left_on, right_on, how, unmatched, prefix, select=wanted, aliases=called, **{k: v for k, v in more.items() if k not in names})
    sides = []
    for side in ("left", "right"):
        fields = [(field, name) for s, field, name in plan if s == side]
        sides.append(F.map_from_entries(F.array_compact(F.array(*[_entry(f"{CELLS}_{side}", field, name) for field, name in fields]))) if fields else F.create_map().cast(TYPE))
    out = flow.out.withColumns({RID: F.concat_ws("+", f"{RID}_left", f"{RID}_right"), CELLS: F.map_concat(*sides)})
    return Flow(out.select(*[f"`{name}`" for _, _, name in plan], RID, CELLS), flow.reject, lambda: flow.issues)


def _entry(cells: str, field: str, name: str) -> Column:
    found = F.try_element_at(cells, F.lit(field))
    return F.when(found.isNotNull(), F.struct(F.lit(name).alias("key"), found.alias("value")))
