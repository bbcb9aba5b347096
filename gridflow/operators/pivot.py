"""Pivot with stated columns: conditional aggregation in one shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_norm
from .rows import Flow, issues

AGGREGATES = ("FIRST", "SUM", "COUNT", "MAX", "MIN", "AVG")


def pivot(df: DataFrame, group_by: Sequence[str], field: str, value: str, agg: str, columns: Mapping[str, str], order: str, node: str = "pivot") -> Flow:
    """One row a group with one column for each stated value of `field` (value: column name).

    Groups and values meet by their normalised keys, a group's values come from its first row by `order`, and a group
    whose values are all unknown still has its row.  FIRST takes the first non-null by `order` and warns of differing
    ones; COUNT of nothing is 0; other aggregates of nothing are null.
    """
    if agg not in AGGREGATES:
        raise ValueError(agg)
    kinds = {f.name: f.dataType for f in df.schema}
    if agg in ("SUM", "AVG") and not isinstance(kinds[value], T.NumericType):
        raise ValueError(f"{agg} over {kinds[value].simpleString()}")
    keys = {f"_g{i}": key_norm(F.col(g), kinds[g]) for i, g in enumerate(group_by)}
    own = df.withColumns(keys | {"_p": key_norm(F.col(field), kinds[field])})

    def one(v: str) -> Column:
        x = F.when(F.col("_p") == v, F.col(value))
        if agg == "FIRST":
            return F.min_by(x, F.when(x.isNotNull(), F.col(order)))
        if agg == "SUM":
            return F.sum(x.cast("long") if isinstance(kinds[value], T.IntegerType) else x)
        return {"COUNT": F.count, "MAX": F.max, "MIN": F.min, "AVG": lambda c: F.avg(c.cast("double"))}[agg](x)

    out = own.groupBy(*keys).agg(
        *[F.min_by(F.col(g), F.col(order)).alias(g) for g in group_by], *[one(v).alias(n) for v, n in columns.items()], F.min(order).alias("_order")
    )
    unknown = own.where(F.col("_p").isNotNull() & ~F.col("_p").isin(*columns))
    found = issues(unknown, node, "PIVOT_UNKNOWN_VALUE", "WARN", field=F.col("_p"))
    if agg == "FIRST":
        texts = own.where(F.col("_p").isin(*columns) & F.col(value).isNotNull()).groupBy(*keys, "_p").agg(F.min(F.col(value).cast("string")).alias("a"), F.max(F.col(value).cast("string")).alias("b"))
        found = found.unionByName(issues(texts.where("a <> b"), node, "PIVOT_DUPLICATE", "WARN", field=F.col("_p")))
    return Flow(out.select(*group_by, *columns.values()), issues=found)
