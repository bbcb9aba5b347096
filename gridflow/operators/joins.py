"""Joins with normalised keys, cardinality and explosion checks, and dictionary lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_columns
from .rows import Flow, issues

#: A side is broadcast only below this many rows (counted), each of bounded width.
BROADCAST_ROWS = 100_000
#: A key with more left rows than this, and more than a task's fair share, is split; frequent keys that a sketch tells apart.
HOT_ROWS, HOT_KEYS = 1_000_000, 200


class JoinError(ValueError):
    """A join whose checks failed; `code` says which."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


def keyed(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return key_columns(df, list(fields), "_k")


def repeated_keys(df: DataFrame, fields: Sequence[str], most: int = 10) -> DataFrame:
    """The most frequent keys that occur more than once: key columns and n (a report of `most` rows)."""
    own, names = keyed(df, fields)
    return own.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *names).limit(most)


def estimate(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], keep_left: bool = False) -> DataFrame:
    """One row, rows_out: how many rows the join gives, from the counts of keys on both sides."""
    l, names = keyed(left, left_on)
    r, _ = keyed(right, right_on)
    a, b = l.groupBy(*names).agg(F.count("*").alias("nl")), r.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("nr"))
    each = a.join(b, names, "left")
    return each.agg(F.sum(F.col("nl") * F.coalesce("nr", F.lit(1 if keep_left else 0))).cast("long").alias("rows_out"))


def check(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], cardinality: str, max_rows: int, amplification: float, keep_left: bool) -> None:
    """Raise if a side that must be unique repeats a key, or if the join would give too many rows."""
    l, names = keyed(left, left_on)
    r, _ = keyed(right, right_on)
    a, b = l.groupBy(*names).agg(F.count("*").alias("nl")), r.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("nr"))
    # one aggregation a side: most rows of a key on either, all left rows, and the rows that the join gives
    key = F.array(*[F.col(n).isNotNull() for n in names])
    whole = F.forall(key, lambda x: x)
    found = a.join(b, names, "full").agg(
        F.max("nr").alias("nr"), F.max(F.when(whole, F.col("nl"))).alias("nl"), F.coalesce(F.sum("nl"), F.lit(0)).alias("left"),
        F.coalesce(F.sum(F.coalesce("nl", F.lit(0)) * F.coalesce("nr", F.lit(1 if keep_left else 0))), F.lit(0)).alias("rows"),
    ).first()  # one row
    for side, fields, n, kinds in ((right, right_on, found["nr"], ("MANY_TO_ONE", "ONE_TO_ONE")), (left, left_on, found["nl"], ("ONE_TO_MANY", "ONE_TO_ONE"))):
        if cardinality in kinds and (n or 0) > 1:
            raise JoinError("JOIN_KEY_NOT_UNIQUE", str([tuple(r) for r in repeated_keys(side, fields, 3).collect()]))
    rows = found["rows"]
    limit = max_rows if cardinality == "MANY_TO_MANY" else min(max_rows, int(max(found["left"], 1) * amplification))
    if rows > limit:
        worst = a.join(b, names).withColumn("n", F.col("nl") * F.col("nr")).orderBy(F.desc("n"), *names).limit(10).collect()
        raise JoinError("JOIN_EXPLOSION", f"{rows} rows, at most {limit}; most from " + ", ".join(f"{'/'.join(r[n] for n in names)} ({r['n']})" for r in worst))


def column_plan(
    left: Sequence[str], right: Sequence[str], left_on: Sequence[str], right_on: Sequence[str], prefix: str = "right", select: Sequence[str] | None = None, aliases: Mapping[str, str] | None = None, merge: bool = True,
) -> list[tuple[str, str, str]]:
    """(side, field, name) of each column of a join, in order.

    select: `left.field`, `right.field` or all of a side as `left.*`; without it all of both.  A right key of the same
    name as its left one is merged into it.  aliases name columns as they would be called in `select`; a right field whose
    name is taken gets the prefix.
    """
    same = {b for a, b in zip(left_on, right_on, strict=True) if a == b} if merge else set()
    wanted: list[tuple[str, str]] = []
    for x in select if select is not None else ("left.*", "right.*"):
        side, _, field = x.partition(".")
        if side not in ("left", "right"):
            raise JoinError("JOIN_SELECT", x)
        own = left if side == "left" else right
        if field != "*" and field not in own:
            raise JoinError("JOIN_SELECT", x)
        wanted += [(side, f) for f in (own if field == "*" else [field]) if not (side == "right" and f in same and field == "*")]
    out, taken = [], set()
    for side, f in wanted:
        name = (aliases or {}).get(f"{side}.{f}", f)
        if name in taken and side == "right":
            name = f"{prefix}_{f}"
        if name in taken:
            raise JoinError("JOIN_NAME_TAKEN", name)
        taken.add(name)
        out.append((side, f, name))
    return out


def hot_keys(df: DataFrame, names: Sequence[str], hot_rows: int = HOT_ROWS) -> list[tuple[str, int]]:
    """(key text, parts) of the keys that deserve several tasks, from one mergeable sketch of frequent keys."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = df.select(_text(names).alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {20 * HOT_KEYS})").alias("top"), F.count("*").alias("n")).first()
    bar = max(hot_rows, found["n"] / tasks)
    return [(r["item"], min(tasks, int(-(-r["count"] // bar)) + 1)) for r in found["top"] or () if r["item"] is not None and r["count"] > bar]


def _text(names: Sequence[str]) -> Column:
    return F.concat_ws("\u0001", *[F.col(n) for n in names])


def spread(left: DataFrame, right: DataFrame, names: Sequence[str], hot: Sequence[tuple[str, int]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with `_salt`, by which the left rows of a hot key are dealt out, and the columns to join on; right rows of a hot key are there once for each part.

    Left rows that are equal in all columns stay together.
    """
    if not hot:
        return left, right, list(names)
    table = F.broadcast(left.sparkSession.createDataFrame(hot, "_hot string, _parts int"))  # HOT_KEYS rows at most
    l = left.join(table, _text(names) == F.col("_hot"), "left")
    l = l.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_parts")).cast("int"), F.lit(0))).drop("_hot", "_parts")
    r = right.join(table, _text(names) == F.col("_hot"), "left")
    r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return l, r, [*names, "_salt"]


def join(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "INNER", unmatched: str = "SIDE_OUTPUT", prefix: str = "right",
    cardinality: str = "MANY_TO_ONE", max_rows: int = 1_000_000_000, amplification: float = 1.0, checked: bool = True, node: str = "join",
    select: Sequence[str] | None = None, aliases: Mapping[str, str] | None = None, merge: bool = True, hot_rows: int | None = None,
) -> Flow:
    """Equi-join on normalised keys; null keys never meet, and rows that have one are not sent anywhere.

    hot_rows: left keys with more rows are split over several tasks (see `hot_keys`, which reads the left keys once more).
    INNER drops left rows without a partner.  LEFT with SIDE_OUTPUT puts them out on the side only; with KEEP_NULLS
    they stay in the main output with nulls.  select, aliases, merge and prefix: see `column_plan`.
    """
    if how not in ("INNER", "LEFT"):
        raise ValueError(how)
    keep = how == "LEFT" and unmatched == "KEEP_NULLS"
    if checked:
        check(left, right, left_on, right_on, cardinality, max_rows, amplification, keep)
    l, names = keyed(left, left_on)
    r, _ = keyed(right, right_on)
    plan = column_plan(left.columns, right.columns, left_on, right_on, prefix, select, aliases, merge)
    r = r.dropna(subset=names).select(*names, *[F.col(f"`{f}`").alias(f"_r{i}") for i, (side, f, _) in enumerate(plan) if side == "right"])
    void = reduce(lambda x, y: x | y, [F.col(n).isNull() for n in names])
    whole, on = l.where(~void), list(names)
    if hot_rows is not None:
        whole, r, on = spread(whole, r, names, hot_keys(whole, names, hot_rows))
    fields = [(F.col(f"`{f}`") if side == "left" else F.col(f"_r{i}")).alias(n) for i, (side, f, n) in enumerate(plan)]
    out = whole.join(r, on, "left" if keep else "inner").select(*fields)
    if keep:
        blank = {f"_r{i}": F.lit(None).cast(right.schema[f].dataType) for i, (side, f, _) in enumerate(plan) if side == "right"}
        out = out.union(l.where(void).withColumns(blank).select(*fields))
    if how == "INNER":
        return Flow(out)
    alone = whole.join(r.select(*on), on, "left_anti").select(*left.columns).union(l.where(void).select(*left.columns))
    return Flow(out, None if keep else alone, lambda: issues(alone, node, "JOIN_UNMATCHED", "WARN"))


def broadcast_join(left: DataFrame, right: DataFrame, prefix: str = "right") -> DataFrame:
    """The fields of a right side of exactly one row on every left row, as literals."""
    first = right.take(2)
    if len(first) != 1:
        raise JoinError("PARAM_NOT_SINGLE_ROW", f"{'no row' if not first else 'several rows'}")
    return left.withColumns({f"{prefix}_{f.name}" if f.name in left.columns else f.name: F.lit(first[0][f.name]).cast(f.dataType) for f in right.schema})


def lookup(df: DataFrame, dictionary: DataFrame, on: Sequence[str], keys: Sequence[str], fields: Sequence[str], missing: str = "NULL", node: str = "lookup") -> Flow:
    """Fields of a dictionary by key; never more rows than before.

    A repeated dictionary key is fatal.  A row without an entry has nulls (NULL, or WARN with an issue), or is dropped
    with an issue (ERROR).  The dictionary is broadcast only if its counted rows are few.
    """
    if again := repeated_keys(dictionary, keys, 3).collect():
        raise JoinError("LOOKUP_KEY_NOT_UNIQUE", str([tuple(r) for r in again]))
    l, names = keyed(df, on)
    d, _ = keyed(dictionary, keys)
    d = d.dropna(subset=names).select(*names, *[F.col(f"`{f}`") for f in fields])
    if dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        d = F.broadcast(d)
    void = reduce(lambda x, y: x | y, [F.col(n).isNull() for n in names])
    whole, lost = l.where(~void), l.where(void)
    out = whole.join(d, names, "inner" if missing == "ERROR" else "left").select(*df.columns, *fields)
    if missing != "ERROR":
        out = out.union(lost.withColumns({f"_d{i}": F.lit(None).cast(dictionary.schema[f].dataType) for i, f in enumerate(fields)}).select(*df.columns, *[F.col(f"_d{i}").alias(f) for i, f in enumerate(fields)]))

    def found() -> DataFrame:
        alone = whole.join(d.select(*names), names, "left_anti").select(*df.columns).union(lost.select(*df.columns))
        return issues(alone, node, "LOOKUP_MISSING", missing)

    return Flow(out, issues=None if missing == "NULL" else found)


def reference(df: DataFrame, other: DataFrame, on: str, key: str) -> Flow:
    """Rows whose key another input has, or is null; the others on the side."""
    l, names = keyed(df, [on])
    r = keyed(other, [key])[0].select(*names).dropna().distinct()
    here = l.join(r.withColumn("_hit", F.lit(True)), names, "left")
    fine = F.col("_hit").isNotNull() | F.col(names[0]).isNull()
    return Flow(here.where(fine).select(*df.columns), here.where(~fine).select(*df.columns))
