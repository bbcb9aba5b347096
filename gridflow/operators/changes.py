"""Change sets between two versions of a dataset, their guards and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_columns, norm_value


def row_hash(df: DataFrame, fields: Sequence[str] | None = None) -> Column:
    """SHA-256 over the sorted (field, normalised value) pairs; null and missing differ from empty."""
    kinds = {f.name: f.dataType for f in df.schema}
    own = sorted(fields or df.columns)
    return F.sha2(F.to_json(F.struct(*[norm_value(F.col(f"`{f}`"), kinds[f]).cast("string").alias(f) for f in own]), {"ignoreNullFields": "false"}), 256)


def checksum(df: DataFrame) -> DataFrame:
    """One row, n and total: independent of order, but not of how often a row occurs."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"))


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows in the fields and types of others: a field that they lack is null, as is a value that does not fit."""
    own = {f.name: f.dataType for f in before.schema}
    return before.select(*[(F.lit(None).cast(f.dataType) if f.name not in own else F.col(f"`{f.name}`") if own[f.name] == f.dataType else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name) for f in after.schema])


def keyed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """op (c, u, d), the key fields, changed (names), before and after (structs): one shuffle of each side by key.

    Rows meet by normalised keys; a row is changed if its hash over the fields of `after` differs.  Keys must be unique on each side.
    """
    fields, before = after.columns, aligned(before, after)
    b, names = key_columns(before, list(keys), "_k")
    a, _ = key_columns(after, list(keys), "_k")
    b = b.select(*names, row_hash(before).alias("_hb"), F.struct(*fields).alias("before"))
    a = a.select(*names, row_hash(after).alias("_ha"), F.struct(*fields).alias("after"))
    both = _full(b, a, names)
    op = F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").when(F.col("_hb") != F.col("_ha"), "u")
    kinds = {f.name: f.dataType for f in after.schema}
    changed = F.array_compact(F.array(*[F.when(~F.equal_null(norm_value(F.col(f"before.`{f}`"), kinds[f]), norm_value(F.col(f"after.`{f}`"), kinds[f])), F.lit(f)) for f in fields]))
    out = both.withColumn("op", op).where("op is not null")
    return out.select("op", *[F.coalesce(F.col(f"after.`{k}`"), F.col(f"before.`{k}`")).alias(k) for k in keys], F.when(F.col("op") == "u", changed).alias("changed"), "before", "after")


def _full(b: DataFrame, a: DataFrame, names: list[str]) -> DataFrame:
    """Full outer join; null key parts meet each other."""
    mark = {n: F.coalesce(F.col(n), F.lit("\u0000null")) for n in names}
    return b.withColumns(mark).join(a.withColumns(mark), names, "full")


def keyless(before: DataFrame, after: DataFrame) -> DataFrame:
    """op (c, d) and the row: multiset difference, from signed counts of equal rows in one aggregation."""
    fields, before = after.columns, aligned(before, after)
    both = before.select(*fields, F.lit(-1).alias("_n")).unionByName(after.select(*fields, F.lit(1).alias("_n")))
    net = both.groupBy(*fields).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.select(F.when(F.col("_n") > 0, "c").otherwise("d").alias("op"), *fields, F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_i")).drop("_i")


def summary(changes: DataFrame) -> DataFrame:
    """One row: created, updated, deleted."""
    return changes.agg(*[F.count(F.when(F.col("op") == o, 1)).alias(n) for o, n in (("c", "created"), ("u", "updated"), ("d", "deleted"))])


@dataclass(frozen=True)
class Limits:
    """Guards of a publication: shares of the live rows, and absolute numbers of rows."""

    change_ratio: float = 0.5
    delete_ratio: float = 0.3
    min_rows: int | None = None
    max_rows: int | None = None
    allow_empty: bool = False


#: Characters that a charset cannot hold; years of a date.
CHARSETS = {"ascii": r"[^\x00-\x7F]", "latin1": r"[^\x{0}-\x{FF}]", "utf8mb3": r"[\x{10000}-\x{10FFFF}]"}
YEARS = (1, 9999)
#: Guards that a forced publication does not pass over.
NEVER_FORCED = ("ERRORS", "SCHEMA", "VALUES")


def guards(live_rows: int, new_rows: int, created: int, updated: int, deleted: int, limits: Limits = Limits(), errors: int = 0, bad_values: int = 0, schema_problems: Sequence[str] = (), drift: bool = False) -> list[str]:
    """Names of the guards that fail, from counts alone."""
    failed = []
    if errors:
        failed.append("ERRORS")
    if not new_rows and live_rows and not limits.allow_empty:
        failed.append("EMPTY")
    if live_rows:
        if abs(new_rows - live_rows) / live_rows > limits.change_ratio:
            failed.append("ROW_CHANGE")
        if deleted / live_rows > limits.delete_ratio:
            failed.append("DELETES")
    if (limits.min_rows is not None and new_rows < limits.min_rows) or (limits.max_rows is not None and new_rows > limits.max_rows):
        failed.append("ROWS")
    if schema_problems:
        failed.append("SCHEMA")
    if drift:
        failed.append("DRIFT")
    if bad_values:
        failed.append("VALUES")
    return failed


def guard_ratios(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: live_rows, new_rows, created, updated, deleted, change_ratio, delete_ratio."""
    found = summary(keyed(before, after, keys)).crossJoin(before.agg(F.count("*").alias("live_rows"))).crossJoin(after.agg(F.count("*").alias("new_rows")))  # one row each
    return found.select(
        "live_rows", "new_rows", "created", "updated", "deleted",
        F.try_divide(F.abs(F.col("new_rows") - F.col("live_rows")).cast("double"), "live_rows").alias("change_ratio"),
        F.try_divide(F.col("deleted").cast("double"), "live_rows").alias("delete_ratio"),
    )


def schema_problems(df: DataFrame, target: T.StructType) -> list[str]:
    """Fields that the target lacks, needs, or holds in another type."""
    own, want = {f.name: f for f in df.schema}, {f.name: f for f in target}
    out = [f"unknown field {n}" for n in own if n not in want]
    out += [f"missing field {n}" for n, f in want.items() if n not in own and not f.nullable]
    return out + [f"{n}: {own[n].dataType.simpleString()} into {want[n].dataType.simpleString()}" for n in own if n in want and own[n].dataType != want[n].dataType]


def bad_values(df: DataFrame, target: T.StructType, lengths: Mapping[str, int] | None = None) -> DataFrame:
    """field, problem, n: values that do not fit the target (null, too long, out of range)."""
    checks: list[Column] = []
    for f in target:
        if f.name not in df.columns:
            continue
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            checks.append(F.when(c.isNull(), F.struct(F.lit(f.name).alias("field"), F.lit("null").alias("problem"))))
        if lengths and f.name in lengths:
            checks.append(F.when(F.length(c) > lengths[f.name], F.struct(F.lit(f.name).alias("field"), F.lit("too long").alias("problem"))))
        if isinstance(f.dataType, T.NumericType):
            checks.append(F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("field"), F.lit("out of range").alias("problem"))))
    found = df.select(F.explode(F.array_compact(F.array(*checks))).alias("x")) if checks else df.select(F.explode(F.array().cast("array<struct<field:string,problem:string>>")).alias("x"))
    return found.groupBy("x.field", "x.problem").agg(F.count("*").alias("n"))


def _misfits(f: T.StructField, c: Column, length: int | None, charset: str | None) -> list[tuple[Column, str]]:
    """(condition, problem) of the values of one field."""
    out = [(c.isNull(), "null")] if not f.nullable else []
    text = c.cast("string")
    if length is not None:
        out.append((F.length(text) > length, "too long"))
    if charset is not None:
        out.append((text.rlike(CHARSETS[charset]), f"not in {charset}"))
    if isinstance(f.dataType, T.IntegralType):
        number = text.try_cast("decimal(38,10)")
        out += [(c.isNotNull() & number.isNull(), "no number"), (number != F.floor(number), "not whole"), (number.isNotNull() & (number == F.floor(number)) & number.try_cast(f.dataType).isNull(), "out of range")]
    elif isinstance(f.dataType, T.DecimalType):
        digits = F.length(F.ltrim(F.regexp_extract(F.abs(text.try_cast("decimal(38,18)")).cast("string"), r"^\d*", 0), F.lit("0")))
        out += [(c.isNotNull() & text.try_cast("double").isNull(), "no number"), (digits > f.dataType.precision - f.dataType.scale, "too many digits")]
    elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        out.append((c.isNotNull() & text.try_cast("double").isNull(), "no number"))
    elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out += [(c.isNotNull() & text.try_cast("timestamp").isNull(), "no date"), (~F.year(text.try_cast("timestamp")).between(*YEARS), "date out of range")]
    return out


def offending(df: DataFrame, target: T.StructType, keys: Sequence[str] = (), lengths: Mapping[str, int] | None = None, charsets: Mapping[str, str] | None = None, most: int = 200) -> DataFrame:
    """field, problem, key, value, cells: the values that do not fit a target, the first `most` of each field by key (a report); `bad_values` counts.

    key: the texts of the key's fields, joined by |; cells: the addresses of a row that carries its lineage, else null.  Each field's rows
    are cut to `most` before they are sent anywhere.
    """
    checks = []
    for f in target:
        if f.name in df.columns:
            c = F.col(f"`{f.name}`")
            place = F.try_element_at("_cells", F.lit(f.name)) if "_cells" in df.columns else F.lit(None).cast("array<string>")
            for wrong, problem in _misfits(f, c, (lengths or {}).get(f.name), (charsets or {}).get(f.name)):
                checks.append(F.when(wrong, F.struct(F.lit(f.name).alias("field"), F.lit(problem).alias("problem"), c.cast("string").alias("value"), place.alias("cells"))))
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    each = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<struct<field:string,problem:string,value:string,cells:array<string>>>")
    rows = df.select(key.alias("key"), F.explode(each).alias("x")).select("x.field", "x.problem", "key", "x.value", "x.cells")
    place = F.row_number().over(Window.partitionBy("field").orderBy("key", "problem", "value"))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """field, problem, n like `bad_values`: rows beyond the first of their key, null keys included."""
    own, names = key_columns(df, list(keys), "_k")
    again = own.groupBy(*names).agg((F.count("*") - 1).alias("n")).where("n > 0")
    return again.agg(F.sum("n").alias("n")).where("n > 0").select(F.lit(",".join(keys)).alias("field"), F.lit("repeated").alias("problem"), "n")


def sharing_keys(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> int:
    """How many rows have a key that other rows have too."""
    own, names = key_columns(df, list(keys), "_k")
    theirs, _ = key_columns(others, list(keys), "_k")
    mark = {n: F.coalesce(F.col(n), F.lit("\u0000null")) for n in names}
    return own.withColumns(mark).join(theirs.withColumns(mark).select(*names), names, "left_semi").count()


def touched(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The partitions that rows touch."""
    return df.select(*fields).distinct()


def undone(live: DataFrame, before: DataFrame, fields: Sequence[str], parts: DataFrame) -> DataFrame:
    """The live rows with these partitions as they were before."""
    return live.join(parts, list(fields), "left_anti").unionByName(before.join(parts, list(fields), "left_semi").select(*live.columns))


def live_rows(live: DataFrame, new: DataFrame, fields: Sequence[str], few: int = 500) -> DataFrame:
    """The live rows of the partitions that `new` touches.  Up to `few` of them are named in a filter that the scan prunes by; more are joined."""
    parts = touched(new, fields)
    own = parts.limit(few + 1).collect()
    if len(own) > few:
        return live.join(parts, list(fields), "left_semi")
    hit = F.lit(False)
    for r in own:
        one = F.lit(True)
        for f in fields:
            one = one & F.col(f"`{f}`").eqNullSafe(F.lit(r[f]))
        hit = hit | one
    if len(fields) == 1 and all(r[0] is not None for r in own):
        hit = F.col(f"`{fields[0]}`").isin([r[0] for r in own])
    return live.where(hit)


def verdict(ratios: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The row of `guard_ratios` with failed, the guards that these counts break, in order."""
    some = F.col("live_rows") > 0
    checks = [
        (F.lit(not limits.allow_empty) & some & (F.col("new_rows") == 0), "EMPTY"), (some & (F.col("change_ratio") > limits.change_ratio), "ROW_CHANGE"), (some & (F.col("delete_ratio") > limits.delete_ratio), "DELETES"),
        (F.lit(False) if limits.min_rows is None else F.col("new_rows") < limits.min_rows, "ROWS"), (F.lit(False) if limits.max_rows is None else F.col("new_rows") > limits.max_rows, "ROWS"),
    ]
    return ratios.withColumn("failed", F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))))


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int, where: Column | None = None) -> DataFrame:
    """One page of rows in a stated order."""
    own = df if where is None else df.where(where)
    return own.orderBy(*order).offset(offset).limit(limit)


def replace_partitions(live: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The live rows with every partition that `new` touches replaced by its rows there; null partition values are an error upstream."""
    return live.join(touched(new, fields), list(fields), "left_anti").select(*new.columns).unionByName(new)
