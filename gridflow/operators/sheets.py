"""Regions of a cells DataFrame: where they lie, and how they become rows.

A cells DataFrame has at least sheet, row, col, value.  Shapes work on any number of sheets at once: every window and
group has the sheet in its key, so nothing meets in one task that does not belong to one sheet.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..sources.xlsx import address


@dataclass(frozen=True)
class Rect:
    """A closed rectangle, from 1."""

    top: int
    left: int
    bottom: int
    right: int

    def moved(self, rows: int, cols: int) -> Rect:
        return Rect(self.top + rows, self.left + cols, self.bottom + rows, self.right + cols)


def letters(col: Column) -> Column:
    """The letters of a column number, up to three."""
    at = lambda n: F.chr(F.lit(65) + n)
    one, two = F.pmod(col - 1, F.lit(26)), F.pmod(F.floor((col - 27) / 26), F.lit(26))
    three = F.pmod(F.floor((col - 703) / 676), F.lit(26))
    return F.concat(F.when(col > 702, at(three)).otherwise(""), F.when(col > 26, at(two)).otherwise(""), at(one))


def matching(text: Column, pattern: str, how: str = "EXACT") -> Column:
    own = norm_text(text)
    # a text without one of the characters needs no normalising; none that is searched for is deleted or replaced by it
    held = [text.contains(c) for c in dict.fromkeys(pattern) if not c.isspace()]
    return {
        "EXACT": lambda: reduce(lambda x, y: x & y, [*held, own == pattern]), "REGEX": lambda: own.rlike(r"\A(?:" + pattern + r")\z"), "CONTAINS": lambda: own.contains(pattern), "PREFIX": lambda: own.startswith(pattern),
    }[how]()


def anchors(cells: DataFrame, pattern: str, near: Rect, how: str = "EXACT") -> DataFrame:
    """sheet, row, col of the hit nearest to a design place in each sheet (then first by row and col), and hits, their number."""
    far = F.abs(F.col("row") - near.top) + F.abs(F.col("col") - near.left)
    hits = cells.where(matching(F.col("value"), pattern, how)).groupBy("sheet").agg(F.min(F.struct(far.alias("far"), "row", "col")).alias("x"), F.count("*").alias("hits"))
    return hits.select("sheet", "x.row", "x.col", "hits")


def similar(cells: DataFrame, text: str, most: int = 3) -> DataFrame:
    """The texts most like one that was not found: a report of `most` rows."""
    own = norm_text(F.col("value"))
    fit = cells.where(F.abs(F.length(own) - len(text)) <= max(2, len(text) // 2)).select("sheet", "row", "col", own.alias("value"), F.levenshtein(own, F.lit(text)).alias("distance"))
    return fit.orderBy("distance", "row", "col").limit(most)


def end_rows(cells: DataFrame, top: int, blanks: int = 1) -> DataFrame:
    """sheet, bottom: the last row before a gap of `blanks` blank rows, from row `top` on (gaps and islands)."""
    rows = cells.where((F.col("row") >= top) & (norm_text(F.col("value")) != "")).select("sheet", "row").distinct()
    run = Window.partitionBy("sheet").orderBy("row")
    gap = F.col("row") - F.lag("row", 1, top - 1).over(run) > blanks
    parts = rows.withColumn("part", F.sum(gap.cast("int")).over(run))
    return parts.where("part = 0").groupBy("sheet").agg(F.max("row").alias("bottom"))


def end_cols(cells: DataFrame, header: int, left: int) -> DataFrame:
    """sheet, right: the last column before the first blank header cell."""
    cols = cells.where((F.col("row") == header) & (F.col("col") >= left) & (norm_text(F.col("value")) != "")).select("sheet", "col").distinct()
    run = Window.partitionBy("sheet").orderBy("col")
    return cols.withColumn("n", F.row_number().over(run)).where(F.col("col") == left + F.col("n") - 1).groupBy("sheet").agg(F.max("col").alias("right"))


def cut(cells: DataFrame, rect: Rect, masks: Sequence[Rect] = ()) -> DataFrame:
    """The cells of a rectangle without those of masked ones."""
    out = cells.where(F.col("row").between(rect.top, rect.bottom) & F.col("col").between(rect.left, rect.right))
    for m in masks:
        out = out.where(~(F.col("row").between(m.top, m.bottom) & F.col("col").between(m.left, m.right)))
    return out


def detect_rows(cells: DataFrame) -> DataFrame:
    """sheet, top, bottom, left, right of each run of non-blank rows."""
    rows = cells.where(norm_text(F.col("value")) != "").groupBy("sheet", "row").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    run = Window.partitionBy("sheet").orderBy("row")
    marked = rows.withColumn("part", F.sum((F.col("row") - F.lag("row", 1, -1).over(run) > 1).cast("int")).over(run))
    return marked.groupBy("sheet", "part").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("a").alias("left"), F.max("b").alias("right")).drop("part")


def transposed(cells: DataFrame) -> DataFrame:
    return cells.withColumnsRenamed({"row": "_r"}).withColumnsRenamed({"col": "row"}).withColumnsRenamed({"_r": "col"})


def detail(cells: DataFrame, columns: Mapping[int, str], first_row: int, skip_comment: str | None = None, subtotals: Sequence[str] = ()) -> DataFrame:
    """One row for each sheet row from `first_row` on, one field for each stated column; blank rows are left out."""
    own = cells.where((F.col("row") >= first_row) & F.col("col").isin(*columns))
    out = own.groupBy("sheet", "row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(n) for c, n in columns.items()])
    fields = list(columns.values())
    out = out.where(F.coalesce(*[F.when(norm_text(F.col(f)) != "", F.lit(1)) for f in fields]).isNotNull())
    lead = F.coalesce(norm_text(F.col(fields[0])), F.lit(""))
    if skip_comment:
        out = out.where(~lead.startswith(skip_comment))
    return out.where(~lead.isin(*subtotals)) if subtotals else out


def headers(cells: DataFrame, rows: Sequence[int], joiner: str = "_") -> dict[int, str]:
    """Column names of one region from its header rows: upper levels filled forward, distinct parts joined, blank ones by letter, repeats numbered."""
    found: dict[int, dict[int, str]] = {}
    for r in cells.where(F.col("row").isin(*rows)).select("row", "col", norm_text(F.col("value")).alias("v")).collect():  # a few header cells
        found.setdefault(r["row"], {})[r["col"]] = r["v"]
    last = max((c for own in found.values() for c in own), default=0)
    seen: dict[str, int] = {}
    out: dict[int, str] = {}
    level = dict.fromkeys(rows, "")
    for c in range(min((c for own in found.values() for c in own), default=1), last + 1):
        parts: list[str] = []
        for i, r in enumerate(rows):
            v = found.get(r, {}).get(c, "")
            level[r] = v if v or i == len(rows) - 1 else level[r]
            if level[r] and (not parts or parts[-1] != level[r]):
                parts.append(level[r])
        name = joiner.join(parts) or "_col_" + address("", 1, c)[1:-1]
        seen[name] = seen.get(name, 0) + 1
        out[c] = name if seen[name] == 1 else f"{name}_{seen[name]}"
    return out


def key_values(cells: DataFrame, key_col: int, value_col: int, duplicates: str = "ERROR") -> DataFrame:
    """sheet, key, value (ARRAY: values): keys that begin with # are left out; of repeated keys the first (ERROR) or last stays, or all (ARRAY)."""
    keys = cells.where((F.col("col") == key_col) & (norm_text(F.col("value")) != "") & ~norm_text(F.col("value")).startswith("#")).select("sheet", "row", norm_text(F.col("value")).alias("key"))
    both = keys.join(cells.where(F.col("col") == value_col).select("sheet", "row", "value"), ["sheet", "row"], "left")
    if duplicates == "ARRAY":
        return both.groupBy("sheet", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("values"))
    pick = F.min_by if duplicates == "ERROR" else F.max_by
    return both.groupBy("sheet", "key").agg(pick("value", "row").alias("value"))


def key_values_wide(cells: DataFrame, key_col: int, value_col: int, fields: Mapping[str, str]) -> DataFrame:
    """One row a sheet with a field for each stated key."""
    long = key_values(cells, key_col, value_col)
    return long.groupBy("sheet").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in fields.items()])


def matrix(cells: DataFrame, header_rows: Mapping[int, str], header_cols: Mapping[int, str], value: str = "value", drop: Sequence[str] = (), drop_empty: bool = True, parsers: Mapping[str, tuple[str, str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot: one row for each body cell with its row headers (column: name) and column headers (row: name).

    Header cells that are blank take the one before them; rows and columns with a header in `drop`, or whose headers are
    all blank, are left out.  parsers: by header name an expression for the whole text and a type; its first group, if it
    has one, is the value.  A text that does not match stays as it is, or is null where the type is not string.
    """
    first_row, first_col = max(header_rows) + 1, max(header_cols) + 1
    text = F.when(norm_text(F.col("value")) != "", norm_text(F.col("value")))
    body = cells.where((F.col("row") >= first_row) & (F.col("col") >= first_col)).select("sheet", "row", "col", F.col("value").alias(value), *keep)
    rows = cells.where((F.col("row") >= first_row) & F.col("col").isin(*header_cols)).groupBy("sheet", "row").agg(*[F.max(F.when(F.col("col") == c, text)).alias(n) for c, n in header_cols.items()])
    cols = cells.where((F.col("col") >= first_col) & F.col("row").isin(*header_rows)).groupBy("sheet", "col").agg(*[F.max(F.when(F.col("row") == r, text)).alias(n) for r, n in header_rows.items()])
    down, across = Window.partitionBy("sheet").orderBy("row"), Window.partitionBy("sheet").orderBy("col")
    rows = body.select("sheet", "row").distinct().join(rows, ["sheet", "row"], "left").withColumns({n: F.last(n, ignorenulls=True).over(down) for n in header_cols.values()})
    cols = body.select("sheet", "col").distinct().join(cols, ["sheet", "col"], "left").withColumns({n: F.last(n, ignorenulls=True).over(across) for n in header_rows.values()})
    out = body.join(rows, ["sheet", "row"]).join(cols, ["sheet", "col"])
    for names in (header_cols.values(), header_rows.values()):
        out = out.where(F.coalesce(*[F.col(n) for n in names]).isNotNull())
        for n in names if drop else ():
            out = out.where(~F.coalesce(F.col(n).isin(*drop), F.lit(False)))
    for n, (pattern, kind) in (parsers or {}).items():
        whole = r"\A(?:" + pattern + r")\z"
        part = F.regexp_extract(F.col(n), whole, 1 if re.compile(pattern).groups else 0)
        fits = F.col(n).rlike(whole)
        out = out.withColumn(n, F.when(fits, part).otherwise(F.col(n)) if kind == "string" else F.when(fits, part.try_cast(kind)))
    return out.where(norm_text(F.col(value)) != "") if drop_empty else out


def metrics(long: DataFrame, dims: Sequence[str], metric: str, fields: Mapping[str, str], value: str = "value") -> DataFrame:
    """Metric names of an unpivoted matrix back to columns; of repeated cells the first by row and column (see `repeated_metrics`)."""
    place = F.struct("row", "col")
    return long.groupBy("sheet", *dims).agg(*[F.min_by(F.when(F.col(metric) == m, F.col(value)), F.when(F.col(metric) == m, place)).alias(n) for m, n in fields.items()])


def repeated_metrics(long: DataFrame, dims: Sequence[str], metric: str) -> DataFrame:
    """sheet, dims, metric, n: cells that meet in one place of the columns."""
    return long.groupBy("sheet", *dims, metric).agg(F.count("*").alias("n")).where("n > 1")


def grouped(rows: DataFrame, first: str, others: Sequence[str], field: str, title: Column | None = None, subtotal: str | None = None) -> DataFrame:
    """Title rows filled down into `field`, then left out; a title row has its first field only, unless a condition says so."""
    alone = F.col(first).isNotNull()
    for o in others:
        alone = alone & F.col(o).isNull()
    is_title = alone if title is None else title
    down = Window.partitionBy("sheet").orderBy("row")
    out = rows.withColumn("_t", F.coalesce(is_title, F.lit(False))).withColumn(field, F.last(F.when(F.col("_t"), F.col(first)), ignorenulls=True).over(down)).where("not _t").drop("_t")
    return out.where(~F.coalesce(F.col(first).rlike(subtotal), F.lit(False))) if subtotal else out


def form(cells: DataFrame, fields: Mapping[str, tuple[int, int]], by: Sequence[str] = ("sheet",)) -> DataFrame:
    """One row with a field for each stated (row, col)."""
    return cells.groupBy(*by).agg(*[F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col("value"))).alias(n) for n, (r, c) in fields.items()])


def in_blocks(cells: DataFrame, starts: DataFrame, high: int, wide: int) -> DataFrame:
    """The cells (sheet, row, col, ...) with top and left of the block that holds them, for blocks of one size.

    An equi-join on a grid of the block's size: a cell lies in one place of the grid, a block in four at most.
    """
    spread = {"gy": F.explode(F.sequence(F.floor(F.col("top") / high), F.floor((F.col("top") + high - 1) / high))), "gx": F.explode(F.sequence(F.floor(F.col("left") / wide), F.floor((F.col("left") + wide - 1) / wide)))}
    dealt = starts.withColumn("gy", spread["gy"]).withColumn("gx", spread["gx"])
    met = cells.withColumns({"gy": F.floor(F.col("row") / high), "gx": F.floor(F.col("col") / wide)}).join(dealt, ["sheet", "gy", "gx"])
    return met.where(F.col("row").between(F.col("top"), F.col("top") + high - 1) & F.col("col").between(F.col("left"), F.col("left") + wide - 1)).drop("gy", "gx")


def overlapping(starts: DataFrame, high: int, wide: int) -> DataFrame:
    """The sheets in which two blocks of one size meet.

    Two blocks that begin in one place of a grid of the block's size meet; where every place has one, each is compared with
    those of four neighbouring places.
    """
    places = starts.groupBy("sheet", F.floor(F.col("top") / high).alias("gy"), F.floor(F.col("left") / wide).alias("gx")).agg(F.count("*").alias("n"), F.min("top").alias("top"), F.min("left").alias("left"))
    near = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    asking = places.where("n = 1").withColumn("o", near).select("sheet", (F.col("gy") + F.col("o.y")).alias("gy"), (F.col("gx") + F.col("o.x")).alias("gx"), F.col("top").alias("t"), F.col("left").alias("l"))
    met = asking.join(places, ["sheet", "gy", "gx"]).where((F.abs(F.col("top") - F.col("t")) < high) & (F.abs(F.col("left") - F.col("l")) < wide))
    return places.where("n > 1").select("sheet").union(met.select("sheet")).distinct()


def repeating(cells: DataFrame, anchor: str, height: int, width: int, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    """One row for each block that an anchor text begins: its ordinal and its fields at places within the block (from 1); see `overlapping`."""
    starts = cells.where(matching(F.col("value"), anchor, "REGEX")).select("sheet", F.col("row").alias("top"), F.col("col").alias("left"))
    starts = starts.withColumn("block", F.row_number().over(Window.partitionBy("sheet").orderBy("top", "left")))
    inside = in_blocks(cells.select("sheet", "row", "col", "value"), starts, height, width)
    local = inside.select("sheet", "block", (F.col("row") - F.col("top") + 1).alias("row"), (F.col("col") - F.col("left") + 1).alias("col"), "value")
    return form(local, fields, ("sheet", "block"))


def strided(cells: DataFrame, region: Rect, step: tuple[int, int], size: tuple[int, int], fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    """One row for each block of a grid of equal blocks (rows and cols from one block's corner to the next; rows and cols of a block): its ordinal and fields; blank blocks are left out.

    step: 0 for a direction in which there is one block.  Blocks must not overlap.
    """
    for d, n in zip(step, size, strict=True):
        if 0 < d < n:
            raise ValueError("BLOCK_OVERLAP")
    r, c = F.col("row") - region.top, F.col("col") - region.left
    down, right = (F.floor(x / d) if d else F.lit(0) for x, d in ((r, step[0]), (c, step[1])))
    across = (region.right - region.left) // step[1] + 1 if step[1] else 1
    own = cut(filled_cells(cells), region).select("sheet", (down * across + right + 1).cast("int").alias("block"), (r - down * step[0] + 1).alias("row"), (c - right * step[1] + 1).alias("col"), "value")
    return form(own.where((F.col("row") <= size[0]) & (F.col("col") <= size[1])), fields, ("sheet", "block"))


def filled_cells(cells: DataFrame) -> DataFrame:
    return cells.where(norm_text(F.col("value")) != "")


def outside(fields: Mapping[str, tuple[int, int]], rows: int, cols: int) -> list[str]:
    """Fields of a form whose place is not in it."""
    return [f for f, (r, c) in fields.items() if not (1 <= r <= rows and 1 <= c <= cols)]


def union_sheets(rows: DataFrame, pattern: str | None, as_column: str = "_sheet") -> DataFrame:
    """Rows of the sheets whose name matches, with the name as a field."""
    out = rows.where(F.col("sheet").rlike(r"\A(?:" + pattern + r")\z")) if pattern else rows
    return out.withColumnRenamed("sheet", as_column)
