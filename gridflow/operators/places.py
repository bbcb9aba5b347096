"""Cells as lines, and the places of regions in them.

A line is a row of a sheet with all its cells.  Cells are gathered into lines once and dealt by (sheet, band), a band being some
rows of a sheet; whatever asks for lines in a plan is served by that exchange (Spark reuses it), so a source is read once
however many regions, headers, ends and shapes ask for its cells.  A sheet's places are one row, found by three aggregations
over lines at most: the anchors of all regions, their right ends and their bottoms.  Where lines ask for what is known of their
sheet, that row is repeated for each band, so a large sheet is met where its lines are and never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, norm_text
from .binding import CELL, Spec
from .sheets import Rect, matching

#: Rows of a sheet that are looked at together for gaps; windows run over such buckets, not over rows.
BUCKET = 4096
#: A band has 2 ** BAND rows of a sheet.
BAND = 9
PLACED = CELL[:-1] + ",r:int,c:int>"
RECT = "struct<top:int,left:int,bottom:int,right:int>"


@dataclass(frozen=True)
class Region:
    """Where a region lies, what shape it has, and which fields it gives.

    locator: FIXED (the design), ANCHOR (a text, then an offset) or AUTO_EXPAND (from the design's corner to the first blank
    header cell and a gap of `blanks` rows).  rows: FIXED_SIZE, SHEET_END, UNTIL_BLANK_ROWS or UNTIL_ANCHOR; cols: FIXED_SIZE,
    SHEET_END or UNTIL_BLANK_HEADER.

    shape and what it asks for, places being counted from 1 in the region:
    DETAIL: header_rows, joiner, comment, subtotals, hidden, strike; orientation COLUMN reads columns as rows.
    GROUPED_DETAIL: those, and rows whose first cell stands alone (group_by FIRST_CELL_ONLY), whose first text matches
    `group_pattern` (REGEX), give `group_field` for what follows; its first group, if it has one, is the value; rows whose
    first text matches `subtotal_pattern` are left out.
    SUMMARY: the first row that is not blank, with names from `align`; layout KV reads it as KEY_VALUE.
    KEY_VALUE: key_col, value_col, duplicates (ERROR, LAST, ARRAY: texts joined by |), long (rows of key and value);
    orientation HORIZONTAL has the keys in a row.
    MATRIX: row_dims and col_dims (names of header columns and rows), value_name, totals, drop_empty, parsers, metric.
    FORM: fields.  REPEATING_BLOCK: block (rows, cols), block_anchor (an expression) or stride (rows, cols), inner (FORM or
    KEY_VALUE), skip_empty; the ordinal of a block is the field _block.  IGNORE: only masks others.
    """

    id: str
    design: Rect
    locator: str = "FIXED"
    anchor: str = ""
    match: str = "EXACT"
    offset: tuple[int, int] = (0, 0)
    rows: str = "FIXED_SIZE"
    cols: str = "FIXED_SIZE"
    blanks: int = 1
    end: str = ""
    end_match: str = "EXACT"
    inclusive: bool = False
    any_column: bool = False
    shape: str = "DETAIL"
    orientation: str = "ROW"
    header_rows: int = 1
    joiner: str = "_"
    align: Sequence[str] = ()
    layout: str = "ROW"
    specs: Sequence[Spec] = ()
    new_columns: str = "DROP"
    hidden: str = "KEEP_WARN"
    strike: str = "KEEP"
    comment: str = ""
    subtotals: Sequence[str] = ()
    exclude: Sequence[str] = ()
    group_field: str = "group"
    group_by: str = "FIRST_CELL_ONLY"
    group_pattern: str = ""
    subtotal_pattern: str = ""
    key_col: int = 1
    value_col: int = 2
    duplicates: str = "ERROR"
    long: bool = False
    row_dims: Sequence[str] = ()
    col_dims: Sequence[str] = ()
    value_name: str = "value"
    totals: Sequence[str] = ()
    drop_empty: bool = True
    parsers: dict[str, tuple[str, str]] = field(default_factory=dict)
    metric: str = ""
    fields: dict[str, tuple[int, int]] = field(default_factory=dict)
    block: tuple[int, int] = (1, 1)
    block_anchor: str = ""
    stride: tuple[int, int] = (0, 0)
    inner: str = "FORM"
    skip_empty: bool = True

    @property
    def turned(self) -> bool:
        return self.orientation in ("COLUMN", "HORIZONTAL")


def shared(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt by some columns, in as many tasks as the session wants, by an exchange that all who use it in a plan share.

    Its other columns are made by a generator, so no filter on them and no choice among them reaches below the exchange and
    makes it another one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).select(*by, F.inline(F.array(F.struct(*[c for c in df.columns if c not in by]))))


def band(row: Column) -> Column:
    return F.shiftright(row, BAND)


def by_bands(rects: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """Each row once for each band between two rows of its sheet, with it as `band`."""
    return rects.withColumn("band", F.explode(F.when(top <= bottom, F.sequence(band(top), band(bottom)))))


def lines(cells: DataFrame) -> DataFrame:
    """sheet, band, row, line: a map from col to cell (value, kind, flags, and its place r and c); of cells in one place the greatest."""
    more = [c for c in ("kind", "flags") if c not in cells.columns]
    cells = cells.withColumns({c: F.lit("s") if c == "kind" else F.lit(0) for c in more}) if more else cells
    cell = F.struct("value", "kind", F.col("flags").cast("int").alias("flags"), F.col("row").alias("r"), F.col("col").alias("c")).cast(PLACED)
    own = cells.select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), cell.alias("cell")).where("sheet is not null and row is not null and col is not null")
    made = own.groupBy("sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", "cell"))).alias("all"))
    last = F.filter("all", lambda x, i: F.coalesce(F.get(F.col("all"), i + 1)["col"] != x["col"], F.lit(True)))
    return shared(made.select("sheet", band(F.col("row")).alias("band"), "row", F.map_from_entries(last).alias("line")).where("band is not null"), "sheet", "band")


def text_of(cell: Column) -> Column:
    return norm_text(cell["value"])


def at(line: Column | str, col: Column | int) -> Column:
    return F.try_element_at(F.col(line) if isinstance(line, str) else line, F.lit(col) if isinstance(col, int) else col)


def filled_cols(line: Column | str = "line") -> Column:
    return F.map_keys(F.map_filter(line, lambda c, v: has_text(v["value"])))


def _filled_in(left: Column, right: Column) -> Column:
    return F.exists(F.map_entries("line"), lambda e: e["key"].between(left, right) & has_text(e["value"]["value"]))


def _hits(r: Region) -> Column:
    """A line's cells that match an anchor: how far from the design, row and col."""
    row = F.col("row")
    hit = F.filter(F.map_entries("line"), lambda e: F.coalesce(matching(e["value"]["value"], r.anchor, r.match), F.lit(False)))
    return F.transform(hit, lambda e: F.struct((F.abs(row - r.design.top) + F.abs(e["key"] - r.design.left)).alias("far"), row.alias("row"), e["key"].alias("col")))


def _run(left: Column) -> Column:
    """The filled columns from `left` on that follow each other."""
    return F.filter(F.array_sort(F.filter(filled_cols(), lambda c: c >= left)), lambda c, k: c == left + k)


def _stops(r: Region, left: Column, right: Column) -> Column:
    """Whether an end text stands in a line between two columns."""
    return F.exists(F.map_entries("line"), lambda e: e["key"].between(left, right) & F.coalesce(matching(e["value"]["value"], r.end, r.end_match), F.lit(False)))


def _before_gap(rows: Column, blanks: int) -> Column:
    """The first of some sorted rows after which more than so many are lacking."""
    return F.array_min(F.filter(rows, lambda x, k: F.coalesce(F.get(rows, k + 1) - x > blanks, F.lit(False))))


def places(own: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """A row a sheet: sheet, last (its last row) and, for the region of number i, p<i> (its rectangle, null where it was not found), hits<i> (of its anchor) and lost<i> (its end was not found)."""
    row = F.col("row")
    wide = any(r.cols == "SHEET_END" and r.locator != "AUTO_EXPAND" for r in regions)
    found = [F.max("wide").alias("widest"), F.max("row").alias("last")]
    each = [row.alias("row"), (F.array_max(filled_cols()) if wide else F.lit(None).cast("int")).alias("wide")]
    for i, r in enumerate(regions):
        if r.locator == "ANCHOR":
            each.append(_hits(r).alias(f"near{i}"))
            found += [F.min(F.array_min(f"near{i}")).alias(f"hit{i}"), F.sum(F.size(f"near{i}")).alias(f"hits{i}")]
    # what is sorted for the least of places are these few columns, not lines
    starts = own.select("sheet", F.inline(F.array(F.struct(*each)))).groupBy("sheet").agg(*found)
    made: dict[str, Column] = {}
    for i, r in enumerate(regions):
        anchored = r.locator == "ANCHOR"
        made[f"top{i}"] = F.col(f"hit{i}.row") + r.offset[0] if anchored else F.lit(r.design.top)
        made[f"left{i}"] = F.col(f"hit{i}.col") + r.offset[1] if anchored else F.lit(r.design.left)
        made[f"hits{i}"] = F.coalesce(f"hits{i}", F.lit(0)) if anchored else F.lit(1).cast("long")
    starts = starts.select("sheet", "last", "widest", *[c.alias(n) for n, c in made.items()])
    keep = ["last"] + [f"{c}{i}" for i in range(len(regions)) for c in ("top", "left", "hits")]

    cols = {i: "UNTIL_BLANK_HEADER" if r.locator == "AUTO_EXPAND" else r.cols for i, r in enumerate(regions)}
    heads = []
    for i in (i for i, c in cols.items() if c == "UNTIL_BLANK_HEADER"):
        left = F.col(f"left{i}")
        heads.append(F.max(F.when(row == F.col(f"top{i}"), left + F.size(_run(left)) - 1)).alias(f"head{i}"))
    if heads:
        tops = F.array_distinct(F.array_compact(F.array(*[band(F.col(f"top{i}")) for i, c in cols.items() if c == "UNTIL_BLANK_HEADER"])))
        met = own.join(starts.withColumn("band", F.explode(tops)).hint("shuffle_hash"), ["sheet", "band"])
        starts = starts.join(met.groupBy("sheet").agg(*heads), "sheet", "left")
    right = {}
    for i, r in enumerate(regions):
        left = F.col(f"left{i}")
        right[f"right{i}"] = left + (r.design.right - r.design.left) if cols[i] == "FIXED_SIZE" else F.when(left.isNotNull(), F.greatest(left, "widest" if cols[i] == "SHEET_END" else f"head{i}"))
    starts = starts.select("sheet", *keep, *[c.alias(n) for n, c in right.items()])

    rows = {i: "UNTIL_BLANK_ROWS" if r.locator == "AUTO_EXPAND" else r.rows for i, r in enumerate(regions)}
    keep += right
    ends, gaps = [], [i for i, w in rows.items() if w == "UNTIL_BLANK_ROWS"]
    for i, r in enumerate(regions):
        top, left, end = F.col(f"top{i}"), F.col(f"left{i}"), F.col(f"right{i}")
        if rows[i] == "SHEET_END":
            ends.append(F.max(F.when((row >= top) & _filled_in(left, end), row)).alias(f"end{i}"))
        elif rows[i] == "UNTIL_ANCHOR":
            ends.append(F.min(F.when((row > top) & _stops(r, left, end if r.any_column else left), row)).alias(f"end{i}"))
        elif rows[i] == "UNTIL_BLANK_ROWS":
            ends.append(F.array_sort(F.collect_set(F.when((row >= top) & _filled_in(left, end), row))).alias(f"end{i}"))
    if ends:
        first = F.least(*[f"top{i}" for i, w in rows.items() if w != "FIXED_SIZE"], "last")
        met = own.join(by_bands(starts, first, F.col("last")).hint("shuffle_hash"), ["sheet", "band"])
        if gaps:
            met = met.groupBy("sheet", *keep, F.floor(row / BUCKET).alias("bucket")).agg(*ends)
            before = Window.partitionBy("sheet").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            stops = {}
            for i in gaps:
                own_rows = F.col(f"end{i}")
                low, high = F.get(own_rows, F.lit(0)), F.get(own_rows, F.size(own_rows) - 1)
                last = F.coalesce(F.last(high, ignorenulls=True).over(before), F.col(f"top{i}") - 1)
                stops[f"stop{i}"] = F.when(low - last > regions[i].blanks, last).otherwise(_before_gap(own_rows, regions[i].blanks))
                stops[f"high{i}"] = high
            met = met.withColumns(stops)
            ends = [F.coalesce(F.min(f"stop{i}"), F.max(f"high{i}")).alias(f"end{i}") if i in gaps else (F.max if rows[i] == "SHEET_END" else F.min)(f"end{i}").alias(f"end{i}") for i in rows if rows[i] != "FIXED_SIZE"]
        starts = starts.join(met.groupBy("sheet").agg(*ends), "sheet", "left")
    out: list[Column] = []
    for i, r in enumerate(regions):
        top = F.col(f"top{i}")
        if rows[i] == "FIXED_SIZE":
            bottom = top + (r.design.bottom - r.design.top)
        elif rows[i] == "UNTIL_ANCHOR":
            bottom = F.col(f"end{i}") - (0 if r.inclusive else 1)
        else:
            bottom = F.greatest(top, f"end{i}")
        rect = F.struct(top.alias("top"), F.col(f"left{i}").alias("left"), bottom.alias("bottom"), F.col(f"right{i}").alias("right")).cast(RECT)
        out += [F.when(top.isNotNull() & bottom.isNotNull(), rect).alias(f"p{i}"), F.col(f"hits{i}"), (top.isNotNull() & bottom.isNull()).alias(f"lost{i}")]
    return starts.select("sheet", "last", *out)


def meet(a: str, b: str) -> Column:
    """Whether two rectangles have a cell in common."""
    apart = [F.col(f"{a}.{lo}") <= F.col(f"{b}.{hi}") for lo, hi in (("top", "bottom"), ("left", "right"))]
    apart += [F.col(f"{b}.{lo}") <= F.col(f"{a}.{hi}") for lo, hi in (("top", "bottom"), ("left", "right"))]
    return F.coalesce(reduce(lambda x, y: x & y, apart), F.lit(False))


def clash(a: Region, b: Region) -> bool:
    """Whether two regions must not meet: neither is ignored or excludes the other, nor are both of keys and values."""
    return "IGNORE" not in (a.shape, b.shape) and b.id not in a.exclude and a.id not in b.exclude and not a.shape == b.shape == "KEY_VALUE"
