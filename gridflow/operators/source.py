"""The source node: regions of sheets are located, cut, shaped, bound to specs and coerced, for all sheets at once.

Cells become lines once (see `places`), which serves all that a plan asks of them.  A region's place and its header's columns
may differ from sheet to sheet, so both are small tables with a row for each sheet, and lines meet them by an equi-join on the
sheet and band.  Nothing is collected but names of columns that no spec asks for, where they are to be included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text
from . import lineage as origin
from . import sheets
from .binding import Spec, coerce_rows, matches, spec_problems
from .places import PLACED, RECT, Region, at, band, by_bands, clash, filled_cols, lines, meet, places, shared, text_of
from .rows import Flow, issues
from .sheets import Rect, letters, matching

#: Row flags of the workbook reader.
BOLD, HIDDEN_ROW, STRIKE = 2, 1, 4
#: A located region that is so much higher or lower than designed gets a warning.
SIZE_CHANGE = 0.5
#: Lines of more cells are cut into tiles of so many columns before blocks take theirs.
TILE = 64
#: Issues whose plan is made when they are asked for.
Found = Callable[[], DataFrame]


def picked_sheets(cells: DataFrame, how: str, what: str | int) -> DataFrame:
    """Cells of the sheets with this name (EXACT), whose whole name matches (REGEX), or at this place from 0 (INDEX)."""
    if how == "INDEX":
        return cells.where(F.col("sheet_no") == what)
    return cells.where(F.col("sheet") == what if how == "EXACT" else F.col("sheet").rlike(r"\A(?:" + str(what) + r")\z"))


def filled(cells: DataFrame) -> DataFrame:
    return cells.where(norm_text(F.col("value")) != "")


def find_cells(cells: DataFrame, text: str, how: str = "EXACT", scope: Rect | None = None) -> DataFrame:
    """The cells of a scope whose text matches."""
    own = cells if scope is None else cells.where(F.col("row").between(scope.top, scope.bottom) & F.col("col").between(scope.left, scope.right))
    return own.where(matching(F.col("value"), text, how))


def locate(cells: DataFrame, region: Region) -> Flow:
    """sheet, top, left, bottom, right of a region in each sheet that has it; issues for those that do not, or not clearly."""
    placed = places(lines(cells), [region])
    return Flow(placed.where("p0 is not null").select("sheet", "p0.*"), issues=lambda: place_issues(placed, [region]))


def place_issues(placed: DataFrame, regions: Sequence[Region], whole: bool = False) -> DataFrame:
    """What is wrong with the places of regions, counted by sheet; `whole`: also changed sizes and regions that meet."""
    found: list[tuple[Column, str, str, str, str | None]] = []
    for i, r in enumerate(regions):
        found += [(F.col(f"hits{i}") == 0, r.id, "ERROR", "ANCHOR_NOT_FOUND", None), (F.col(f"hits{i}") > 1, r.id, "WARN", "ANCHOR_AMBIGUOUS", None), (F.col(f"lost{i}"), r.id, "ERROR", "END_ANCHOR_NOT_FOUND", None)]
        if whole and r.locator != "FIXED":
            want = r.design.bottom - r.design.top + 1
            found.append((F.abs(F.col(f"p{i}.bottom") - F.col(f"p{i}.top") + 1 - want) > SIZE_CHANGE * want, r.id, "WARN", "REGION_SIZE_CHANGED", None))
        if whole:
            found += [(meet(f"p{i}", f"p{j}"), r.id, "ERROR", "REGION_OVERLAP", o.id) for j, o in enumerate(regions) if i < j and clash(r, o)]
    each = [F.when(cond, F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("node", "severity", "code", "message"), (node, severity, code, message), strict=True)])) for cond, node, severity, code, message in found]
    rows = placed.select("sheet", F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*", F.col("sheet").alias("field"))
    return rows.groupBy("node", "severity", "code", "message", "field").agg(F.count("*").alias("n"))


def _all(found: Sequence[Found]) -> DataFrame | None:
    made = [f() for f in found]
    return reduce(DataFrame.unionByName, made) if made else None


def report(located: DataFrame, region: Region) -> DataFrame:
    """sheet, rows and cols moved against the design, height, and whether the height changed by more than half (never for FIXED)."""
    d = region.design
    high, want = F.col("bottom") - F.col("top") + 1, d.bottom - d.top + 1
    changed = F.lit(False) if region.locator == "FIXED" else F.abs(high - want) > SIZE_CHANGE * want
    return located.select("sheet", (F.col("top") - d.top).alias("moved_rows"), (F.col("left") - d.left).alias("moved_cols"), high.alias("height"), changed.alias("size_changed"))


def overlaps(located: Mapping[str, DataFrame], regions: Sequence[Region]) -> DataFrame:
    """sheet, a, b: regions that meet in a sheet though neither excludes the other; ignored ones and pairs of key-value regions may."""
    own = [located[r.id].withColumn("id", F.lit(r.id)) for r in regions if r.shape != "IGNORE"]
    rects = reduce(DataFrame.unionByName, own)
    free = {(a.id, b.id) for a in regions for b in regions if b.id in a.exclude or a.id in b.exclude or a.shape == b.shape == "KEY_VALUE"}
    left, right = rects.select("sheet", *[F.col(c).alias(f"{c}_a") for c in ("top", "left", "bottom", "right", "id")]), rects.select("sheet", *[F.col(c).alias(f"{c}_b") for c in ("top", "left", "bottom", "right", "id")])
    met = left.join(right, "sheet").where("id_a < id_b and top_a <= bottom_b and top_b <= bottom_a and left_a <= right_b and left_b <= right_a")
    return met.where(~F.concat_ws("\u0000", "id_a", "id_b").isin(*["\u0000".join(p) for p in free] or [""])).select("sheet", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def cut(cells: DataFrame, located: DataFrame, masks: Sequence[DataFrame] = ()) -> DataFrame:
    """The cells of each sheet's rectangle, without those of masked rectangles; row and col stay those of the sheet."""
    out = cells.join(located, "sheet").where("row between top and bottom and col between left and right")
    for m in masks:
        held = m.select("sheet", *[F.col(c).alias(f"_{c}") for c in ("top", "left", "bottom", "right")])
        out = out.join(held, "sheet", "left").where("not coalesce(row between _top and _bottom and col between _left and _right, false)").select(*out.columns)
    return out


def preview(cells: DataFrame, located: DataFrame, rows: int = 20, cols: int = 20) -> DataFrame:
    """The upper left cells of each rectangle: a report of `rows` times `cols` a sheet."""
    return cut(cells, located).where((F.col("row") < F.col("top") + rows) & (F.col("col") < F.col("left") + cols)).select("sheet", "row", "col", "value")


def padded(cells: DataFrame, located: DataFrame) -> DataFrame:
    """Every place of each rectangle: sheet, row, col, value, null where the sheet has no cell."""
    grid = located.select("sheet", F.explode(F.sequence("top", "bottom")).alias("row"), "left", "right").select("sheet", "row", F.explode(F.sequence("left", "right")).alias("col"))
    return grid.join(cells.select("sheet", "row", "col", "value"), ["sheet", "row", "col"], "left")


def header_names(own: DataFrame, located: DataFrame, region: Region) -> DataFrame:
    """sheet, col, name: upper levels filled forward, distinct neighbours joined, blank ones by column letter, repeats numbered."""
    cols = located.select("sheet", "top", F.explode(F.sequence("left", "right")).alias("col"), "left")
    if region.shape == "SUMMARY":
        given = F.lit(None).cast("string")
        for i, n in enumerate(region.align):
            given = F.when(F.col("col") == F.col("left") + i, F.lit(n)).otherwise(given)
        named = cols.select("sheet", "col", F.coalesce(given, F.concat(F.lit("_col_"), letters(F.col("col")))).alias("name"))
    elif region.header_rows < 1:
        named = cols.select("sheet", "col", letters(F.col("col") - F.col("left") + 1).alias("name"))
    else:
        k = region.header_rows
        text = F.when(norm_text(F.col("value")) != "", norm_text(F.col("value")))
        levels = own.where(F.col("row") < F.col("top") + k).groupBy("sheet", "col").agg(*[F.max(F.when(F.col("row") == F.col("top") + i, text)).alias(f"h{i}") for i in range(k)])
        across = Window.partitionBy("sheet").orderBy("col")
        levels = cols.join(levels, ["sheet", "col"], "left").withColumns({f"h{i}": F.last(f"h{i}", ignorenulls=True).over(across) for i in range(k - 1)})
        parts = F.array_compact(F.array(*[f"h{i}" for i in range(k)]))
        parts = F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, i - 1)))
        blank = F.concat(F.lit("_row_"), F.col("col")) if region.turned else F.concat(F.lit("_col_"), letters(F.col("col")))
        named = levels.select("sheet", "col", F.when(F.size(parts) > 0, F.array_join(parts, region.joiner)).otherwise(blank).alias("name"))
    turn = F.row_number().over(Window.partitionBy("sheet", "name").orderBy("col"))
    return named.withColumn("n", turn).select("sheet", "col", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", "n")).alias("name"), (F.col("n") > 1).alias("repeated"))


# shapes.  A view is the lines of one region without the cells outside it or masked.


class _Cut:
    """The lines of one region: `rect` has its rectangles, in which rows and columns change places where the region is turned.

    more: rows and columns beyond the rectangle that are looked at too.
    """

    def __init__(self, own: DataFrame, placed: DataFrame, i: int, regions: Sequence[Region], more: tuple[int, int] = (0, 0)) -> None:
        r = regions[i]
        self.own, self.turned, self.more = own, r.turned, more
        self.masks = [f"p{j}" for j, m in enumerate(regions) if j != i and (m.shape == "IGNORE" or m.id in r.exclude)]
        self.all = placed.where(F.col(f"p{i}").isNotNull()).select("sheet", "last", f"p{i}.*", *self.masks)
        names = {"top": "left", "left": "top", "bottom": "right", "right": "bottom"} if r.turned else {}
        self.rect = self.all.select("sheet", *[F.col(names.get(c, c)).alias(c) for c in ("top", "left", "bottom", "right")])

    def view(self, beside: DataFrame | None = None) -> DataFrame:
        """sheet, band, row, line, top, left, bottom, right and what `beside` has for each sheet, which meets the lines in the same join."""
        row = F.col("row")

        def stays(c: Column, _: Column) -> Column:
            fine = c.between(F.col("left"), F.col("right") + self.more[1])
            for m in self.masks:
                fine = fine & ~F.coalesce(row.between(F.col(f"{m}.top"), F.col(f"{m}.bottom")) & c.between(F.col(f"{m}.left"), F.col(f"{m}.right")), F.lit(False))
            return fine

        extra = [c for c in beside.columns if c != "sheet"] if beside is not None else []
        rect = self.all if beside is None else self.all.join(beside, "sheet")
        low = F.col("bottom") + self.more[0]
        met = self.own.join(by_bands(rect, F.col("top"), F.least(low, "last")).hint("shuffle_hash"), ["sheet", "band"]).where(row.between(F.col("top"), low))
        cut = met.select("sheet", "band", "row", F.map_filter("line", stays).alias("line"), "top", "left", "bottom", "right", *extra)
        if not self.turned:
            return cut
        # a sheet's rectangle and its extras are the same for all its columns
        sides = [F.col(b).alias(a) for a, b in (("top", "left"), ("left", "top"), ("bottom", "right"), ("right", "bottom"))]
        cells = cut.select("sheet", "row", F.explode("line").alias("col", "cell"), *sides, *extra)
        return cells.groupBy("sheet", "col", "top", "left", "bottom", "right", *extra).agg(F.map_from_entries(F.collect_list(F.struct("row", "cell"))).alias("line")).withColumnRenamed("col", "row").withColumn("band", band(F.col("row")))


def lone(value: Column) -> Column:
    """A text as a cell without a place."""
    none = F.lit(None).cast("int")
    return F.struct(value.cast("string").alias("value"), F.lit("s").alias("kind"), F.lit(0).alias("flags"), none.alias("r"), none.alias("c")).cast(PLACED)


def named(spec: Spec, name: str) -> bool:
    """Whether a fixed name is a spec's header."""
    s = spec.header
    return bool(re.fullmatch(s[1:-1], name)) if len(s) > 2 and s[0] == s[-1] == "/" else " ".join(s.split()) == name


def _missing(rows: DataFrame, region: Region, absent: Mapping[int, Column]) -> list[Found]:
    """Issues of specs without a header: `absent` says so by a spec's number."""
    return [lambda: _absent(rows, region, absent)] if absent else []


def _absent(rows: DataFrame, region: Region, absent: Mapping[int, Column]) -> DataFrame:
    each = [F.when(c, F.struct(F.lit(region.specs[i].field).alias("field"), F.lit(region.specs[i].required).alias("required"))) for i, c in absent.items()]
    found = rows.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")
    found = found.groupBy("field", "required").agg(F.count("*").alias("n"))
    required = F.col("required")
    return found.select(
        F.lit(region.id).alias("node"), F.when(required, "ERROR").otherwise("WARN").alias("severity"), F.when(required, "HEADER_MISSING_REQUIRED").otherwise("HEADER_MISSING").alias("code"),
        F.lit(None).cast("string").alias("message"), "field", "n",
    )


def _counted(found: DataFrame, node: str, code: str) -> DataFrame:
    """Issues of fields that are counted already."""
    return found.select(F.lit(node).alias("node"), F.lit("ERROR").alias("severity"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("message"), "field", "n")


class _Shaped:
    """A shape's rows before coercion: `keep` columns, c<i> (the cell of each spec), by spec whether its header is there, and issues."""

    def __init__(self, rows: DataFrame, specs: Sequence[Spec], found: list[Found], bound: Mapping[int, Column] | None = None, keep: tuple[str, ...] = ("sheet", "row")) -> None:
        self.rows, self.specs, self.found, self.bound, self.keep = rows, specs, found, bound or {}, keep


def _detail(cut: _Cut, r: Region) -> _Shaped:
    """DETAIL, GROUPED_DETAIL and SUMMARY: a row a line, below the header."""
    k, found = 0 if r.shape == "SUMMARY" else max(0, r.header_rows), []
    head = cut.view().where(F.col("row") < F.col("top") + k).select("sheet", "row", "top", F.explode("line").alias("col", "cell"))
    heads = header_names(head.withColumn("value", F.col("cell.value")), cut.rect, r)
    below = F.col("row") >= F.col("top") + k
    specs, titled = list(r.specs), {i for i, s in enumerate(r.specs) if r.shape == "GROUPED_DETAIL" and named(s, r.group_field)}

    def bind() -> DataFrame:
        """sheet, s0, s1, ...: the first column of each spec's header."""
        return heads.groupBy("sheet").agg(*[F.min(F.when(matches(F.col("name"), s), F.col("col"))).alias(f"s{i}") for i, s in enumerate(specs)])

    bound = bind()
    if r.shape != "SUMMARY":
        used = F.array(*[f"s{i}" for i in range(len(specs))])
        extra = heads.join(bound, "sheet").where(~F.coalesce(F.array_contains(F.array_compact(used), F.col("col")), F.lit(False)) & ~F.col("name").startswith("_block")).select("sheet", "col", "name")
        extra = extra.join(cut.view().where(below).select("sheet", F.explode(filled_cols()).alias("col")).distinct(), ["sheet", "col"])
        found.append(lambda: issues(extra, r.id, "HEADER_NEW_COLUMN", "WARN", field=F.col("name")))
        if r.new_columns == "INCLUDE_AS_STRING":
            names = sorted(x["name"] for x in extra.select("name").distinct().collect())  # headers of a region
            specs += [Spec(re.sub(r"\W", "_", n), n) for n in names]
            bound = bind()
        found.append(lambda: issues(heads.where("repeated"), r.id, "HEADER_DUPLICATE", "WARN", field=F.col("name")))
    found += _missing(bound, r, {i: F.col(f"s{i}").isNull() for i in range(len(r.specs)) if i not in titled})
    first, cells = at("line", F.col("left")), F.map_values("line")
    made = F.struct(
        *[at("line", F.col(f"s{i}")).alias(f"c{i}") for i in range(len(specs))],
        F.size(filled_cols()).alias("_filled"), F.exists(cells, lambda c: c["flags"].bitwiseAND(HIDDEN_ROW) != 0).alias("_hidden"),
        F.coalesce(first["flags"].bitwiseAND(STRIKE) != 0, F.lit(False)).alias("_struck"), F.coalesce(first["flags"].bitwiseAND(BOLD) != 0, F.lit(False)).alias("_bold"), F.coalesce(text_of(first), F.lit("")).alias("_lead"), first.alias("_first"),
    )
    # a generator's columns are made once a line, whatever is asked of them later
    wide = cut.view(bound).where(below).select("sheet", "row", *[f"s{i}" for i in range(len(specs))], F.inline(F.array(made))).where("_filled > 0")
    if r.shape == "SUMMARY":
        own = [c for c in wide.columns if not c.startswith("_") and c not in ("sheet", "row")]
        wide = wide.groupBy("sheet").agg(F.min(F.struct("row", *own)).alias("x")).select("sheet", "x.*")
        return _Shaped(wide, specs, found, {i: F.col(f"s{i}").isNotNull() for i in range(len(specs))})
    lead = F.col("_lead")
    if r.shape == "GROUPED_DETAIL":
        if r.subtotal_pattern:
            wide = wide.where(~lead.rlike(rf"\A(?:{r.subtotal_pattern})\z") | (lead == ""))
        alone = (lead != "") & (F.col("_filled") == 1)
        whole = rf"\A(?:{r.group_pattern})\z"
        title = {"FIRST_CELL_ONLY": alone, "REGEX": (lead != "") & lead.rlike(whole), "BOLD": alone & F.col("_bold")}[r.group_by]
        value = F.when(lead.rlike(whole), F.regexp_extract(lead, whole, 1 if re.compile(r.group_pattern).groups else 0)).otherwise(lead) if r.group_pattern else lead
        down = Window.partitionBy("sheet").orderBy("row")
        wide = wide.withColumn("_title", title).withColumn("_group", F.last(F.when(F.col("_title"), F.col("_first").withField("value", value).withField("kind", F.lit("s"))), ignorenulls=True).over(down)).where("not _title")
        wide = wide.withColumns({f"c{i}": F.col("_group") for i in titled})
    if not r.turned:  # rows of the sheet are what is hidden or struck
        if r.hidden == "SKIP":
            wide = wide.where("not _hidden")
        if r.strike == "SKIP":
            wide = wide.where("not _struck")
    if r.comment:
        wide = wide.where(~lead.startswith(r.comment))
    if r.subtotals:
        wide = wide.where(~lead.isin(*r.subtotals))
    if r.hidden != "SKIP" and not r.turned:
        found.append(lambda: issues(wide.where("_hidden"), r.id, "HIDDEN_ROWS", "WARN"))
    return _Shaped(wide, specs, found, {i: F.col(f"s{i}").isNotNull() for i in range(len(specs)) if i not in titled})


def _fixed(rows: DataFrame, names: Mapping[str, Column], r: Region, found: list[Found], keep: tuple[str, ...] = ("sheet", "row")) -> _Shaped:
    """A shape whose fields have fixed names: each spec takes the first that it asks for."""
    picked = {i: next((n for n in names if named(s, n)), None) for i, s in enumerate(r.specs)}
    absent = {i: F.lit(True) for i, n in picked.items() if n is None}
    cells = {f"c{i}": names[n] if n is not None else lone(F.lit(None)) for i, n in picked.items()}
    return _Shaped(rows.select(*keep, *[c.alias(n) for n, c in cells.items()]), r.specs, found + _missing(rows.select("sheet").distinct(), r, absent), {i: F.lit(n is not None) for i, n in picked.items()}, keep)


def _key_values(cut: _Cut | None, r: Region, view: DataFrame | None = None, by: tuple[str, ...] = ("sheet",), keep: tuple[str, ...] = ("sheet", "row")) -> _Shaped:
    """Keys and values: a row for each group of `by` (WIDE), or for each key (LONG)."""
    key = text_of(at("line", F.col("left") + (r.key_col - 1)))
    pairs = (cut.view() if view is None else view).select(*by, "row", "top", key.alias("key"), at("line", F.col("left") + (r.value_col - 1)).alias("cell")).where((F.col("key") != "") & ~F.col("key").startswith("#"))
    pick, place = (F.max_by, F.max) if r.duplicates == "LAST" else (F.min_by, F.min)
    if r.duplicates == "ARRAY":
        texts = F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce(F.col("cell.value"), F.lit("")).alias("v")))), lambda x: x["v"])
        each = pairs.groupBy(*by, "top", "key").agg(lone(F.array_join(texts, "|")).alias("cell"), F.min("row").alias("row"), F.count("*").alias("n"))
    else:
        each = pairs.groupBy(*by, "top", "key").agg(pick("cell", "row").alias("cell"), place("row").alias("row"), F.count("*").alias("n"))
    found = []
    if r.duplicates == "ERROR":
        again = each.where("n > 1").groupBy(F.col("key").alias("field")).agg(F.sum(F.col("n") - 1).alias("n"))
        found.append(lambda: _counted(again, r.id, "KV_DUPLICATE_KEY"))
    if r.long:
        return _fixed(each, {"key": lone(F.col("key")), "value": F.col("cell")}, r, found, keep)
    asked = [matches(F.col("key"), s) for s in r.specs]
    found.append(lambda: issues(each.where(~reduce(lambda x, y: x | y, asked, F.lit(False))), r.id, "HEADER_NEW_COLUMN", "WARN", field=F.col("key")))
    wide = each.groupBy(*by, F.col("top").alias("row_")).agg(
        *[F.min_by("cell", F.when(a, F.col("row"))).alias(f"c{i}") for i, a in enumerate(asked)], *[F.max(a).alias(f"b{i}") for i, a in enumerate(asked)]
    ).withColumnRenamed("row_", "row")
    found += _missing(wide, r, {i: ~F.col(f"b{i}") for i in range(len(asked))})
    return _Shaped(wide, r.specs, found, {i: F.col(f"b{i}") for i in range(len(asked))}, keep)


def _form(cut: _Cut, r: Region) -> _Shaped:
    """A row a sheet, of cells at stated places; a sheet whose region does not reach to one of them has none."""
    high, wide = F.col("bottom") - F.col("top") + 1, F.col("right") - F.col("left") + 1
    beyond = F.array_compact(F.array(*[F.when((high < y) | (wide < x) | F.lit(y < 1 or x < 1), F.lit(n)) for n, (y, x) in r.fields.items()]))
    found = [lambda: issues(cut.rect.select(F.explode(beyond).alias("f")), r.id, "FORM_FIELD_OUT_OF_RANGE", field=F.col("f"))]
    rows = cut.rect.where(F.size(beyond) == 0).join(_places_of(cut.view(), r.fields, ("sheet",)), "sheet", "left").withColumn("row", F.col("top"))
    return _fixed(rows, {n: F.col(f"f_{n}") for n in r.fields}, r, found)


def _places_of(view: DataFrame, fields: Mapping[str, tuple[int, int]], by: tuple[str, ...]) -> DataFrame:
    """by, filled_, f_<name>: the cells at places of each group's rectangle, from 1."""
    each = [F.max(F.when(F.col("row") == F.col("top") + (y - 1), at("line", F.col("left") + (x - 1)))).alias(f"f_{n}") for n, (y, x) in fields.items()]
    return view.groupBy(*by).agg(*each, F.max(F.size(filled_cols()) > 0).alias("filled_"))


def _matrix(cut: _Cut, r: Region) -> _Shaped:
    """A row for each body cell, or for each combination of dimensions where one of them names metrics."""
    down, across = list(r.row_dims) or ["row1"], list(r.col_dims) or ["col1"]
    local = cut.view().select("sheet", (F.col("row") - F.col("top") + 1).alias("row"), "top", F.col("left").alias("_left"), F.explode("line").alias("col", "cell"))
    local = local.select("sheet", "row", (F.col("col") - F.col("_left") + 1).alias("col"), F.col("cell.value").alias("value"), "cell", "top")
    long = sheets.matrix(local, {i + 1: n for i, n in enumerate(across)}, {i + 1: n for i, n in enumerate(down)}, "_value", r.totals, r.drop_empty, r.parsers, ("cell", "top"))
    dims, found = [d for d in (*down, *across) if d != r.metric], []
    names = {d: lone(F.col(d)) for d in dims}
    long = long.withColumn("row", F.col("row") + F.col("top") - 1)
    if not r.metric:
        return _fixed(long, names | {r.value_name: F.col("cell")}, r, found)
    again = sheets.repeated_metrics(long, dims, r.metric).groupBy(F.col(r.metric).alias("field")).agg(F.sum(F.col("n") - 1).alias("n"))
    found.append(lambda: _counted(again, r.id, "MATRIX_DUPLICATE_CELL"))
    fixed = {i: next((d for d in dims if named(s, d)), None) for i, s in enumerate(r.specs)}
    asked, place = {i: matches(F.col(r.metric), s) for i, s in enumerate(r.specs) if fixed[i] is None}, F.struct("row", "col")
    rows = long.groupBy("sheet", *dims).agg(F.min("row").alias("row"), *[F.min_by("cell", F.when(a, place)).alias(f"m{i}") for i, a in asked.items()])
    there = long.groupBy("sheet").agg(*[F.max(F.coalesce(a, F.lit(False))).alias(f"b{i}") for i, a in asked.items()]) if asked else long.select("sheet").distinct()
    rows = rows.join(there, "sheet").withColumns({f"c{i}": F.col(f"m{i}") if fixed[i] is None else names[fixed[i]] for i in fixed})
    found += _missing(there, r, {i: ~F.col(f"b{i}") for i in asked})
    return _Shaped(rows, r.specs, found, {i: F.col(f"b{i}") for i in asked})


def _repeating(cut: _Cut, r: Region) -> _Shaped:
    """A row for each block that is not blank, of stated size, from each hit of an anchor text or in equal steps.

    A line meets the blocks that lie over it where it is: a window over its band has the starts of the rows above, and those that
    reach into a band from above it are few.  Its parts go to the bands in which their blocks begin, which is the only exchange of
    cells.  A sheet whose blocks overlap has an issue and no rows.
    """
    high, wide = r.block
    if r.inner == "FORM" and (bad := sheets.outside(r.fields, high, wide)):
        raise ValueError(f"FORM_FIELD_OUT_OF_RANGE: {', '.join(bad)}")
    steps = _anchored(r) if r.block_anchor else _strided(r)
    starts, clashing = steps(cut.view()), None
    if r.block_anchor:
        # all starts over a line lie within a block's height, so two of them meet if their columns do
        lefts = starts.where(F.size("lefts") > 0).select("sheet", F.explode(F.array(F.array_sort(F.flatten(F.col("over.lefts"))))).alias("all"))
        clashing = lefts.where(F.size(F.filter("all", lambda x, k: F.coalesce(F.get(F.col("all"), k + 1) - x < wide, F.lit(False)))) > 0).select("sheet").distinct()
    else:
        clashing = cut.rect.where((_last_step(r) > 0) & F.lit(r.stride[0] < high and r.stride[1] < wide)).select("sheet")
    found = [lambda: issues(clashing, r.id, "REPEATING_BLOCK_OVERLAP", field=F.col("sheet"))]
    fine = cut.rect.join(clashing, "sheet", "left_anti")
    block = _parts(steps(cut.view(fine.select("sheet"))), wide)
    if not r.skip_empty and not r.block_anchor:
        blank = fine.withColumn("i", F.explode(F.sequence(F.lit(0), _last_step(r)))).select("sheet", (F.col("top") + F.col("i") * r.stride[0]).alias("top"), (F.col("left") + F.col("i") * r.stride[1]).alias("left"))
        block = block.unionByName(blank.select("sheet", F.col("top").alias("row"), "top", "left", F.create_map().cast(f"map<int,{PLACED}>").alias("line")))
    # a join asks this of one of its sides, which would then be another exchange
    block = shared(block.withColumn("band", band(F.col("top"))).where("sheet is not null and band is not null"), "sheet", "band")
    by, keep = ("sheet", "band", "top", "left"), ("sheet", "row", "_block")
    full = F.max(F.size(filled_cols()) > 0)
    each = block.groupBy(*by).agg(full.alias("f")).where("f" if r.skip_empty else "true")
    above = F.sum("n").over(Window.partitionBy("sheet").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    before = each.groupBy("sheet", "band").agg(F.count("*").alias("n")).select("sheet", "band", F.coalesce(above, F.lit(0)).alias("above"))
    ordered = Window.partitionBy("sheet", "band").orderBy("top", "left")

    def numbered(rows: DataFrame, turn: Column) -> DataFrame:
        """_block, the ordinal by top and left: the number of the blocks in bands above and the place in the own band."""
        return rows.withColumn("_turn", turn.over(ordered)).join(before.hint("shuffle_hash"), ["sheet", "band"]).withColumn("_block", (F.col("above") + F.col("_turn")).cast("int"))

    if r.inner == "KEY_VALUE":
        own = block.withColumn("f", full.over(Window.partitionBy(*by))).where("f" if r.skip_empty else "true")
        shaped = _key_values(None, r, numbered(own, F.dense_rank()).withColumn("left_", F.col("left")), ("sheet", "band", "left_", "_block"), keep)
        shaped.found += found
        return shaped
    rows = numbered(_places_of(block, r.fields, by).where("filled_" if r.skip_empty else "true"), F.row_number()).withColumn("row", F.col("top"))
    return _fixed(rows, {n: F.col(f"f_{n}") for n in r.fields}, r, found, keep)


def _anchored(r: Region) -> Callable[[DataFrame], DataFrame]:
    """Lines with `lefts`, the columns in which a block begins in them, and `over`, the blocks that lie over them by the row in which they begin."""
    high, row = r.block[0], F.col("row")
    hit = F.map_filter("line", lambda c, v: F.coalesce(matching(v["value"], r.block_anchor, "REGEX"), F.lit(False)) & (c <= F.col("right")))
    lefts = F.when(row <= F.col("bottom"), F.map_keys(hit)).otherwise(F.array().cast("array<int>"))

    def met(view: DataFrame) -> DataFrame:
        own = view.select("sheet", "band", "row", "line", F.inline(F.array(F.struct(lefts.alias("lefts")))))
        here = F.struct(row.alias("top"), "lefts")
        low = own.where(band(row + (high - 1)) > F.col("band")).where(F.size("lefts") > 0).select("sheet", F.explode(F.sequence(F.col("band") + 1, band(row + (high - 1)))).alias("band"), here.alias("x"))
        both = own.join(low.groupBy("sheet", "band").agg(F.collect_list("x").alias("_above")).hint("shuffle_hash"), ["sheet", "band"], "left")
        near = Window.partitionBy("sheet", "band").orderBy("row").rangeBetween(1 - high, 0)
        both = both.withColumn("_near", F.collect_list(F.when(F.size("lefts") > 0, here)).over(near))
        above = F.filter("_above", lambda x: x["top"] > row - high)
        over = F.when(F.size("_above") > 0, F.concat(above, "_near")).otherwise(F.col("_near"))
        return both.where((F.size("_near") > 0) | (F.size("_above") > 0)).select("sheet", "row", "line", "lefts", F.explode(F.array(over)).alias("over"))

    return met


def _last_step(r: Region) -> Column:
    """The number of the last block of a rectangle, from 0."""
    steps = [F.floor((F.col(b) - F.col(a)) / d) for a, b, d in (("top", "bottom", r.stride[0]), ("left", "right", r.stride[1])) if d]
    return ((F.least(*steps) if len(steps) > 1 else steps[0]) if steps else F.lit(0)).cast("int")


def _strided(r: Region) -> Callable[[DataFrame], DataFrame]:
    """Lines with `over`, the blocks in equal steps that lie over them."""
    (dy, dx), down = r.stride, F.col("row") - F.col("top")
    first, last = F.lit(0), _last_step(r)
    if dy:
        first, last = F.greatest(first, F.ceil((down - r.block[0] + 1) / dy)).cast("int"), F.least(last, F.floor(down / dy)).cast("int")
    each = F.transform(F.sequence(first, last), lambda i: F.struct((F.col("top") + i * dy).alias("top"), F.array(F.col("left") + i * dx).alias("lefts")))
    return lambda view: view.where(first <= last).select("sheet", "row", "line", each.alias("over"))


def _parts(lines: DataFrame, wide: int) -> DataFrame:
    """sheet, row, top, left, line: the cells that a line has in each of the blocks over it; a line of many columns is cut into tiles first."""
    side = max(TILE, wide)
    tile = lambda left: F.floor(left / side).cast("int")
    blocks = F.flatten(F.transform("over", lambda x: F.transform(x["lefts"], lambda c: F.struct(x["top"].alias("top"), c.alias("left")))))
    own = lines.select("sheet", "row", "line", F.explode(F.array(blocks)).alias("blocks"))
    narrow = F.size("line") <= side
    own = own.withColumn("tile", F.explode(F.when(narrow, F.array(F.lit(None).cast("int"))).otherwise(F.array_distinct(F.transform("blocks", lambda b: tile(b["left"]))))))
    low, whole = F.col("tile") * side, F.col("tile").isNull()
    part = F.when(whole, F.col("line")).otherwise(F.map_filter("line", lambda c, _: c.between(low, low + (side + wide - 2))))
    own = own.select("sheet", "row", part.alias("part"), F.explode(F.when(whole, F.col("blocks")).otherwise(F.filter("blocks", lambda b: tile(b["left"]) == F.col("tile")))).alias("b"))
    line = F.map_filter("part", lambda c, _: c.between(F.col("b.left"), F.col("b.left") + (wide - 1)))
    return own.select("sheet", "row", "b.top", "b.left", F.explode(F.array(line)).alias("line")).where(F.size("line") > 0)


SHAPES = {"DETAIL": _detail, "GROUPED_DETAIL": _detail, "SUMMARY": _detail, "KEY_VALUE": _key_values, "FORM": _form, "MATRIX": _matrix, "REPEATING_BLOCK": _repeating}


def _flow(own: DataFrame, placed: DataFrame, i: int, regions: Sequence[Region], base_1904: bool, lineage: bool = False) -> Flow:
    """The rows, failing cells and issues of the region of number i."""
    r = regions[i]
    if problems := spec_problems(r.specs):
        raise ValueError("; ".join(problems))
    kind = "KEY_VALUE" if r.shape == "SUMMARY" and r.layout == "KV" else r.shape
    more = (r.block[0] - 1, r.block[1] - 1) if kind == "REPEATING_BLOCK" else (0, 0)
    shaped = SHAPES[kind](_Cut(own, placed, i, regions, more), r)
    cells = {s.field: F.col(f"c{k}") for k, s in enumerate(shaped.specs)}
    bound = {s.field: shaped.bound[k] for k, s in enumerate(shaped.specs) if k in shaped.bound}
    rows, keep = shaped.rows, shaped.keep
    if lineage:
        each = [F.when(c["r"].isNotNull(), F.struct(F.lit(f).alias("key"), F.array(F.concat("sheet", F.lit("!"), letters(c["c"]), c["r"])).alias("value"))) for f, c in cells.items()]
        rid = F.concat_ws("#", F.concat_ws("!", "sheet", "row"), *[c for c in keep if c == "_block"])
        rows = rows.withColumns({origin.RID: rid, origin.CELLS: F.map_from_entries(F.array_compact(F.array(*each))) if each else F.create_map().cast(origin.TYPE)})
        keep = (*keep, origin.RID, origin.CELLS)
    good, bad = coerce_rows(rows, cells, shaped.specs, keep, bound, base_1904)
    bad = bad.drop(origin.CELLS)

    def failed() -> DataFrame:
        each = bad.groupBy("field", "code").agg(F.count("*").alias("n"))
        return each.select(F.lit(r.id).alias("node"), F.lit("ERROR").alias("severity"), "code", F.lit(None).cast("string").alias("message"), "field", "n")

    return Flow(good, bad, lambda: _all([*shaped.found, failed]))


def region_rows(cells: DataFrame, region: Region, base_1904: bool = False, lineage: bool = False) -> Flow:
    """sheet, row and the specs' fields of a region's rows; reject: the cells that fail; issues by code.

    A required spec without a header is one issue a sheet, and its rows have the default; a row with a failing cell is dropped.
    Shapes that give one row take the region's first row as `row`; blocks have their ordinal in _block.  lineage: see `lineage`.
    """
    own = lines(cells)
    placed = places(own, [region])
    flow = _flow(own, placed, 0, [region], base_1904, lineage)
    return Flow(flow.out, flow.reject, lambda: _all([lambda: place_issues(placed, [region]), lambda: flow.issues]))


def source(cells: DataFrame, regions: Sequence[Region], how: str = "REGEX", what: str | int = ".*", as_column: str | None = "_sheet", base_1904: bool = False, lineage: bool = False) -> dict[str, Flow]:
    """A flow for each region that is not ignored, over all sheets that are picked; the sheet's name is a field, or left out.

    Regions that meet though neither excludes the other have no rows in that sheet.
    """
    own = lines(picked_sheets(cells, how, what))
    placed = places(own, regions)
    bad = {i: reduce(lambda x, y: x | y, [meet(f"p{i}", f"p{j}") for j, o in enumerate(regions) if j != i and clash(r, o)], F.lit(False)) for i, r in enumerate(regions)}
    apart = placed.withColumns({f"p{i}": F.when(~bad[i], F.col(f"p{i}")).cast(RECT) for i in bad})

    def one(i: int, r: Region) -> Flow:
        flow = _flow(own, apart, i, regions, base_1904, lineage)
        rows = flow.out.withColumnRenamed("sheet", as_column) if as_column else flow.out.drop("sheet")
        return Flow(rows, flow.reject, lambda: _all([lambda: place_issues(placed, regions, whole=True).where(F.col("node") == r.id), lambda: flow.issues]))

    return {r.id: one(i, r) for i, r in enumerate(regions) if r.shape != "IGNORE"}


def severities(found: DataFrame) -> DataFrame:
    """severity, n: the issues by how grave they are."""
    return found.groupBy("severity").agg(F.sum("n").alias("n"))


def detect(cells: DataFrame, most: int = 30) -> DataFrame:
    """sheet, top, left, bottom, right, title: blocks between blank rows, each split at its blank columns; a report of `most` a sheet.

    A block's first row that has a single text is its title and no part of it.
    """
    own = filled(cells).select("sheet", "row", "col", "value")
    down = Window.partitionBy("sheet").orderBy("row")
    rows = own.select("sheet", "row").distinct().withColumn("part", F.sum((F.col("row") - F.lag("row", 1, -1).over(down) > 1).cast("int")).over(down))
    inside = own.join(rows, ["sheet", "row"])
    first = Window.partitionBy("sheet", "part")
    inside = inside.withColumn("_first", F.min("row").over(first))
    alone = inside.groupBy("sheet", "part", "_first").agg(F.count(F.when(F.col("row") == F.col("_first"), 1)).alias("n"), F.max(F.when(F.col("row") == F.col("_first"), F.col("value"))).alias("t"), F.max("row").alias("last"))
    titled = alone.select("sheet", "part", F.when((F.col("n") == 1) & (F.col("last") > F.col("_first")), F.col("t")).alias("title"))
    body = inside.join(titled, ["sheet", "part"]).where("title is null or row > _first")
    across = Window.partitionBy("sheet", "part").orderBy("col")
    cols = body.select("sheet", "part", "col").distinct().withColumn("side", F.sum((F.col("col") - F.lag("col", 1, -1).over(across) > 1).cast("int")).over(across))
    found = body.join(cols, ["sheet", "part", "col"]).groupBy("sheet", "part", "side").agg(
        F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.max("title").alias("title")
    )
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("top", "left"))
    return found.withColumn("n", rank).where(F.col("n") <= most).select("sheet", "top", "left", "bottom", "right", "title")


def suggested(cells: DataFrame, found: DataFrame) -> DataFrame:
    """For each block of `detect`: sheet, top, left, locator (ANCHOR if its corner's text is the only one in the sheet, else FIXED), anchor, and shape.

    Two columns of texts and values are KEY_VALUE; a block with a blank corner is a MATRIX; others are DETAIL.
    """
    texts = filled(cells).select("sheet", "row", "col", norm_text(F.col("value")).alias("t"))
    corner = found.join(texts.withColumnsRenamed({"row": "top", "col": "left"}), ["sheet", "top", "left"], "left")
    often = texts.groupBy("sheet", "t").agg(F.count("*").alias("times"))
    both = corner.join(often, ["sheet", "t"], "left")
    shape = F.when(F.col("t").isNull(), "MATRIX").when(F.col("right") - F.col("left") == 1, "KEY_VALUE").otherwise("DETAIL")
    return both.select("sheet", "top", "left", F.when(F.col("times") == 1, "ANCHOR").otherwise("FIXED").alias("locator"), F.when(F.col("times") == 1, F.col("t")).alias("anchor"), shape.alias("shape"))


def typed(cells: DataFrame, share: float = 1.0) -> DataFrame:
    """sheet, col, type: the narrowest type that `share` of a column's texts fit: int, float, date, bool, else string."""
    from ..functions import convert

    own = filled(cells).withColumn("t", norm_text(F.col("value")))
    fits = {"int": convert.to_int, "float": convert.to_double, "date": convert.to_date, "bool": convert.to_bool}
    rates = own.groupBy("sheet", "col").agg(*[F.avg(f(F.col("t"))[0].isNotNull().cast("int")).alias(n) for n, f in fits.items()])
    pick: Column = F.lit("string")
    for n in reversed(fits):
        pick = F.when(F.col(n) >= share, n).otherwise(pick)
    return rates.select("sheet", "col", pick.alias("type"))
