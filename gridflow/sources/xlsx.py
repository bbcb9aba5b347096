"""Workbooks as a DataFrame of cells.

Files are read by Spark as binary rows, from any store that Spark reads.  A first step opens the sheets that are wanted and
cuts each into parts of rows, with the shared strings, merged places and styles that a part needs; the parts are dealt to tasks
and parsed there, so one large workbook is many tasks' work.  Cells: path, sheet, sheet_no, row, col (from 1), value (text), kind (n, s, b, d, e), flags, fmt.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cell flags and error literals.
HIDDEN_ROW, HIDDEN_COL, STRIKE, ERROR, NO_CACHE, MERGED, BOLD = 1, 2, 4, 8, 16, 32, 64
ERRORS = frozenset(("#N/A", "#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#NUM!", "#NULL!", "#GETTING_DATA", "#SPILL!", "#CALC!"))
MAX_UNZIPPED = 512 * 1024 * 1024
CELLS = "path string, sheet string, sheet_no int, row int, col int, value string, kind string, flags int, fmt string"
#: Cell types of the file, and kinds here.
KINDS = {"s": "s", "inlineStr": "s", "str": "s", "b": "b", "e": "e"}
#: Bytes of a part of a sheet.
PART_BYTES = 4_000_000
_ROW, _R = re.compile(rb"<row(?=[\s/>])[^>]*>"), re.compile(rb'\sr="(\d+)"')
#: Whole numbers of cells: those of shared strings are among them.
_WHOLE = re.compile(rb"<v[^>]*>\s*(\d+)\s*</v>")
_MERGE = re.compile(rb'<mergeCell [^>]*ref="([A-Z]+)(\d+):([A-Z]+)(\d+)"')
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def letters_to_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def address(sheet: str, row: int, col: int) -> str:
    letters = ""
    while col:
        col, r = divmod(col - 1, 26)
        letters = chr(65 + r) + letters
    return f"{sheet}!{letters}{row}"


def _children(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    found = root.find(_MAIN + name)
    return [] if found is None else list(found)


def _styles(book: zipfile.ZipFile) -> list[tuple[int, str]]:
    """Flags and number format of each cell style."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    formats = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(_MAIN + "numFmt")}
    fonts = [(BOLD if f.find(_MAIN + "b") is not None else 0) | (STRIKE if f.find(_MAIN + "strike") is not None else 0) for f in _children(root, "fonts")]
    out = []
    for x in _children(root, "cellXfs"):
        number, font = x.get("numFmtId", "0"), int(x.get("fontId", "0"))
        built_in = "date" if number.isdigit() and (14 <= int(number) <= 22 or 45 <= int(number) <= 47) else ""
        out.append((fonts[font] if font < len(fonts) else 0, formats.get(number, built_in)))
    return out


def _is_date(fmt: str) -> bool:
    return fmt == "date" or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.lower())))


def problem(path: str, content: bytes, most: int | None = None) -> str | None:
    """Why a file is not read: its name, its size, a broken container, or too much in it."""
    if not re.search(r"\.xls[xm]$", path):
        return "FILE_TYPE"
    if most is not None and len(content) > most:
        return "FILE_TOO_LARGE"
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        book.getinfo("xl/workbook.xml")
    except (zipfile.BadZipFile, KeyError):
        return "FILE_BROKEN"
    return "FILE_TOO_LARGE" if sum(i.file_size for i in book.infolist()) > MAX_UNZIPPED else None


@dataclass(frozen=True)
class Part:
    """Rows of a sheet as a document of their own, and what they need of the rest of the workbook.

    first: the number of the row before them; strings: those that they name; merges: rectangles (top, left, bottom, right) that
    they meet; hidden: ranges of hidden columns; styles: flags and number format of each.
    """

    sheet: str
    number: int
    first: int
    xml: bytes
    strings: dict[int, str]
    merges: list[tuple[int, int, int, int]]
    hidden: list[tuple[int, int]]
    styles: list[tuple[int, str]]

    def about(self) -> str:
        return json.dumps([self.first, list(self.strings.items()), self.merges, self.hidden, self.styles])

    @staticmethod
    def of(sheet: str, number: int, xml: bytes, about: str) -> Part:
        first, strings, merges, hidden, styles = json.loads(about)
        return Part(sheet, number, first, xml, dict(strings), [tuple(m) for m in merges], [tuple(h) for h in hidden], [tuple(x) for x in styles])


def _strings(book: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if e.tag == _MAIN + "si":
                out.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                e.clear()
    return out


def sheet_files(book: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    """Number, name and file of each sheet."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for number, sheet in enumerate(_children(root, "sheets")):
        target = targets[sheet.get(_REL)].lstrip("/")
        yield number, sheet.get("name", ""), target if target.startswith("xl/") else "xl/" + target


def _number(name: bytes, tag: bytes) -> int:
    found = re.search(rb"\b" + name + rb'="(\d+)"', tag)
    return int(found[1]) if found else 0


def parts_of(path: str, content: bytes, merge_fill: bool = True, wanted: str | None = None, size: int = PART_BYTES) -> Iterator[Part]:
    """The wanted sheets (a whole-name expression; None: all) in parts of about `size` bytes; no other sheet is opened.

    None of a file that `problem` finds fault with.  A sheet whose elements have a prefix is one part.
    """
    if problem(path, content):
        return
    book = zipfile.ZipFile(io.BytesIO(content))
    strings: list[str] | None = None
    styles = _styles(book)
    for number, name, file in sheet_files(book):
        if wanted is not None and not re.fullmatch(wanted, name):
            continue
        strings = _strings(book) if strings is None else strings
        xml = book.read(file)
        tail = _MERGE.findall(xml) if merge_fill else []
        merges = [(int(r1), letters_to_number(c1.decode()), int(r2), letters_to_number(c2.decode())) for c1, r1, c2, r2 in tail]
        head = xml[: xml.find(b"<sheetData")] if b"<sheetData" in xml else b""
        hidden = [(_number(b"min", c), _number(b"max", c)) for c in re.findall(rb"<col [^>]*>", head) if re.search(rb'\bhidden="(?:1|true)"', c)]
        root = re.search(rb"<worksheet\b[^>]*>", xml)
        starts = [m.start() for m in _ROW.finditer(xml)] if root else []
        if not starts:
            yield Part(name, number, 0, xml, dict(enumerate(strings)), merges, hidden, styles)
            continue
        end = xml.find(b"</sheetData>", starts[-1])
        last, a = 0, 0
        while a < len(starts):
            b = a + 1
            while b < len(starts) and starts[b] - starts[a] < size:
                b += 1
            own = xml[starts[a] : starts[b] if b < len(starts) else end]
            before = last
            low = None
            for m in _ROW.finditer(own):
                r = _R.search(m[0])
                last = int(r[1]) if r else last + 1
                low = last if low is None else low
            used = {int(i): strings[int(i)] for i in set(_WHOLE.findall(own)) if int(i) < len(strings)} if b't="s"' in own else {}
            yield Part(name, number, before, root[0] + b"<sheetData>" + own + b"</sheetData></worksheet>", used, [m for m in merges if m[0] <= last and m[2] >= low], hidden, styles)
            a = b


def cells_of(path: str, part: Part) -> Iterator[tuple]:
    """The cells of a part, non-blank or flagged; a merged place is filled by the part that has its corner."""
    by_row: dict[int, list[tuple[int, int, int, int]]] = {}
    corner: dict[tuple[int, int], tuple] = {}
    numbers: dict[str, int] = {}
    last, hidden_cols = part.first, list(part.hidden)
    for m in part.merges:
        for r in range(m[0], m[2] + 1):
            by_row.setdefault(r, []).append(m)
    for _, line in ElementTree.iterparse(io.BytesIO(part.xml)):
        if line.tag == _MAIN + "col" and line.get("hidden") in ("1", "true"):
            hidden_cols.append((int(line.get("min", "0")), int(line.get("max", "0"))))
        if line.tag != _MAIN + "row":
            continue
        hidden_row = HIDDEN_ROW if line.get("hidden") in ("1", "true") else 0
        r = last = int(line.get("r") or last + 1)
        held = by_row.get(r, ())
        c = 0
        for e in line:
            ref = e.get("r")
            letters = ref.rstrip("0123456789") if ref else ""
            c = (numbers.get(letters) or numbers.setdefault(letters, letters_to_number(letters))) if letters else c + 1
            style = int(e.get("s", "0"))
            flags, fmt = part.styles[style] if style < len(part.styles) else (0, "")
            kind, v = e.get("t", "n"), e.find(_MAIN + "v")
            text = v.text if v is not None else None
            if kind == "s" and text is not None:
                text = part.strings.get(int(text))
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in e.iter(_MAIN + "t"))
            kind = KINDS.get(kind) or ("d" if kind == "d" or (text and fmt and _is_date(fmt)) else "n")
            if kind == "e" or text in ERRORS:
                flags |= ERROR
            if text is None and e.find(_MAIN + "f") is not None:
                flags |= NO_CACHE
            flags |= hidden_row
            if hidden_cols and any(a <= c <= b for a, b in hidden_cols):
                flags |= HIDDEN_COL
            cell = (path, part.sheet, part.number, r, c, text, kind, flags, fmt)
            if any((r, c) == (m[0], m[1]) for m in held):
                corner[r, c] = cell
            if (text is not None and text.strip()) or flags & ~(BOLD | HIDDEN_ROW | HIDDEN_COL):
                if not any(m[1] <= c <= m[3] and (r, c) != (m[0], m[1]) for m in held):
                    yield cell
        line.clear()
    for r1, c1, r2, c2 in part.merges:
        if (r1, c1) in corner:
            own = corner[r1, c1]
            yield from ((*own[:3], r, c, *own[5:7], own[7] | MERGED, own[8]) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1) if (r, c) != (r1, c1))


def read_cells(spark: SparkSession, path: str, merge_fill: bool = True, rows_per_batch: int = 20_000, sheets: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Cells of every .xlsx and .xlsm file under a path or glob; sheets: an expression for whole names of those to open."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                for i, x in enumerate(parts_of(p, bytes(content), merge_fill, sheets, part_bytes)):
                    yield pd.DataFrame({"path": [p], "sheet": [x.sheet], "number": [x.number], "part": [i], "xml": [zlib.compress(x.xml, 1)], "about": [x.about()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CELLS.split(", ")]
        for pdf in batches:
            for x in pdf.itertuples():
                held: list[tuple] = []
                for cell in cells_of(x.path, Part.of(x.sheet, x.number, zlib.decompress(x.xml), x.about)):
                    held.append(cell)
                    if len(held) >= rows_per_batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"\.xls[xm]$")).select("path", "content")
    parts = files.mapInPandas(cut, "path string, sheet string, number int, part int, xml binary, about string")
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "part").mapInPandas(run, CELLS)


def upload_report(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, size, sha256 and problem (null: none) of every file under a path: what an upload is let in by, and its address by content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [problem(p, bytes(c), most) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pdf[["path", "length", "sha256"]].rename(columns={"length": "size"}).assign(problem=pd.Series(found, dtype=object))

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(run, "path string, size long, sha256 string, problem string")


def over_cap(cells: DataFrame, cap: int) -> DataFrame:
    """path, sheet, n: sheets with more cells than are allowed."""
    return cells.groupBy("path", "sheet").agg(F.count("*").alias("n")).where(F.col("n") > cap)


def sheet_report(cells: DataFrame) -> DataFrame:
    """path, sheet, max_row, max_col, hidden, uncached and a fingerprint of the first ten rows that have text."""
    flag = lambda f: F.count(F.when(F.col("flags").bitwiseAND(f) != 0, 1))
    size = cells.groupBy("path", "sheet").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), flag(HIDDEN_ROW | HIDDEN_COL).alias("hidden"), flag(NO_CACHE).alias("uncached"))
    rows = cells.where("trim(value) <> ''").groupBy("path", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("own"))
    first = rows.groupBy("path", "sheet").agg(F.slice(F.array_sort(F.collect_list(F.struct("row", "own"))), 1, 10).alias("top"))
    return size.join(first.select("path", "sheet", F.sha2(F.to_json("top"), 256).alias("fingerprint")), ["path", "sheet"], "left")
