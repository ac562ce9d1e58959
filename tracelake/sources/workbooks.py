"""Scans of workbooks and SQL scripts: one row a sheet row, or one row a script.

Workbooks are zip files of XML. They are read as binary files, a file a row, and
taken apart in Arrow batches, so a thousand files are a thousand independent rows.
A file that can't be read gives one row with ``error`` set and stops nothing.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import keys as k
from tracelake.operators import checks
from tracelake.sources import kinds
from tracelake.sources.layout import Layout

ROWS = "path string, digest string, sheet string, sheet_ord int, ord int, line int, cells array<string>, error string"
#: Rows of a sheet that are handed on together.
CHUNK = 5000
#: Numbers of the built-in formats that show a date or a time, and the day that serial numbers count from.
DATES = frozenset([*range(14, 23), *range(45, 48)])
DAY_ZERO = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node) -> str:
    """The text runs of a string item, without phonetic hints."""
    if _local(node.tag) == "t":
        return node.text or ""
    return "".join(_text(x) for x in node if _local(x.tag) in ("t", "r"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _dates(styles: bytes) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    top = ElementTree.fromstring(styles)
    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in top.iter() if _local(x.tag) == "numFmt"}
    shown = {n for n, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\\\.', "", code.lower()))}
    used = next((x for x in top if _local(x.tag) == "cellXfs"), ())
    return {i for i, x in enumerate(used) if int(x.get("numFmtId", 0)) in DATES | shown}


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    parts = {_local(x.tag): x for x in cell}
    if kind == "inlineStr":
        return _text(parts["is"]) if "is" in parts else None
    raw = parts["v"].text if "v" in parts else None
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "n" and int(cell.get("s", -1)) in dates:
        return str(DAY_ZERO + timedelta(milliseconds=round(float(raw) * 86_400_000)))
    return raw


def sheets(content: bytes) -> Iterator[tuple[str, int, Iterator[tuple[int, list[str | None]]]]]:
    """(name, number, rows) of each worksheet, rows as (line, cells); rows without any cell value are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dates = _dates(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
    target = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = [x for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]

    def rows(part: str) -> Iterator[tuple[int, list[str | None]]]:
        line = -1
        for _, row in ElementTree.iterparse(book.open(part)):
            if _local(row.tag) != "row":
                continue
            line = int(row.get("r")) - 1 if row.get("r") else line + 1
            cells: list[str | None] = []
            for x in row:
                at = _column(x.get("r", "")) if x.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(x, shared, dates)
            row.clear()
            if any(c is not None for c in cells):
                yield line, cells

    for i, x in enumerate(listed):
        to = target.get(next((v for a, v in x.attrib.items() if _local(a) == "id"), None))
        if to:
            part = to.lstrip("/") if to.startswith("/") else posixpath.normpath(f"xl/{to}")
            if part in names:
                yield x.get("name"), i, rows(part)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "digest", "sheet", "sheet_ord", "ord", "line", "cells", "error"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            digest = hashlib.sha256(content).hexdigest()
            try:
                for name, i, rows in sheets(bytes(content)):
                    numbered = enumerate(rows)
                    # a sheet without rows is still listed, for the catalog and the input check
                    part = [(path, digest, name, i, o, line, cells, None) for o, (line, cells) in islice(numbered, CHUNK)] or [(path, digest, name, i, None, None, None, None)]
                    while part:
                        yield pd.DataFrame(part, columns=columns)
                        part = [(path, digest, name, i, o, line, cells, None) for o, (line, cells) in islice(numbered, CHUNK)]
            except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                yield pd.DataFrame([(path, digest, None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=columns)


def _files(spark: SparkSession, at: str | list[str], **options) -> DataFrame | None:
    """Files of a folder or glob by Spark's own reader, so in any store; None where nothing is there."""
    try:
        return spark.read.format("binaryFile").options(**options).load(at)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def sheet_rows(spark: SparkSession, paths: str | list[str], glob: str = "*.xlsx") -> DataFrame:
    """(path, digest, sheet, sheet_ord, ord, line, cells, error) of all workbooks under the paths; lock files (``~$``) and paths that are missing are left out.

    ord counts the rows that hold anything, line all rows of the sheet. Files are
    read one at a time and their rows handed on in chunks.
    """
    found = [f for p in ([paths] if isinstance(paths, str) else paths) if (f := _files(spark, p, pathGlobFilter=glob, recursiveFileLookup="true")) is not None]
    if not found:
        return spark.createDataFrame([], ROWS)
    files = found[0]
    for f in found[1:]:
        files = files.unionByName(f)
    return file_rows(files)


def file_rows(files: DataFrame) -> DataFrame:
    """The same of files as they are read: (path, content, ...)."""
    own = files.where(~F.startswith(F.substring_index("path", "/", -1), F.lit("~$")))
    return own.select("path", "content").mapInPandas(_read, ROWS)


def final_workbook(spark: SparkSession, archive: str, layout: Layout) -> str | None:
    """The first workbook by path that the layout's pattern finds in the archive; None without a pattern or a match."""
    files = _files(spark, f"{archive.rstrip('/')}/{layout.final_glob}") if layout.final_glob else None
    return files.agg(F.min("path")).first()[0] if files is not None else None


def tables(rows: DataFrame, layout: Layout) -> DataFrame:
    """(seq, stage_dir, path, stem, table, sheet) for ``lineage.catalog``: each workbook's first sheet that holds a hop, else its own name and first sheet.

    seq goes by hop folder, in the layout's order, and then by path. Unreadable workbooks and folders the layout doesn't name are left out.
    """
    usable = ~k.normalize("sheet").isin(*layout.non_hop_sheets) if layout.non_hop_sheets else F.lit(True)
    each = rows.where("sheet is not null").groupBy("path").agg(F.min_by("sheet", F.when(usable, F.col("sheet_ord"))).alias("own"), F.min_by("sheet", "sheet_ord").alias("front"))
    stem = F.regexp_replace(k.basename("path"), r"\.[^.]*$", "")
    each = each.withColumns({"stage_dir": F.element_at(F.split("path", "/"), -2), "stem": stem, "table": F.coalesce("own", stem), "sheet": F.coalesce("own", "front")})
    order = F.array_position(F.array(*[F.lit(h.dir) for h in layout.hops]), F.col("stage_dir"))
    seq = F.struct(order.alias("hop"), F.col("path")).alias("seq")
    return each.where(order > 0).select(seq, "stage_dir", "path", "stem", "table", "sheet")


def final_sheets(rows: DataFrame) -> DataFrame:
    """(path, sheet_key, sheet, sheet_ord): of sheets with one normalised name in a workbook the last."""
    named = rows.where("sheet is not null").select("path", "sheet", "sheet_ord").distinct().withColumn("sheet_key", k.normalize("sheet"))
    return named.groupBy("path", "sheet_key").agg(F.max_by("sheet", "sheet_ord").alias("sheet"), F.max("sheet_ord").alias("sheet_ord"))


def sheet_text(rows: DataFrame) -> DataFrame:
    """(path, sheet, text): each sheet as CSV, as wide as its widest row; what verbatim values are looked up in."""
    quoted = lambda c: F.when(F.regexp_like(c, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.array_join(F.transform("cells", quoted), ",")
    per = rows.where("ord is not null").groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line"), F.size("cells").alias("n")))).alias("l"))
    widest = F.array_max(F.transform("l", lambda x: x["n"]))
    full = F.transform("l", lambda x: F.concat(x["line"], F.repeat(F.lit(","), widest - x["n"]), F.lit("\n")))
    return per.select("path", "sheet", F.array_join(full, "").alias("text"))


def sql_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, text) of the ``*.sql`` files in a folder, or of one file; FileNotFoundError if there are none."""
    files = _files(spark, path, pathGlobFilter="*.sql")
    if files is None or files.select("path").isEmpty():
        raise FileNotFoundError(f"no .sql files under {path}")
    return script_texts(files)


def script_texts(files: DataFrame) -> DataFrame:
    """(path, digest, text) of binary files; bytes that are no UTF-8 are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "digest": [hashlib.sha256(c).hexdigest() for c in batch["content"]], "text": [bytes(c).decode("utf-8", "ignore") for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(read, "path string, digest string, text string")


def inputs(rows: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """What a store converts, of sheets: (path, sheet, kind, digest, text, expected, problem). texts: ``sheet_text`` of the rows."""
    own = rows.where("sheet is not null").groupBy("path", "sheet").agg(F.min("digest").alias("digest"), F.count("ord").alias("n"), F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("widest"))
    counted = checks.expected_rows(rows, kinds.anchors(kind))
    out = own.join(texts, ["path", "sheet"], "left").join(counted, ["path", "sheet"], "left")
    return out.select("path", "sheet", F.lit(kind).alias("kind"), "digest", F.coalesce("text", F.lit("")).alias("text"), F.col("expected").cast("long").alias("expected"), checks.input_errors(F.col("n"), F.col("widest")).alias("problem"))


def sql_inputs(scripts: DataFrame, kind: str = "view_sql") -> DataFrame:
    """The same of scripts (path, digest, text): the sheet is null, and what is expected are the columns that the view declares."""
    declared = F.size(k.view_columns("text"))
    return scripts.select("path", F.lit(None).cast("string").alias("sheet"), F.lit(kind).alias("kind"), "digest", "text", F.when(declared > 0, declared).cast("long").alias("expected"), checks.sql_input_error("text").alias("problem"))


def inputs_of(kind: str, source: DataFrame) -> DataFrame:
    """Inputs of a kind by its reader: sheet rows for sheets, scripts for texts."""
    return inputs(source, sheet_text(source), kind) if kinds.get(kind).reader == kinds.EXCEL else sql_inputs(source, kind)
