"""Scores of produced lineage against a truth sheet made by hand."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import keys as k
from tracelake.operators import checks
from tracelake.operators import lineage as ln
from tracelake.sources import workbooks as wb

#: Captions of a truth sheet of views, the columns that are scored, and the line (from 0) of an archive sheet's captions.
VIEW_CAPTIONS = {"source_schema": "Source Schema", "source_table": "Source Table", "source_column": "Source Column", "view_name": "View Name", "view_column": "View Column", "role": "Role", "transformation": "Transformation", "path": "Đường dẫn"}
VIEW_SCORED = ["source_schema", "source_table", "source_column", "role", "transformation", "path"]
CAPTION_LINE = 2
KEY = ["target", "source"]


def offsets(stages: list[str]) -> dict[str, int]:
    """The first column of each stage in a truth sheet."""
    return {s: len(ln.FIELDS) * i for i, s in enumerate(stages)}


def archive_columns(stages: list[str]) -> list[str]:
    return [f"{s}_{f}" for s in stages for f in ln.FIELDS] + ["description", "logic"]


def _field(table: str, column: str) -> F.Column:
    """The key of a field as one string, null where the column is blank."""
    return F.when(k.is_field(column), k.key_of(table, column))


def _keyed(rows: DataFrame, target: tuple[str, str], source: tuple[str, str], order: list) -> DataFrame:
    """Rows with their (target, source) key, the first of each."""
    rows = rows.withColumns({"target": _field(*target), "source": _field(*source)})
    return checks.first_of(rows, KEY, order)


def manual_archive(spark: SparkSession, path: str, stages: list[str], warehouse: str = "dwh", staging: str = "staging") -> DataFrame:
    """(target, source, cells...) of the truth sheet: five columns a stage, then the description and, two on, the logic; rows without a warehouse column are skipped."""
    rows = wb.sheet_rows(spark, path, "*").where((F.col("sheet_ord") == 0) & (F.col("line") > CAPTION_LINE))
    tail = len(ln.FIELDS) * len(stages)
    at = {f"{s}_{f}": o + i for s, o in offsets(stages).items() for i, f in enumerate(ln.FIELDS)} | {"description": tail, "logic": tail + 2}
    cells = rows.select("line", *[k.clean(F.get("cells", F.lit(i))).alias(n) for n, i in at.items()]).where(F.col(f"{warehouse}_column") != "")
    return _keyed(cells, (f"{warehouse}_table", f"{warehouse}_column"), (f"{staging}_table", f"{staging}_column"), ["line"]).drop("line")


def _caption(x: str | None) -> str:
    return unicodedata.normalize("NFC", x or "").strip().lower().lstrip("s")


def manual_views(spark: SparkSession, path: str) -> DataFrame:
    """The same of a truth sheet of views, whose first line has the captions in any order; rows without a view column are skipped."""
    rows = wb.sheet_rows(spark, path, "*").where("sheet_ord = 0 and ord is not null")
    head = rows.orderBy("ord").select("cells").first()
    have = [_caption(c) for c in head.cells] if head else []
    at = {f: have.index(_caption(c)) for f, c in VIEW_CAPTIONS.items() if _caption(c) in have}
    cells = rows.where("ord > 0").select("ord", *[(k.clean(F.get("cells", F.lit(at[f]))) if f in at else F.lit("")).alias(f) for f in VIEW_CAPTIONS]).where("view_column <> ''")
    return _keyed(cells, ("view_name", "view_column"), ("source_table", "source_column"), ["ord"]).drop("ord")


_OUTPUT = f"description string, lineage array<{ln.ENTRY}>, resolved_source struct<schema:string,table:string,column:string,via:array<string>>"


def output(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, description, lineage, resolved_source) of a JSON dictionary: one document, an array of records."""
    rows = spark.read.schema(T.StructType.fromDDL(_OUTPUT)).option("multiLine", "true").json(path)
    none = F.array().cast(f"array<{ln.SOURCE}>")
    whole = F.transform("lineage", lambda e: e.withField("sources", F.coalesce(e["sources"], none)))
    return rows.select(F.monotonically_increasing_id().alias("rec_id"), "description", whole.alias("lineage"), "resolved_source")


def produced_archive(records: DataFrame, stages: list[str], warehouse: str = "dwh", staging: str = "staging") -> DataFrame:
    cells = records.select("rec_id", *ln.flat_row(stages))
    return _keyed(cells, (f"{warehouse}_table", f"{warehouse}_column"), (f"{staging}_table", f"{staging}_column"), ["rec_id"]).drop("rec_id")


def produced_views(records: DataFrame) -> DataFrame:
    """Cells of the view entries and their first source; records without a view entry are skipped."""
    view = F.try_element_at(F.filter("lineage", lambda e: e["stage"] == "view"), F.lit(-1))
    own = F.get(view["sources"], F.lit(0))
    named = {"source_schema": own["schema"], "source_table": own["table"], "source_column": own["column"], "view_name": view["table"], "view_column": view["column"], "role": own["role"], "transformation": own["transformation_logic"], "path": view["offline_path"]}
    cells = records.where(view.isNotNull()).select("rec_id", *[k.clean(c).alias(n) for n, c in named.items()])
    return _keyed(cells, ("view_name", "view_column"), ("source_table", "source_column"), ["rec_id"]).drop("rec_id")


def _shown(key: str) -> F.Column:
    part = lambda f: F.get_json_object(key, f"$.{f}")
    return F.coalesce(k.format_key(part("t"), part("c")), F.lit("(none)"))


def report(manual: DataFrame, produced: DataFrame, columns: list[str], equal, excerpt: int = 60) -> dict:
    """The whole score: counts, ratios by column, the first rows that only the truth has and the first cells that differ."""
    both = checks.matched(manual, produced, KEY).cache()
    counts = both.agg(F.count("m").alias("m"), F.count("p").alias("p"), F.count_if(F.col("m").isNotNull() & F.col("p").isNotNull()).alias("both")).first()
    digits = lambda c: 1 if c == "(all)" else 0
    by = {r["column"]: r for r in checks.score(both, columns, KEY, equal).collect()}  # a row a column
    share = lambda c: f"{by[c].agree}/{by[c].compared} ({by[c].agree / by[c].compared:.{digits(c)}%})"
    arrow = F.concat(_shown("target"), F.lit(" <- "), _shown("source")).alias("row")
    only = [r.row for r in checks.unmatched(both, KEY).select(arrow).collect()]
    differ = [r.asDict() for r in checks.mismatches(both, columns, KEY, equal, shown=excerpt).select(arrow, "column", "manual", "program").collect()]
    both.unpersist()
    return {
        "manual_rows": counts.m, "program_rows": counts.p, "matched_rows": counts.both, "rows_only_in_manual": only, "rows_only_in_program": counts.p - counts.both,
        "overall_field_accuracy": share("(all)") if by.get("(all)") and by["(all)"].compared else "n/a", "by_column": {c: share(c) for c in columns if c in by}, "mismatches": differ,
    }


def compare(spark: SparkSession, manual: str, made: str) -> dict:
    """An archive dictionary against its truth sheet; the stages are those of the dictionary."""
    records = output(spark, made)
    stages = [r.stage for r in ln.stages_in(records).orderBy("place").collect()]  # a row a stage
    return report(manual_archive(spark, manual, stages), produced_archive(records, stages), archive_columns(stages), checks.equal_archive)


def compare_views(spark: SparkSession, manual: str, made: str) -> dict:
    return report(manual_views(spark, manual), produced_views(output(spark, made)), VIEW_SCORED, checks.equal_views, excerpt=70)
