"""The two runs: an archive of workbooks to field lineage, and view scripts to view lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import keys as k
from tracelake.operators import lineage as ln
from tracelake.operators import store as st
from tracelake.sources import layout as lay
from tracelake.sources import workbooks as wb

VIEW_STAGES = ["source", "view"]


class RunError(ValueError):
    """A run that has nothing to build."""


@dataclass(frozen=True)
class Result:
    """records: (rec_id, description, lineage, ...); reports: what was read; coverage, chains: one row each."""

    targets: list[str]
    stages: list[str]
    records: DataFrame
    reports: DataFrame
    coverage: DataFrame
    chains: DataFrame
    views: bool = False


def _measured(targets: list[str], stages: list[str], records: DataFrame, reports: DataFrame, views: bool = False) -> Result:
    return Result(targets, stages, records, reports, ln.coverage(records, stages), ln.diagnostics(records, stages), views)


def _reached(store: st.ExtractionStore, sheets: DataFrame, owners: DataFrame, targets: DataFrame) -> DataFrame:
    """Reports of the target sheets and of every sheet that a chain from them comes to.

    Converting is the expensive step, so sheets are converted frontier by frontier:
    first the targets', then those that own the fields their rows name as sources,
    and so on up, each sheet once, until no field is left.
    """
    sources = lambda rows: rows.select(k.normalize("source_table").alias("table_key"), k.normalize("source_column").alias("column_key")).where("column_key <> ''").distinct()
    place = ["table_key", "path", "sheet"]
    need = owners.join(targets.select("table_key"), "table_key", "left_semi").select(*place)
    reports, done, fields = None, None, None
    for step in range(ln.WALK_STEPS + 1):
        if not need.isEmpty():
            part = store.reports(sheets.join(need, ["path", "sheet"], "left_semi"))
            reports = part if reports is None else reports.unionByName(part)
            done = need if done is None else done.unionByName(need)
        owned = ln.hop_rows(owners, st.rows_of(reports, "hop_spec"))
        here = owned.join(targets.select("table_key"), "table_key", "left_semi") if step == 0 else ln.edges(owned).join(fields, ["table_key", "column_key"], "left_semi")
        fields = store.work(sources(here), "fields")
        if fields.isEmpty():
            break
        need = store.work(owners.join(fields.select("table_key"), "table_key", "left_semi").select(*place).join(done.select("table_key"), "table_key", "left_anti"), "need")
    return reports


def archive(spark: SparkSession, root: str, store: st.ExtractionStore, layout: lay.Layout | None = None, tables: list[str] | None = None) -> Result:
    """Lineage of the named tables, or of all that the last hop makes. RunError if there are none, or not all of them."""
    layout = layout or lay.load(spark, root)
    top, stages = root.rstrip("/"), list(layout.stages)
    rows = wb.sheet_rows(spark, [f"{top}/{h.dir}" for h in layout.hops])
    rows = store.work(rows, "sheets")
    owners = store.work(ln.catalog(wb.tables(rows, layout), layout.hops_frame(spark), stages), "catalog")
    if owners.isEmpty():
        raise RunError(f"no mapping workbooks under {root}; its folders should be {', '.join(h.dir for h in layout.hops)}")
    targets = store.work(ln.wanted(owners, layout.last_dir, tables), "targets")
    names = targets.orderBy("table_key").collect()  # the tables that were asked for, or one folder's
    if unknown := [r.table_key for r in names if not r.known]:
        raise RunError(f"not in the archive: {', '.join(unknown)}")
    sheets = wb.inputs_of("hop_spec", rows)
    reports = _reached(store, sheets, owners, targets)
    owned = ln.hop_rows(owners, st.rows_of(reports, "hop_spec"))
    records = ln.walk(owned.join(targets.select("table_key"), "table_key", "left_semi"), ln.edges(owned))
    path = wb.final_workbook(spark, root, layout)
    if path:
        final = store.work(wb.sheet_rows(spark, path, "*"), "final")
        kept = wb.final_sheets(final).join(ln.final_names(targets, list(layout.prefixes)), F.col("sheet_key") == F.col("table_key"), "left_semi").select("path", "sheet", "sheet_key", "sheet_ord")
        found = store.reports(wb.inputs_of("cloud_sheet", final.join(kept.select("path", "sheet"), ["path", "sheet"], "left_semi")))
        cloud = st.rows_of(found, "cloud_sheet").join(kept, ["path", "sheet"])
        records = ln.with_cloud(records, ln.cloud_index(cloud), layout.final_stage, list(layout.prefixes))
        reports = reports.unionByName(found)
    else:
        records = records.withColumn("description", F.lit(None).cast("string"))
    records = store.work(records.select(F.struct("table_key", "ord").alias("rec_id"), "description", "lineage"), "records")
    return _measured([r.table_key for r in names], stages, records, reports)


def views(spark: SparkSession, path: str, store: st.ExtractionStore) -> Result:
    """Lineage of the views that scripts define, with sources that are views themselves followed to their origin."""
    scripts = store.work(wb.sql_texts(spark, path), "scripts")
    reports = store.reports(wb.inputs_of("view_sql", scripts))
    records = ln.chain_views(ln.view_records(st.rows_of(reports, "view_sql").drop("sheet")))
    records = store.work(records.select(F.struct("path", "ord").alias("rec_id"), F.lit(None).cast("string").alias("description"), "lineage", "resolved_source"), "records")
    files = [r.name for r in scripts.select(k.basename("path").alias("name")).orderBy("path").collect()]  # names of scripts
    return _measured(files, VIEW_STAGES, records, reports, views=True)
