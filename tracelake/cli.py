"""The command line: ``python -m tracelake.cli build ...`` and ``python -m tracelake.cli compare ...``.

Conversion needs an extractor. ``grid`` reads plain sheets; any other comes as
module:object, an object with ``records(kind, text)``.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.operators import store as st
from tracelake.plans import archive as runs
from tracelake.plans import scoring
from tracelake.sinks import documents, workbook
from tracelake.sources import layout as lay
from tracelake.sources.extractors import Extractor, Grid

#: How many problems and mismatches are printed.
PROBLEMS, MISMATCHES = 10, 15


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tracelake", description="Field lineage of an archive of mapping workbooks or of view scripts.")
    modes = top.add_subparsers(dest="mode", required=True)
    build = modes.add_parser("build", help="build a dictionary")
    build.add_argument("--sql", metavar="DIR_OR_FILE", help="view scripts; goes before --archive")
    build.add_argument("--archive", metavar="DIR", help="the archive's folder")
    build.add_argument("--layout", metavar="FILE", help="the archive's layout; archive.json in the archive or the built-in one otherwise")
    build.add_argument("--table", action="append", default=[], metavar="TABLE", help="a table to build, repeatable; all of the last hop otherwise")
    build.add_argument("--out", default="output.json")
    build.add_argument("--xlsx", default="output.xlsx")
    build.add_argument("--report", default="report.json")
    build.add_argument("--cache", default=".cache/records", help="the folder of kept conversions")
    build.add_argument("--extractor", default="grid", help="grid, or module:object")
    score = modes.add_parser("compare", help="score a dictionary against a truth sheet")
    score.add_argument("manual")
    score.add_argument("output")
    score.add_argument("--views", action="store_true")
    score.add_argument("--out", default="compare.json")
    return top.parse_args(argv)


def extractor_of(name: str) -> Extractor:
    if name == "grid":
        return Grid()
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def summary(result: runs.Result) -> dict:
    """The report of a run."""
    listed = [r.asDict(recursive=True) for r in result.reports.select("path", "sheet", "kind", "errors", "metrics", "cached").orderBy("path", "sheet").collect()]  # a row a document
    for r in listed:
        r["metrics"] = r["metrics"] or {}
    coverage = {n: v for n, v in result.coverage.first().asDict().items() if v is not None}
    c = result.chains.first()
    ends = lambda n: {"count": c[f"{n}_count"], "examples": [x for x in (c[f"{n}_examples"] or "").split("; ") if x]}
    report = {"mode": "sql", "files": result.targets} if result.views else {"targets": result.targets}
    report |= {
        "files_read": len(listed), "files_converted": sum(not r["cached"] for r in listed), "sources": listed, "coverage": coverage,
        "chain_diagnostics": {"stages": result.stages, "chains": c.chains, "complete_chains": c.complete_chains, "unmatched_tails": ends("unmatched_tails"), "unmatched_heads": ends("unmatched_heads")},
        "source_errors": [r.problem for r in st.problems(result.reports).orderBy("path", "sheet").collect()],
    }
    if result.views:
        report["views_chained_to_origin"] = result.records.where(F.col("resolved_source").isNotNull()).count()
    return report


def print_summary(report: dict) -> None:
    blocks = {"Coverage": report["coverage"]}
    chains = report["chain_diagnostics"]
    if "mode" in report:
        blocks["View chaining"] = {"resolved_through_another_view": report["views_chained_to_origin"]}
    else:
        blocks["Chains"] = {"complete_chains": f"{chains['complete_chains']}/{chains['chains']}", "unmatched_tails": chains["unmatched_tails"]["count"], "unmatched_heads": chains["unmatched_heads"]["count"]}
    for title, block in blocks.items():
        print(f"\n{title}")
        for name, value in block.items():
            print(f"  {name}: {value}")
    print(f"\nFiles read: {report['files_read']}, of which {report['files_converted']} converted")
    if problems := report["source_errors"]:
        print(f"Problems: {len(problems)}")
        for p in problems[:PROBLEMS]:
            print(f"  {p}")


def build(spark: SparkSession, args: argparse.Namespace) -> int:
    if not args.sql and not args.archive:
        print("give --archive or --sql")
        return 1
    store = st.ExtractionStore(spark, args.cache, extractor_of(args.extractor))
    try:
        if args.sql:
            result = runs.views(spark, args.sql, store)
        else:
            result = runs.archive(spark, args.archive, store, lay.load(spark, args.archive, args.layout), args.table)
    except (lay.LayoutError, runs.RunError, FileNotFoundError, AnalysisException) as e:
        print(e)
        return 1
    report = summary(result)
    print_summary(report)
    documents.write_report(report, args.report)
    n = documents.write_document(result.records, args.out, result.views)
    if result.views:
        workbook.write_views(result.records, args.xlsx)
    else:
        workbook.write_archive(result.records, [r.stage for r in runs.ln.stages_in(result.records).orderBy("place").collect()], args.xlsx)
    print(f"\n{n} records in {args.out}, {args.xlsx} and {args.report}")
    return 0


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    result = (scoring.compare_views if args.views else scoring.compare)(spark, args.manual, args.output)
    print(f"truth rows: {result['manual_rows']}, produced rows: {result['program_rows']}, matched: {result['matched_rows']}")
    print(f"field accuracy: {result['overall_field_accuracy']}")
    for column, share in result["by_column"].items():
        print(f"  {column}: {share}")
    for row in result["rows_only_in_manual"]:
        print(f"  not produced: {row}")
    for m in result["mismatches"][:MISMATCHES]:
        print(f"  {m['row']}, {m['column']}: {m['manual']!r} against {m['program']!r}")
    documents.write_report(result, args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    return (compare if args.mode == "compare" else build)(spark, args)


if __name__ == "__main__":
    sys.exit(main())
