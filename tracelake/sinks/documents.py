"""Dictionaries and reports as JSON, one document or one record a line."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of an entry and of a source, as a dictionary shows them.
_ENTRY = ("stage", "schema", "table", "column", "datatype", "size", "constraint", "doc_link", "offline_path")
_HOP_SOURCE = ("table", "column", "transformation_type", "transformation_logic", "role")
_VIEW_SOURCE = ("schema", "table", "column", "alias", "transformation_type", "transformation_logic", "role")


def record_json(views: bool = False) -> Column:
    """A record as JSON text with its nulls; resolved_source only where there is one."""
    own = _VIEW_SOURCE if views else _HOP_SOURCE
    source = lambda x: F.struct(*[x[c].alias(c) for c in own])
    entry = lambda e: F.struct(*[e[c].alias(c) for c in _ENTRY], F.transform(e["sources"], source).alias("sources"))
    whole = F.struct("description", F.transform("lineage", entry).alias("lineage"))
    keep = {"ignoreNullFields": "false"}
    plain = F.to_json(whole, keep)
    if not views:
        return plain
    more = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"resolved_source":'), F.to_json("resolved_source", keep), F.lit("}"))
    return F.when(F.col("resolved_source").isNotNull(), more).otherwise(plain)


def write_lines(records: DataFrame, path: str, views: bool = False) -> None:
    """Records as lines of JSON, in as many files as there are partitions: for dictionaries of any size."""
    records.select(record_json(views).alias("value")).write.mode("overwrite").text(path)


def write_document(records: DataFrame, path: str, views: bool = False) -> int:
    """Records as one indented JSON array in a local file, in order of rec_id; a partition at a time comes to the driver. Returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in records.orderBy("rec_id").select(record_json(views).alias("j")).toLocalIterator():
            text = json.dumps(json.loads(r.j), indent=2, ensure_ascii=False)
            f.write(("," if n else "") + "\n  " + text.replace("\n", "\n  "))
            n += 1
        f.write("\n]" if n else "]")
    return n


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)
