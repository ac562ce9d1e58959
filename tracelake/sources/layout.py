"""Archive layout: stages, hop folders and the final-stage workbook, checked before anything is read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class LayoutError(ValueError):
    """A layout that describes no pipeline."""


@dataclass(frozen=True)
class Hop:
    dir: str
    from_stage: str
    to_stage: str


@dataclass(frozen=True)
class Layout:
    stages: tuple[str, ...]
    hops: tuple[Hop, ...]
    final_glob: str | None = None
    final_stage: str = "cloud"
    prefixes: tuple[str, ...] = ()
    non_hop_sheets: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if not self.stages or not self.hops:
            raise LayoutError("a layout needs stages and hops")
        for h in self.hops:
            if not h.dir:
                raise LayoutError(f"{h.from_stage} to {h.to_stage}: no folder")
            if unknown := {h.from_stage, h.to_stage} - set(self.stages):
                raise LayoutError(f"{h.dir}: no such stages: {sorted(map(str, unknown))}")

    @property
    def last_dir(self) -> str:
        """The folder whose tables a run builds unless told otherwise."""
        return self.hops[-1].dir

    def hops_frame(self, spark: SparkSession) -> DataFrame:
        """(hop_ord, dir, from_stage, to_stage) for ``lineage.catalog``."""
        rows = [(i, h.dir, h.from_stage, h.to_stage) for i, h in enumerate(self.hops)]
        return spark.createDataFrame(rows, "hop_ord int, dir string, from_stage string, to_stage string")


#: The archive that a run expects when no layout is given.
DEFAULT = Layout(
    stages=("source", "staging", "dwh", "cloud"),
    hops=(Hop("SRC_STGDIH", "source", "staging"), Hop("STGDIH_DWHDIH", "staging", "dwh")),
    final_glob="*Mapping*CLOUD*.xlsx",
    prefixes=("DWH_",),
    non_hop_sheets=frozenset({"DDL"}),
)


def parse(text: str) -> Layout:
    """A layout from its JSON text; LayoutError if it isn't one."""
    try:
        raw = json.loads(text)
        last = raw.get("cloud") or {}
        out = Layout(
            stages=tuple(raw.get("stages") or ()),
            hops=tuple(Hop(h.get("dir"), h.get("from"), h.get("to")) for h in raw.get("hops") or ()),
            final_glob=last.get("glob"),
            final_stage=last.get("stage", "cloud"),
            prefixes=tuple(last.get("table_prefixes") or ()),
            non_hop_sheets=frozenset(x.strip().upper() for x in raw.get("non_hop_sheets") or ()),
        )
    except (AttributeError, json.JSONDecodeError) as e:
        raise LayoutError(str(e)) from e
    if last.get("stage") and out.final_stage not in out.stages:
        raise LayoutError(f"the final stage {out.final_stage} is not among the stages")
    return out


def load(spark: SparkSession, archive: str, path: str | None = None) -> Layout:
    """The layout at ``path``, else archive.json in the archive, else the default; read by Spark, so any store will do."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path or f"{archive.rstrip('/')}/archive.json", wholetext=True).first()
    except AnalysisException:
        if path:
            raise
        return DEFAULT
    return parse(text[0] if text else "")
