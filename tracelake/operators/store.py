"""Conversions kept by content: every document is converted once, whatever it is called and whenever it comes again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import keys as k
from tracelake.operators import checks
from tracelake.sources import kinds
from tracelake.sources.extractors import Extractor, converted

KEPT = "content_key string, kind string, records string, text string, expected long, error string"


class ExtractionStore:
    """A Parquet folder of conversions, one subfolder a run that had anything to convert.

    Inputs (path, sheet, kind, digest, text, expected, problem) are matched by kind,
    digest and sheet. Only what is missing is converted, once per content; failures
    are reported and tried again next time. Verdicts are never kept: they come from
    the kept text and records each time.
    """

    def __init__(self, spark: SparkSession, path: str, extractor: Extractor):
        self.spark, self.path, self.extractor = spark, path.rstrip("/"), extractor

    def work(self, df: DataFrame, what: str) -> DataFrame:
        """``df`` written beside the store and read back: plans stay small over the steps of a run, and nothing is computed twice."""
        path = f"{self.path}-work/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _kept(self, at: str = "*") -> DataFrame:
        try:
            return self.spark.read.schema(KEPT).parquet(f"{self.path}/{at}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], KEPT)

    def reports(self, inputs: DataFrame) -> DataFrame:
        """(path, sheet, kind, records, errors, metrics, cached) of every input; records is null, and metrics too, where there are none."""
        inputs = inputs.withColumn("content_key", k.digest_key("kind", "digest", "sheet"))
        have = self._kept().where("error is null").select("content_key").distinct()
        fresh = checks.misses(inputs.where("problem is null"), have).dropDuplicates(["content_key"]).select("content_key", "kind", "text", "expected")
        made = fresh.join(converted(fresh, self.extractor), "content_key").select("content_key", "kind", "records", "text", "expected", "error")
        run = uuid.uuid4().hex
        made.write.parquet(f"{self.path}/{run}")
        kept = checks.first_of(self._kept().where("error is null"), ["content_key"], ["records"]).select("content_key", F.col("records").alias("kept"), F.col("text").alias("read"), F.col("expected").alias("counted"))
        now = self._kept(run).select("content_key", "error", F.lit(True).alias("made"))
        rows = inputs.join(kept, "content_key", "left").join(now, "content_key", "left")
        rows = rows.select("path", "sheet", "kind", F.when(F.col("problem").isNull(), F.col("kept")).alias("records"), F.coalesce("read", "text").alias("text"), F.coalesce("counted", "expected").alias("expected"), F.coalesce("problem", "error").alias("_why"), (F.col("made").isNull() & F.col("problem").isNull()).alias("cached"))
        out = checks.validated(rows)
        failed = F.col("_why").isNotNull()
        out = out.select("path", "sheet", "kind", "records", F.when(failed, F.array("_why")).otherwise(F.col("errors")).alias("errors"), F.when(~failed, F.col("metrics")).alias("metrics"), "cached")
        return self.work(out, "reports")


def rows_of(reports: DataFrame, kind: str) -> DataFrame:
    """(path, sheet, ord, fields...) of the records of a kind; records that are no objects are left out, as their report says."""
    declared = kinds.get(kind)
    each = reports.where(F.col("kind") == kind).select("path", "sheet", F.posexplode(F.from_json("records", "array<string>")).alias("ord", "raw"))
    return each.where(F.json_object_keys("raw").isNotNull()).select("path", "sheet", "ord", F.from_json("raw", declared.schema).alias("r")).select("path", "sheet", "ord", "r.*")


def problems(reports: DataFrame) -> DataFrame:
    """(path, sheet, problem): every error, headed by its file and sheet."""
    sheet = F.when(F.col("sheet").isNotNull(), F.concat(F.lit(" ["), "sheet", F.lit("]"))).otherwise(F.lit(""))
    return reports.select("path", "sheet", F.explode("errors").alias("e")).select("path", "sheet", F.concat(k.basename("path"), sheet, F.lit(": "), "e").alias("problem"))
