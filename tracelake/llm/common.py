"""Shared plumbing: table access, the shared scratch folder, Arrow batch helpers.

Every operator selects the id and text columns it was told to use before
anything else, so further columns of the input, whatever their names, never
clash with its own. A null text counts as empty unless an operator says
otherwise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. A temporary one is made only on a local master, where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Spark's own setting: a query's shuffle files go when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and lost executors cost nothing.

    What was shuffled to make it goes when the write ends; the files themselves go
    with ``discard`` or, at the latest, when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*frames: DataFrame) -> None:
    """Removes what ``stored`` wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            fs, at = _file(df.sparkSession, path)
            fs.delete(at, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def one_an_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows with unique ids: null ids left out, of rows with one id the smallest text, blank ones last. Texts move only if an id repeats."""
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        blank = ~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
        docs = docs.groupBy("doc_id").agg(F.min(F.struct(blank.alias("blank"), "text")).alias("r")).select("doc_id", "r.text")
    return docs


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, starting at offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def steps(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` text bytes, whole rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
            to = min(batch.num_rows, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def map_steps(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = STEP_BYTES) -> DataFrame:
    """Applies ``work`` to (doc_id, text, ...) in bounded slices."""

    def run(batches):
        for piece in steps(batches, most):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
