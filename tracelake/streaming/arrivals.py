"""Scripts and workbooks that arrive in a folder, converted into a store batch by batch.

A run over a store that has seen its documents converts nothing, so a stream keeps the
expensive step out of the runs. The stream's checkpoint says which files were seen, and
the store which contents: a batch that is tried again converts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.store import ExtractionStore
from tracelake.sources import kinds
from tracelake.sources import workbooks as wb

_FILES = "path string, modificationTime timestamp, length long, content binary"


def convert_arrivals(spark: SparkSession, folder: str, kind: str, store: ExtractionStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream over one kind of documents; once: it takes what is there and ends."""
    sheets = kinds.get(kind).reader == kinds.EXCEL
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.xlsx" if sheets else "*.sql").load(folder)

    def take(batch: DataFrame, _: int) -> None:
        store.reports(wb.inputs_of(kind, wb.file_rows(batch) if sheets else wb.script_texts(batch)))

    out = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
