"""Token counts of whole texts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import buffers, map_steps, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has 0 bytes and 0 tokens; an empty table gives an empty
    result; rows with the same id are counted each for itself, a null id stays
    null. Texts of any length are tokenized whole, in slices of whole rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, offs = buffers(batch.column("text"))
        n = bpe.word_bpe(vocabulary).count(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_steps(texts_of(docs, id_col, text_col), work, SCHEMA)
