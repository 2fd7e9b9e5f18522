"""Operator 5: token counts.

Arrow batches, balanced by bytes, are split at safe boundaries, and the different parts go through the library's batch
encoder, of which only lengths are kept. One map stage, no shuffle; memory is bounded by the batch and the memo.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced
from .tokens import BatchCounter, default_path


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Null and empty texts have 0 bytes and 0 tokens; null ids stay; repeated rows give repeated results; other columns,
    whatever their names, are not read. Texts of any length are counted whole; special strings in a text count as the
    library takes them by default.
    """
    path = vocabulary or default_path("byte_bpe_50k.json")

    def run(batches):
        counter = BatchCounter(path)
        for batch in balanced(batches, "text", batch_bytes):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            n = np.array(counter.counts(texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
