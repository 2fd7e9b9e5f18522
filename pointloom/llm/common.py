"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder of the session.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a session of one machine may go without: a temporary
    folder is set there. Elsewhere it is an error, as executors don't share local folders.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows from a table written to the session's shared folder: as a checkpoint, but compressed and by column.

    ``codec`` is Parquet's; None takes the session's.
    """
    checkpoint(df.sparkSession.range(0))  # sets the folder where it is unset
    folder = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4()}"
    df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def balanced(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text at most (a longer text stands alone)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        for i in range(batch.num_rows):
            n = len(col[i].as_buffer()) if col[i].is_valid else 0
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def batches_of(rows: Iterator[pa.RecordBatch], batch_bytes: int, piece_bytes: int = 4 << 20) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, pieces) of batches of about ``batch_bytes`` of text; a batch's number is a hash of its place and content."""
    held, size, count, digest = [], 0, 0, None
    for piece in balanced(rows, "text", piece_bytes):
        if digest is None:
            digest = xxhash.xxh64(f"{TaskContext.get().partitionId()}:{count}".encode(), 42)
        held.append(piece)
        for text in piece.column(1):
            size += len(text.as_buffer()) if text.is_valid else 0
            digest.update(text.as_buffer() if text.is_valid else b"\xff")
        if size >= batch_bytes:
            yield digest.intdigest() - (1 << 63), held
            held, size, count, digest = [], 0, count + 1, None
    if held:
        yield digest.intdigest() - (1 << 63), held
