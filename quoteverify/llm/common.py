"""Helpers that the operators of this package share: work folder, inputs, Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteverify.session import ship, shuffles_dropped, work_folder

#: Text bytes that a Python worker handles at once, and that Arrow passes at once; a longer single text is still taken whole.
SLICE_BYTES, BATCH_BYTES = 4 << 20, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share (``quoteverify.session.work_folder``)."""
    return work_folder(spark)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def drop_table(table: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more."""
    drop_path(table.sparkSession, table.work_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, as rows can be long; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string): only what the operators need, so other columns never clash. A null text is
    empty; rows without a key can't be reported and take no part. Arrow batches of the session are bounded by bytes, as
    texts can be long."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_array(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batches, size: int = SLICE_BYTES, column: str = "text"):
    """Arrow batches cut so that each holds about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        ends = np.frombuffer(text.buffers()[1], dtype=np.int32 if pa.types.is_string(text.type) or pa.types.is_binary(text.type) else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        if ends[-1] - ends[0] <= size:
            yield batch
            continue
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … for lengths[0] places, then the same for the next start."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
