"""Where tables stand: small ones dealt to all cores, and folders for those that are written on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: bytes for each of the cluster's cores up to which a table in few files is dealt out anew
SPREAD_BYTES = 32 << 20
#: texts that a task's Python holds as objects at a time
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows, at most ``rows`` with about ``most`` bytes in ``column`` (one row at least), so that what
    Python makes of them follows the slice and not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        before = int(ends[start - 1]) if start else 0
        stop = min(max(int(np.searchsorted(ends, before + most, side="right")), start + 1), start + rows, len(batch))
        yield batch.slice(start, stop - start)
        start = stop


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt to all cores if it stands in fewer files than there are and is small.

    A file of one row group is one task's, however many cores wait; a table of many files or much data is left as it is.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    size = 0
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


def few_rows(out: DataFrameWriter) -> DataFrameWriter:
    """For Parquet of rows of megabytes: a row group each, as a task reads a row group's rows at once and a writer looks at its size after 100."""
    return out.options(**{"parquet.block.row.count.limit": "1"})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again, for frames that several plans use."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
