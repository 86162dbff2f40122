"""What the corpus operators share: tables in the cluster's shared folder, columns, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders that are marked to go.
_LEAVE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is named, in local mode a fresh one of our own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sievemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A place for a table of this application; the application's folder goes when it ends."""
    folder = f"{shared_dir(spark)}/sievemark/{spark.sparkContext.applicationId}"
    if folder not in _LEAVE:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
        _LEAVE.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives a worker's free memory back, as workers live on through later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Bits of a key filter (16 MB). It stays that size whatever the table: with some hundred million keys it is full, lets everything through,
#: and costs a pass without sparing the shuffle anything; results never depend on it.
FILTER_BITS = 27


def key_filter(df: DataFrame, *cols: str):
    """A broadcast bit table of the keys in df, for ``maybe_in``."""
    import numpy as np

    size = 1 << FILTER_BITS
    spot = F.pmod(F.xxhash64(*cols), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))
    got = df.groupBy(F.floor(spot / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(bits)


def maybe_in(df: DataFrame, shared, *cols: str, found: bool = True) -> DataFrame:
    """Rows of df whose keys may be in the filter (all that are in it); with found=False the others."""
    import numpy as np
    import pyarrow as pa

    def rows(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            kept = batch.filter(pa.array(hit == found))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    marked = df.withColumn("__spot", F.pmod(F.xxhash64(*cols), F.lit(1 << FILTER_BITS)))
    return marked.mapInArrow(rows, df.schema)
