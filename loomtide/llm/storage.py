"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only in local mode where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtide-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result depends on files alone, so a lost executor costs a re-read and
    no recomputation, and iterative plans stay short.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtide/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more, and let Spark drop shuffle files that no plan refers to."""
    spark = SparkSession.active()
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
    # Spark's cleaner works when the plans behind the files are collected: here, then, once the bridge's own
    # thread has passed that on (it wakes every second), in the JVM.
    gc.collect()
    time.sleep(1.5)
    jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch in this session, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
