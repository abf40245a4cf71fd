"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; only a local session without one uses its warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def release(spark: SparkSession) -> None:
    """Let go of plans that are done: Spark keeps their shuffle and checkpoint files until the driver collects its garbage.

    What the driver's JVM has freed outside its heap goes back to the system too; a few hundred MB
    gather there in a long session.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # a diagnostic command of Linux JVMs from 17.0.9 on
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        named = jvm.java.lang.Class.forName
        kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder and read again.

    A loop over joins needs this and not a checkpoint: a checkpoint keeps the size that Spark has
    estimated, the product of the joined ones, which squares in each round until the driver does little else than
    multiply numbers of millions of digits.
    """
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bytes of a batch of rows that goes to a Python worker, where the session leaves it at Spark's 64 MB:
#: a batch stands in the worker several times over, as Arrow, as Python objects and as results.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to send long rows to Python workers in small batches."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY).rstrip("b") == str(BATCH_DEFAULT):
        conf.set(BATCH_KEY, str(BATCH))
    return df


def text_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; whatever other columns docs has are left behind."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def trim() -> None:
    """Hand freed memory back to the system, for a Python worker outlives its tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(docs: DataFrame, each_batch: Callable[[list, list], dict], schema: str, out: pa.Schema, setup: Callable | None = None) -> DataFrame:
    """Apply each_batch(ids, utf-8 texts[, what setup returned]) to every Arrow batch of a text_frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = () if setup is None else (setup(),)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            columns = each_batch(ids, texts, *extra)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)
            del ids, texts, columns
        del extra
        trim()

    return small_batches(docs).mapInArrow(run, schema)
