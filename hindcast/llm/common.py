"""What the operators of this subpackage share: tables, shared folder, Arrow slicing and row shaping."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: set[str] = set()  # stored tables of this process that have not been dropped yet


def ensure_shared(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names. Only a session in one process may do without, and gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hindcast-checkpoint-"))


@contextmanager
def scan_filters(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the optimizer may put Bloom filters under shuffles of scans from 1 MB on; the session's own setting comes back after."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1MB")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    ensure_shared(spark)
    out = df.checkpoint()
    del df  # its plan holds the shuffles of this step
    release(spark)
    return out


def shared_dir(spark: SparkSession) -> str:
    ensure_shared(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back; the caller drops it by its path."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with scan_filters(df.sparkSession):
        df.write.parquet(path)
    _HELD.add(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps now, not beside those of the next step.

    The gateway tells the JVM only once a second which objects Python has let go, so it is told here; and what
    Spark's own listeners and maps hold of a step goes at the second collection.
    """
    gc.collect()
    gone = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    while gone:
        try:
            client, target = gone.pop()
        except IndexError:  # the gateway's own thread was first
            break
        client.garbage_collect_object(target, False)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables, wherever the shared folder is."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _HELD.discard(path)


def sweep(spark: SparkSession, *keep: str) -> None:
    """Drop what is left of stored tables, once results that were made from them have been written elsewhere."""
    drop(spark, *(_HELD - set(keep)))


def pick(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of docs (with column node) whose node is in a stored table (node, n), n being positive.

    The join is left to the optimizer, which may, in a plan that `stored` writes, put a Bloom filter of the wanted
    nodes, of bounded size, under the shuffle, so that other texts need not move.
    """
    return docs.join(nodes.where("n > 0").select("node"), "node", "left_semi")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of whole rows of about `most` bytes; a longer text is a run of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(lengths):
        return
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, arrow: pa.Schema, most: int = SLICE_BYTES, column: str = "text") -> DataFrame:
    """mapInArrow over byte-bounded slices; `fn` returns the output columns of a slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
