"""Helpers shared by the training-data operators: the shared folder, tables written to it, and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where unset, as in tests) one made here, on a local
    master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tickforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables and folders that results may still be read from.
_KEPT: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder and not discarded yet, once its results have been read."""
    discard(spark, *_KEPT)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.add(path)
    return path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for p in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _KEPT.discard(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def rows_of(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of at most most_rows rows and about most_bytes of text (a longer single text is alone)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(col).to_numpy(zero_copy_only=False)
        lo, total = 0, 0
        for i, n in enumerate(sizes):
            n = 0 if n != n else int(n)
            if i > lo and (total + n > most_bytes or i - lo >= most_rows):
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += n
        if lo < batch.num_rows:
            yield batch.slice(lo)


#: Rows of an Arrow batch: texts come by thousands, and batches of more rows only cost memory on both sides.
BATCH_ROWS = 2048


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends at most BATCH_ROWS rows at once to Python from now on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def tidy() -> None:
    """At the end of a task: hand freed memory back, since the worker lives on between tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(col: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, null where null."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def squeeze(x: bytes) -> bytes:
    """Compressed bytes, with their own length before."""
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unsqueeze(x: bytes) -> bytes:
    n = int.from_bytes(x[:8], "little")
    return pa.decompress(x[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more. References that Python gives up reach the JVM
    with its next call, so the second round is the one that counts."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", most_bytes: int = 8 << 20, most_rows: int = 4096, last: Callable[[], None] | None = None) -> DataFrame:
    """fn over bounded slices of df's Arrow batches, and last() at the end of each task."""

    def run(batches):
        for b in rows_of(batches, text, most_bytes, most_rows):
            yield fn(b)
        if last:
            last()
        tidy()

    return small_batches(df).mapInArrow(run, schema)
