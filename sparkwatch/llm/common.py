"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, unless the session sets another number than Spark's default: texts
#: are long, and a batch exists several times over in the JVM and the Python worker.
BATCH_CONF, DEFAULT_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
#: Bytes of a batch, in the same way: a thousand long texts would be some hundred megabytes.
BYTES_CONF, DEFAULT_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Shared scratch folder, the package on the executors, and small Arrow batches; every
    operator calls it first."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for conf, default, value in ((BATCH_CONF, DEFAULT_BATCH, BATCH_ROWS), (BYTES_CONF, DEFAULT_BYTES, BATCH_BYTES)):
        if spark.conf.get(conf, None) == default:
            spark.conf.set(conf, value)
    return spark


#: Session setting that names the key of pseudonyms, and the key of queries where it is unset: known
#: to everyone, so that results can be compared, and of no use for real data.
KEY_CONF, OPEN_KEY = "spark.sparkwatch.pseudonymKey", "known to everyone"


def pseudonym_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_CONF, OPEN_KEY).encode()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back: lineage is cut,
    and a lost executor costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(stored: DataFrame) -> None:
    """Removes what ``materialize`` has written, once all that was made from it is stored itself."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(rows: int, per_task: int, least: int = 1) -> int:
    return max(least, -(-int(rows) // int(per_task)))


def release_memory() -> None:
    """Hands freed memory of a Python worker back to the system: workers live on between stages,
    and what they keep adds up beside the JVM's heap."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing depends on it
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, rows: int = 1_000):
    """A batch in slices of few rows, so that few texts are Python objects at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty, so that Python workers skip decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64 (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
