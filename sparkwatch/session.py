"""Session helpers: building a session for tests/bench, and the shared scratch folder.

On a cluster the scratch folder is the one named by ``spark.checkpoint.dir`` (a shared
filesystem / object store). Only when that setting is absent (local tests, the bench)
do we create one ourselves. Reliable checkpoints are removed when Spark is told to clean them
(``spark.cleaner.referenceTracking.cleanCheckpoints``, set by ``build_session``) and the
frame that reads them is gone.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Largest method, in bytes, that whole-stage code may hold. The JVM compiles none above 8,000: beyond it the
#: generated code of a table of 30 computed columns is interpreted, where operators one by one are compiled.
METHOD_CONF, METHOD_DEFAULT, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "sparkwatch") -> SparkSession:
    """Session for tests and the bench. AQE on, UI off, UTC, Arrow on."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_methods(spark)
    return spark


def bound_methods(spark: SparkSession) -> None:
    """Keeps generated code to methods that the JVM compiles, unless the session has its own limit."""
    if spark.conf.get(METHOD_CONF, METHOD_DEFAULT) == METHOD_DEFAULT:
        spark.conf.set(METHOD_CONF, METHOD_LIMIT)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only in local mode and if none
    is set. On a cluster the setting is needed: executors don't share a local folder."""
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sparkwatch-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf_dir)
    # RDD-level checkpoint dir (used by DataFrame.checkpoint()) follows the same setting.
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}sparkwatch/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkwatch`` importable in executors' Python workers (pandas UDFs, stateful
    streams): zip the package once per SparkContext and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # prefer the shared scratch folder when it is a filesystem path; Spark ships the file anyway
    base = ensure_checkpoint_dir(spark)
    local = base.startswith("/") or base.startswith("file:")
    if local:
        out_dir = os.path.join(base.replace("file://", "").replace("file:", ""), "sparkwatch-pkg", uuid.uuid4().hex[:8])
        os.makedirs(out_dir, exist_ok=True)
    else:
        out_dir = tempfile.mkdtemp(prefix="sparkwatch-pkg-")
    zpath = os.path.join(out_dir, "sparkwatch.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
