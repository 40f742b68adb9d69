"""Where a run keeps what must outlive an executor.

Intermediate tables are written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``.  That cuts lineage and lets any executor read
a table after the one that wrote it is lost.  Only a local-mode session without
the setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_STORED: dict[int, tuple[weakref.ref, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of this application's own folder in the shared store (made on demand, removed at exit)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _ROOTS:
        return _ROOTS[app]
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="featurescope-")
        sc.setCheckpointDir(base)
    elif "://" not in base and not base.startswith("file:"):
        base = _qualified(spark, base)
    root = f"{base.rstrip('/')}/featurescope-{app}-{uuid.uuid4().hex[:8]}"
    _ROOTS[app] = root
    atexit.register(_remove, spark, root)
    return root


def _qualified(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(uri)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; a leftover folder is harmless
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared store; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark deletes the shuffle files of a finished statement where this is set.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared store and read it back: lineage ends here, and the shuffle files that led here go."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out), path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and nothing reads any more."""
    for df in frames:
        ref, path = _STORED.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            _remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
