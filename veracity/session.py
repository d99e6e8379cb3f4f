"""SparkSession helpers.

The library never creates a session on its own; callers pass one in.  These
helpers are for scripts and tests that need a local session with settings
suited to the workload (AQE on, skew-join on, UI off).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "veracity", driver_memory: str = "16g") -> SparkSession:
    master = master or os.environ.get("VERACITY_MASTER", "local[*]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    Taken from ``spark.checkpoint.dir`` when the cluster sets it.  Only a local
    session (all tasks on this machine) may do without: it gets a fresh scratch
    folder.  Elsewhere a missing setting is an error, as every executor would
    write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="veracity-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


class Store:
    """The stage tables of one run, each written once under ``path`` (default:
    a new folder in the shared checkpoint folder) and read from there.

    Downstream plans start from a columnar scan instead of running a stage's
    lineage once per consumer, and the rows survive the loss of the executors
    that computed them.  ``delete`` removes the run's tables.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/veracity-run-{uuid.uuid4().hex}"

    def keep(self, name: str, df):
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return _fs(self.spark, f"{self.path}/{name}/_SUCCESS")[0]

    def read(self, name: str):
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete one table of the run."""
        _, fs, path = _fs(self.spark, f"{self.path}/{name}")
        fs.delete(path, True)

    def delete(self) -> None:
        _, fs, path = _fs(self.spark, self.path)
        fs.delete(path, True)


def _fs(spark: SparkSession, uri: str):
    """(exists, file system, path) of a folder or file in any store Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path), fs, path


def files_of(spark: SparkSession, *uris: str) -> tuple:
    """Names, sizes and times of the files under the paths: what identifies their content."""
    out = []
    for uri in uris:
        _, fs, path = _fs(spark, uri)
        found = fs.listStatus(path)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return tuple(sorted(out))


def spread(df, *keys):
    """Deal rows by named keys over the session's shuffle partitions, for work
    per row that is heavy next to moving the row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_SHIPPED: set[int] = set()


def ship_package(spark) -> None:
    """Make ``veracity`` importable in every Python worker (``addPyFile``).

    Batch functions given to ``mapInPandas``/``applyInPandas`` refer to
    helpers of this package; executors import them from the shipped zip, so
    jobs run the same from any working directory and on any cluster.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="veracity-pkg-"), "veracity.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
