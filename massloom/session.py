"""Session helpers: test sessions, tables, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "massloom", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local session that names none gets a new folder; on a cluster that is an error, as
    executors and driver share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="massloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ROOTS: dict[str, list[str]] = {}  # of each application, the folders that it has made


def clear_scratch(spark: SparkSession) -> int:
    """Remove all intermediate tables that this application has made so far; returns how many folders.

    To be called when results that read them have been written or are no longer wanted.
    """
    roots = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(roots)


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep`` writes a DataFrame and reads it back, so that later plans neither recompute it nor
    depend on any executor; ``drop`` removes tables that no result still reads, and
    ``clear_scratch`` all that an application has left.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(conf).delete(path, True)
