"""Session helpers shared by the library, the benchmark and the tests."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """A local session with the settings the queries are tested with."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("memloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.addPyFile(_package())
    return spark


def _package() -> str:
    """The package as an archive, so that Python workers find it wherever the program was started."""
    here = Path(__file__).resolve().parent
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-memloom-')}/memloom", "zip", here.parent, here.name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what the context was given.

    Where neither is set, a local folder serves a local master (tests); a cluster is refused,
    as its hosts could not read each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        named = tempfile.mkdtemp(prefix="spark-memloom-")
        sc.setCheckpointDir(named)
    return named


#: The folder of this program's tables within the shared one.
RUN = uuid.uuid4().hex


def run_dir(spark: SparkSession) -> str:
    """Where this program writes its tables."""
    return f"{shared_dir(spark)}/memloom/{RUN}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this program has written; DataFrames that read them can't run any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Written files outlive lost executors, and the read knows its true size, so
    adaptive execution can pick a broadcast only where the rows are really few. The table
    stays until ``release``.
    """
    return Scratch(df.sparkSession).write(df, "table")


class Scratch:
    """Named tables that a job writes to the shared folder and drops when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.at = spark, f"{run_dir(spark)}/{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table. An older table of that name goes once the new one is there."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        old, self.at[name] = self.at.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> None:
        """Append ``df`` to the table of that name, which need not be there yet."""
        self.at.setdefault(name, f"{self.root}/{name}-{uuid.uuid4().hex[:8]}")
        df.write.mode("append").parquet(self.at[name])

    def read(self, name: str, schema: str) -> DataFrame:
        """A table made by ``add``; without rows if nothing was added."""
        return self.spark.read.schema(schema).parquet(self.at[name]) if name in self.at else self.spark.createDataFrame([], schema)

    def drop(self, *names: str) -> None:
        """Delete these tables; no DataFrame that still is to run may read them."""
        for name in names:
            self._delete(self.at.pop(name))

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
