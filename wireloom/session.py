"""Session factory and helpers for the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wireloom", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with. On a cluster the caller's own session is used."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set by setCheckpointDir; a temporary one where neither is and the master is local (tests, notebooks).

    On a cluster a folder of one machine would lose the tables of all others, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="wireloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later jobs start from the files, on any executor.

    rows is an upper bound on the rows of a narrow table, where it is known: then about
    100,000 rows go into a file (8 files at least), instead of a file per shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // 100_000)))
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wireloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wireloom_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables written by cut() that no later step reads."""
    for df in frames:
        path = getattr(df, "_wireloom_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors as a Python file, once an application, so that no machine needs it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="wireloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = os.path.join(folder, "wireloom")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", top, os.path.basename(os.path.dirname(os.path.abspath(__file__)))))
    _SHIPPED.add(app)
