"""Session factory and the two ways of cutting a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Conservative defaults; every one of them can be overridden by the caller's configuration.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; `conf` wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and the master local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        folder = _LOCAL[app]
    return folder.rstrip("/")


_CUTS: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that cut() has written in this process and return how many; results that still read them must have been written before."""
    jvm, n = spark._jvm, len(_CUTS)
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The result no longer depends on the executors that computed it, so a lost executor costs a re-read and no
    recomputation; unlike an RDD checkpoint it is columnar, compressed and prunable. A long job calls release() once its results are written.
    With `by` each value of that column has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}.parquet"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED = "spark.corpusloom.shipped"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(_SHIPPED, None) == app:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="corpusloom-ship-")) / "corpusloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))  # Spark's file server hands it to the executors
    spark.conf.set(_SHIPPED, app)
