"""What every operator needs of the running session: code on the executors and a shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()


def _own_folder() -> str:
    """A temporary folder of the driver that goes when it ends."""
    path = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: Rows of an Arrow batch where the session keeps Spark's default, which suits numbers and not whole texts.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Arrow functions can be imported there; and keep
    Arrow batches of texts small, as both sides of a worker's pipe hold some."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(_own_folder(), "corpusloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, an own one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_corpusloom_dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + _own_folder()
            spark.sparkContext._corpusloom_dir = base
    return base.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has settled; frames that still read them can't be used any more."""
    _delete(spark, _scratch(spark))


def drop(*frames: DataFrame) -> None:
    """Delete the tables of settled frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_corpusloom_path", None):
            _delete(df.sparkSession, path)


def _scratch(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/corpusloom-{app}"
    if app not in _SCRATCH:
        _SCRATCH.add(app)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

        def drop() -> None:
            try:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # the JVM may have gone first; the folder then stays
                pass

        atexit.register(drop)
    return folder


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors, runs the plan once.
    `drop` deletes it; the tables of an application share one folder, which goes when the driver ends in order."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._corpusloom_path = path
    return out


def scratch(spark: SparkSession) -> str:
    """The application's own folder among the shared ones."""
    return _scratch(spark)


def tidy(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage: only then do shuffle files of finished steps leave the executors' disks."""
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
