"""Session helpers: building a local session and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "plumbline") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_sent: set[str] = set()


def send_package(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once an application, unless PYTHONPATH has it for driver and executors alike."""
    home = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _sent or str(home.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return spark
    archive = f"{tempfile.mkdtemp(prefix='plumbline-package-')}/plumbline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; sets a folder of its own only for a local master without that setting."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises ``df`` once in the shared checkpoint folder; lost executors do not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Materialises ``df`` as Parquet in the shared checkpoint folder, for loops: a checkpoint keeps the size that its plan
    was estimated at, and joins of such rounds square it each time, to a number of megabytes on the driver after some
    twenty; files have the size they have."""
    ensure_checkpoint_dir(df.sparkSession)
    at = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's paths reach: nothing may read it any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
