"""Session settings and shared-folder helpers used across the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* under *sf_dir*, by whatever path Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one set here if all of Spark is on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/lexforge-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Written tables that cut lineage: a lost executor re-reads files instead of recomputing the job."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexforge-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        if len(self.paths) == 1:  # results may read these files until the application ends
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        return self.spark.read.parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table that :meth:`cut` returned and nothing reads any more."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; their Python workers import it from there."""
    context = spark.sparkContext
    if getattr(context, "_lexforge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexforge-")  # executors fetch from the driver until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "lexforge_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._lexforge_shipped = True
