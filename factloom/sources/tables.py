"""Reading tables of a data folder, and scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # already imported from an archive that was shipped
        return
    path = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(path))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (tests) may name none: a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm.get() if jvm.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor never loses them.

    ``cut`` writes a frame and reads it back.  ``drop`` deletes a table nothing reads any more.
    What is left is deleted when the driver process ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/factloom-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be over: the cluster clears its shared folder itself
            pass

    def close(self) -> None:
        self.drop(self.root)
