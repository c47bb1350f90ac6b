"""Where intermediate tables go: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    ``spark.checkpoint.dir`` is used as it is set. Only a local master may go without: then a temporary folder is
    made, once per application, and set as the checkpoint folder too. Raises on a cluster without the setting.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return sc.getCheckpointDir() or _OWN[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used yet."""
    shared_dir(spark)
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage; unlike a cache it survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that this package wrote, once what was read from them is written elsewhere."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once per application, so that functions of it run there without installation."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top, packed = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
