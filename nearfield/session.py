"""Session helpers: shipping the package to executors, durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # an import from a zip is already shipped
        target = os.path.join(SparkFiles.getRootDirectory(), f"{root.name}-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where none is set and the master is local is a temporary folder made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="nearfield-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as a table of the shared folder and read it back.

    Cuts the lineage: a lost executor costs only its own reads. The table lives
    until it is released or the folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more; what was made of them must have been written."""
    for df in tables:
        if path := _tables.pop(df, None):
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def quoted(name: str) -> str:
    """A column name as an identifier, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def spread(df: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """df in as many partitions as there are cores, if it comes from a few small files that make fewer; larger inputs stay as they are."""
    sc, files = df.sparkSession.sparkContext, df.inputFiles()
    if len(files) >= sc.defaultParallelism:
        return df
    total = 0
    for name in files:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return df.repartition(sc.defaultParallelism) if total < part_bytes * sc.defaultParallelism else df
