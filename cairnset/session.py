"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "*", app: str = "cairnset", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CAIRNSET_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may leave it unset; then a temporary folder is chosen
    and set, once per application. On a cluster that is an error, as each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not folder and known.isEmpty():
        if not sc.master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {sc.master} share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if known.isEmpty():
        sc.setCheckpointDir(folder)
    return (folder or known.get()).rstrip("/")


_folders: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's own tables below the shared one; it is deleted when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        path = f"{shared_dir(spark)}/cairnset-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        there = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = there.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(there)
        files.deleteOnExit(there)
        _folders[sc.applicationId] = path
    return _folders[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files.

    Used where a frame is read more than once and recomputing it would repeat
    costly work, or where a loop would grow the plan without end. The files
    survive the loss of any executor, are read by column, and tell the planner
    their size.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_noting(df: DataFrame, **noted: Column) -> tuple[DataFrame, dict]:
    """Like ``cut``, with the values of the aggregates ``noted`` over its rows, taken while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, *(column.alias(name) for name, column in noted.items())))
    return table, {name: seen.get[name] for name in noted}


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file whole or not at all, without a Spark job; its folder must not be there yet."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    files, folder = target.getFileSystem(sc._jsc.hadoopConfiguration()), target.getParent()
    made = sc._jvm.org.apache.hadoop.fs.Path(folder.getParent(), f"_{uuid.uuid4().hex}")
    out = files.create(sc._jvm.org.apache.hadoop.fs.Path(made, target.getName()))
    out.write(data)
    out.close()
    if files.exists(folder) or not files.rename(made, folder):
        files.delete(made, True)
        raise FileExistsError(f"{folder} is there already")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that an operator keeps."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, reading no more than one beyond."""
    return df.limit(rows + 1).count() <= rows
