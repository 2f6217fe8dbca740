"""Session helpers: table access, the shared scratch folder, and size checks.

Nothing here holds data on the driver.  Intermediate tables go to the folder all executors share
(``spark.checkpoint.dir``); only a local master without that setting may fall back to a temp folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SHARED_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write; also the checkpoint folder."""
    sc = spark.sparkContext
    path = sc.getConf().get(SHARED_SETTING)
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {SHARED_SETTING} to a folder that all executors share")
        path = _local_dirs.get(sc.applicationId)
        if path is None:
            path = _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="chronolith-")
            atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    root = f"{shared_dir(spark).rstrip('/')}/work-{spark.sparkContext.applicationId}"
    if root.startswith(("/", "file:")):
        local = root.removeprefix("file:")
        atexit.register(shutil.rmtree, "/" + local.lstrip("/"), True)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that are made and run inside; as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def publish_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text in one step; false if it is there already, whoever wrote it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final = hadoop.Path(path)
    part = hadoop.Path(final.getParent(), f".{uuid.uuid4().hex}.part")
    stream = part.getFileSystem(conf).create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    kind = getattr(hadoop, "Options$Rename")
    try:
        hadoop.FileContext.getFileContext(final.toUri(), conf).rename(part, final, spark.sparkContext._gateway.new_array(kind, 0))
        return True
    except Py4JJavaError as e:
        part.getFileSystem(conf).delete(part, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session wrote below the shared folder; results that read it must have been written by then."""
    delete(spark, f"{shared_dir(spark).rstrip('/')}/work-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a written table, in folders ``by`` some columns, that survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(app: str = "chronolith", cpus: str | int | None = None, **conf: str) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
