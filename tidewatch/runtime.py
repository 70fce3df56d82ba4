"""Session helpers: where tables that cut lineage are kept."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder; none if there is no such folder."""
    if not path_exists(spark, folder):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [f.getPath().getName() for f in found]


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local master may fall back to a temporary one."""
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tidewatch-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


_scope = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what this thread materializes inside, at the end; no later step may read it. Shuffle files of tables that are gone
    go too."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            delete_path(spark, path)
        gc.collect()
        spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage, survives lost executors and gives real sizes to the optimizer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that `materialize` wrote. Only for tables that no later step reads, not even after a lost executor."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    root = f"{work_dir(spark)}/tidewatch/"
    for path in paths:
        if root.split(":", 1)[-1].lstrip("/") not in path:
            raise ValueError(f"not a table of this session's work folder: {path}")
        delete_path(spark, path)
