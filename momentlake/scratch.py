"""Intermediate tables in the folder that the cluster's machines share: written once, read as often as needed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: By application, the temporary folder of a local session that names no shared one (tests).
_own_roots: dict[str, str] = {}
#: Plan nodes whose work is not to be done once per reader; explode is left out, for its output is larger than what it reads.
_COSTLY = ("Join", "Aggregate", "Window", "Sort", "Distinct", "Deduplicate", "MapIn", "InPandas", "InArrow", "EvalPython", "RebalancePartitions", "RepartitionByExpression")
#: Per open scope, the tables written in it.
_scopes: list[list[tuple[SparkSession, str]]] = []


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder that the cluster names in spark.checkpoint.dir.

    A temporary folder serves only local sessions that set none; elsewhere executors couldn't read it. Tables that no later step
    reads are deleted as soon as they are done with; what a returned DataFrame reads stays until the end of its scope(), clear() or the folder's end.
    """
    sc = spark.sparkContext
    root, app = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"), sc.applicationId
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="momentlake-")
            atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
        root = _own_roots[app]
    return f"{root.rstrip('/')}/{app}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives Spark true sizes."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._momentlake_path = path  # noqa: SLF001
    if _scopes:
        _scopes[-1].append((spark, path))
    return out


@contextmanager
def scope() -> Iterator[None]:
    """What operators write within is deleted at the end: make DataFrames, and write or collect what is wanted of them, inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def _costly(plan) -> bool:
    """Whether a node of a logical plan does costly work."""
    name = plan.nodeName()
    if any(c in name for c in _COSTLY):
        return True
    children = plan.children()
    return any(_costly(children.apply(i)) for i in range(children.size()))


def once(df: DataFrame) -> DataFrame:
    """df itself if it is a scan with projections and filters; else df written, for operators that read it several times."""
    return materialize(df, "once") if not df.isStreaming and _costly(df._jdf.queryExecution().optimizedPlan()) else df  # noqa: SLF001


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)  # noqa: SLF001


def release(df: DataFrame) -> None:
    """Delete a materialized table that no later plan reads."""
    if path := getattr(df, "_momentlake_path", None):
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written here; DataFrames made before can't be read any more."""
    _delete(spark, scratch_root(spark))
