"""Cutting the lineage of iterative jobs by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or ``setCheckpointDir`` names.

    Only a local session without one, as in tests, gets a folder of our own: on a cluster executors would each write to
    their own disk, so there it raises.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="gaugeweave-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs survive lost executors without redoing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later job reads; others are left alone."""
    for table in tables:
        _, path = _paths.pop(id(table), (None, None))
        if path:
            session = table.sparkSession
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
