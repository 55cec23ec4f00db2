"""Tables written between the steps of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package, where neither their path nor (on one machine) the folder they start in has
    it: it is added to the application as a zip, once."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    root = package.parent
    found = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.startswith("local[") or context.master == "local":
        found.add(Path.cwd().resolve())
    if root in found or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, a local one is set on a local master alone; on a
    cluster this raises, as each executor would write to a disk of its own."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: its lineage ends there, and a
    lost executor costs a re-read, not a re-run. The table stays until ``discard`` or ``sweep``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialize`` that nothing reads any more."""
    path = getattr(df, "_table", None)
    if path in _written.get(df.sparkSession.sparkContext.applicationId, []):
        _written[df.sparkSession.sparkContext.applicationId].remove(path)
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete every table that this application has written between steps; returns how many. For the end of a job, when the
    results that were read from them are stored."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
