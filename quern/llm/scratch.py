"""Where jobs of this subpackage keep tables that cut lineage.

A cluster names a folder that all executors share in ``spark.checkpoint.dir``.
Only where that setting is missing (tests on one machine) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only where the setting is unset."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quern-shared-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The table survives the loss of any executor, is computed once, and gives the planner true sizes. It goes when the
    driver ends, or by release().
    """
    path = new_path(df.sparkSession, name)
    _kept.append(path)
    at, fs = _on(df.sparkSession, path)
    fs.deleteOnExit(at)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def _on(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def mark() -> int:
    """How many tables have been kept so far, for release()."""
    return len(_kept)


def release(spark: SparkSession, since: int, but: DataFrame | None = None) -> None:
    """Delete the tables kept since mark(), but the one that ``but`` reads."""
    stays = set(but.inputFiles()) if but is not None else set()
    gone, left = _kept[since:], []
    for path in gone:
        if any(path.rsplit("/", 1)[-1] in f for f in stays):
            left.append(path)
            continue
        at, fs = _on(spark, path)
        fs.delete(at, True)
    _kept[since:] = left


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


def stored_bytes(df: DataFrame) -> int:
    """Size of a kept table on disk, asked of the file system the table lies on."""
    jvm = df.sparkSession._jvm
    total = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        total += fs.getFileStatus(path).getLen()
    return total


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    A cluster ships it the usual way (``--py-files``, a venv archive); then this is without effect.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: A side of a join is broadcast only up to so many bytes, counted before.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a kept table, marked for broadcast if its counted rows take ``limit`` bytes at most; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
