"""Session helpers: the shared folder, tables written to cut lineage, table loading."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one process that is
    driver and executor at once gets a fresh one; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="wordmill-"))
    return _own_dir[0]


def local_path(uri: str) -> str | None:
    """The path of a file: URI that every process of this deployment can open, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def scratch(spark: SparkSession, name: str) -> str:
    """A new location in the shared folder, removed when the session's process ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage in a way
    that outlives lost executors, and lets later scans prune columns and push filters down."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of finished queries now: it does so only when the driver's garbage is
    collected, and until then they fill the disk."""
    for _ in range(2):  # the first frees what the second finds unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


_MOVES = re.compile("Join|Aggregate|Window|Exchange|Repartition|Sort|Limit|InMemory|Stream")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is little more than a scan, else written once: for plans that read it
    again, as sampling the ranges of a sort does."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialise(df, name) if _MOVES.search(plan) or "Generate" in plan else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where it is a scan of fewer splits (a few small
    files): costly work on its rows would leave cores idle. Scans of enough splits stay as they are."""
    plan = df._jdf.queryExecution()
    if df.isStreaming or _MOVES.search(plan.optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:  # the driver serves the archive; adding it takes a copy
        archive = Path(d) / f"{root.name}-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        kept = scratch(spark, "package") + ".zip"
        jvm = spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(kept)
        fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(str(archive)), to)
    spark.sparkContext.addPyFile(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@atexit.register
def _clean() -> None:
    for spark, at in _written:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; the folder's owner cleans up
            pass
