"""Session defaults and durable staging."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "undula", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here is required: every operator also runs on a session it is handed.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_own_roots: dict[str, str] = {}
_shipped: set[str] = set()
_staged: dict[str, list[str]] = {}
_cleared: dict[str, int] = {}


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (once per application), wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='undula-package-')}/undula", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else a folder on the default file system.

    A machine's own temporary folder is used only by a local master, where all tasks run on that machine;
    elsewhere, executors could not read each other's files, so a missing shared folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        local = spark.sparkContext.master.split("[")[0] == "local"
        fs = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        _own_roots[app] = own_root(local, fs, app)
    return _own_roots[app]


def own_root(local: bool, default_fs: str, app: str) -> str:
    """Where an application stages without a configured folder."""
    if not default_fs.startswith("file:"):
        return f"{default_fs.rstrip('/')}/tmp/undula-staging-{app}"
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="undula-staging-")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where a costly result feeds several later branches: the lineage is cut, an executor loss
    costs only a re-read, and later branches still prune columns. ``clear_staged`` deletes what is no
    longer needed.
    """
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def times_cleared(spark: SparkSession) -> int:
    """How often ``clear_staged`` has run in this application: what was staged before is gone."""
    return _cleared.get(spark.sparkContext.applicationId, 0)


def clear_staged(spark: SparkSession) -> int:
    """Delete all tables that ``stage`` has written in this application; tables read from them become unusable."""
    app = spark.sparkContext.applicationId
    _cleared[app] = times_cleared(spark) + 1
    paths = _staged.pop(app, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
