"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on when they start a session of their own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[*]", app: str = "loomtrace", **conf: str) -> SparkSession:
    """A session with the settings above; conf overrides them (underscores stand for dots)."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a session whose tasks all run in this process gets a folder of its
    own where none is named; it goes when the process ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtrace-checkpoint-"))
        _delete_on_exit(spark, str(Path(sc.getCheckpointDir().removeprefix("file:")).parent))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for tables that last as long as the session."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which survives lost executors.

    The result forgets the planner's estimate of df: in iterations that join a table with itself such estimates
    multiply from round to round without bound. Adaptive execution goes by the sizes it meets. A Spark that doesn't
    offer the call for this keeps the estimates and gives the same rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    try:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
    except (AttributeError, TypeError, Py4JError):
        return kept


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomtrace_shipped", False):
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="loomtrace-")) / "loomtrace.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._loomtrace_shipped = True
