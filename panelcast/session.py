"""Session settings and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def send_code(module: str) -> None:
    """Send the functions of a module along with the tasks that call them, so
    that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


# Made-up folder of a local session without the setting, by application.
_made: dict[str, str] = {}


def local_session(
    cores: str = "8", app: str = "panelcast", memory: str = "8g", **settings: str
) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own.

    ``settings`` are further options, with ``_`` for ``.`` in their names.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is made up only for a local master, where driver and
    executors are the same machine; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="panelcast-")
    return _made[context.applicationId]


def run_dir(spark: SparkSession) -> str:
    """The folder, under the shared one, that holds all scratch tables of this application."""
    return f"{shared_dir(spark)}/panelcast-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's scratch folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the application's scratch tables; for the end of a run, when no frame that reads them is used any
    more. Tells whether there was anything. Results that are to stay belong in paths of the caller's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def materialized(df, name: str):
    """``df`` written once as Parquet in the shared folder and read back.

    For inputs that several jobs read: cuts lineage, survives lost executors,
    and later jobs read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
