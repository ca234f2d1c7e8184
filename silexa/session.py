"""Sessions with the settings that the library counts on, and the package on the executors' path."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows that one task of an exchange takes, however large the table is.
ROWS_A_TASK = 1 << 19


def get_session(name: str = "silexa", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their path has it already (their working folder or PYTHONPATH)."""
    top = Path(__file__).resolve().parent.parent
    places = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)} | {Path.cwd().resolve()}
    app = spark.sparkContext.applicationId
    if top in places or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="silexa-"), "silexa.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((top / "silexa").rglob("*.py")):
            z.write(f, f.relative_to(top))
    spark.sparkContext.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write: ``spark.checkpoint.dir``; only a local session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="silexa-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, which cuts its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def laid(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as Parquet in a folder of its own below ``folder``. Unlike a checkpoint it keeps no constraints of its plan, which double from round to round of a loop that filters its own result, and it can be dropped."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.silexa_path = path
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of one round in the shared folder."""
    return laid(df, f"{shared_folder(df.sparkSession)}/rounds")


def tasks_for(df: DataFrame) -> int | None:
    """How many tasks hold the rows of ``df`` at ``ROWS_A_TASK`` each; None where the session's own number of partitions is enough. Counts ``df``."""
    n = -(-df.count() // ROWS_A_TASK)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks``, so that what a task sorts or groups does not grow with the table; joins and groups by these keys stay there."""
    return df.repartition(tasks, *keys) if tasks else df


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete what ``stored`` or ``laid`` has written; nothing may read it any more."""
    deleted(df.sparkSession, df.silexa_path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the exchanges that no plan holds any more: it does so when the driver's garbage is collected, which may be long after a loop has filled the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
