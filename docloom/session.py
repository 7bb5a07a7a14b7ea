"""Session factory and the few session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of this process for local sessions, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="docloom-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, set for the context.

    The setting is read from the session, so on a cluster all executors write to the
    folder its owner chose; where a cluster names none that is an error, as nothing on one
    machine outlives its executor. Only a local session gets a folder of its own.
    """
    local = spark.sparkContext.master.split("[")[0] == "local"
    folder = spark.conf.get("spark.checkpoint.dir", None) or (_own_folder() if local else None)
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that read it several times: written to the shared checkpoint folder, so it outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that are sent to all tasks at most.
MOST_SENT = 500_000


def sent(df: DataFrame) -> DataFrame:
    """``df`` computed once and marked to be sent to all tasks, unless it has more than ``MOST_SENT`` rows."""
    held = cut_lineage(df)
    return F.broadcast(held) if held.count() <= MOST_SENT else held


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of ``df`` per ``key``. Only keys, and rows whose key occurs again, are moved."""
    again = sent(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates([key]))


def of_existing(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is one of ``parents`` (key). Only keys are moved: those that are missing are few."""
    missing = sent(df.select(key).distinct().join(parents.select(key), key, "left_anti"))
    return df.where(F.col(key).isNotNull()).join(missing, key, "left_anti")
