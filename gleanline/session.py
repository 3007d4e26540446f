"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library relies on. A cluster sets its own sizes (executors, shuffle partitions,
# broadcast threshold); nothing below depends on the number of cores.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "gleanline", cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder and forget how it was computed.

    Iterative jobs call this once per round. The folder comes from `spark.checkpoint.dir`, which a
    cluster points at shared storage, so a lost executor only costs the current round. A temporary
    folder is used only when the session names none and runs in local mode.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get(
            "spark.checkpoint.dir", None
        )
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: like `cut_lineage`, and the planner knows its size.

    For tables that are small and meet large ones: their join then needs no shuffle of the large side.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evaluate_once(df: DataFrame) -> DataFrame:
    """Keep Catalyst from copying the projection of `df` into the filters above it.

    A filter on a derived column is normally rewritten in terms of the base columns. For columns
    built from long rule chains that repeats the whole chain once per reference. Rows that come out
    of a generator are not seen through, so each expression runs once per row, in the same stage.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def shared_folder(spark) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
