"""Session helpers shared by every operator: tables, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def get_session(app: str = "quire", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the defaults the tests and the benchmark use."""
    b = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = b.config(map=defaults | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is spark.checkpoint.dir of the session. Only a purely local session, where driver and
    executors are one process, may fall back to a temporary folder; a cluster without the
    setting is an error, since a machine-local folder is lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_quire_work", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark._quire_work = base
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again.

    Cuts the lineage, survives the loss of executors, and keeps column pruning for later reads.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's driver ends, on whatever filesystem it lies."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    made = getattr(spark, "_quire_made", None)
    if made is None:
        made = spark._quire_made = []
        # atexit runs the last registered first, so this comes before the JVM's end
        atexit.register(forget, spark)
    made.append(path)
    return path


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far."""
    made = getattr(spark, "_quire_made", [])
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while made:
            p = jvm.org.apache.hadoop.fs.Path(made.pop())
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  a session that has been stopped can only reach local folders
        while made:
            shutil.rmtree(made.pop().removeprefix("file://"), ignore_errors=True)


def small(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 32 << 20) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows of together `max_bytes`, else unchanged.

    The check reads at most max_rows + 1 rows; their size is that of their JSON. Beyond the bound Spark
    chooses a shuffle join.
    """
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    n, held = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and held <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """The scan `df` over all cores, if its files have fewer parts than there are cores; else as it is, without a shuffle.

    For scans before work in Python, where a small table in one row group would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batches, rows: int = 1000):
    """Batches of at most `rows` rows, so that what a function makes of one stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def text_or(c, default: str = "") -> F.Column:
    """Missing values are the empty string in this data model."""
    return F.coalesce(c if not isinstance(c, str) else F.col(c), F.lit(default))
