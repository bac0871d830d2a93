"""Session helpers shared by the bench, the tests and the operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, memory: str = "8g", app: str = "codeweave") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's tables below ``spark.checkpoint.dir``, which all executors share; it is deleted at the end.

    A folder of the machine is taken only where the setting is missing and the master is local; a cluster without it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), f"codeweave-checkpoints-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    folder = f"{path.rstrip('/')}/codeweave-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


_folders: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever it lies; at the end of the program the session may be gone, and the folder is then left."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration() if spark._jsc else spark._jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    except Exception:  # noqa: BLE001 - whatever py4j raises once its process has gone
        pass


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None, bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    bucket_by: a column that later joins go by; these don't shuffle the table again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"codeweave_{uuid.uuid4().hex}"
        df.repartition(n, bucket_by).write.format("parquet").bucketBy(n, bucket_by).option("path", path).saveAsTable(table)
        stored = spark.table(table)
        stored._stored_in, stored._stored_as = path, table
        return stored
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_in = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing that is still to run reads it; other DataFrames are left alone."""
    path, table = getattr(stored, "_stored_in", None), getattr(stored, "_stored_as", None)
    if table:
        stored.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        _delete(stored.sparkSession, path)
