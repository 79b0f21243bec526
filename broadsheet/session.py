"""Session for local runs, and the shared folder that cuts long lineages."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", name: str = "broadsheet", memory: str = "8g") -> SparkSession:
    """A local[cpus] session for tests and bench; a cluster brings its own."""
    partitions = "8" if cpus == "*" else cpus
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own; on a cluster
    a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _local_dir(spark.sparkContext.applicationId)


@functools.cache
def _local_dir(application: str) -> str:
    # The setting is fixed once a session runs, so the folder is remembered here.
    return tempfile.mkdtemp(prefix="broadsheet-")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, so lineage ends here.

    A lost executor then costs a re-read, and values that depend on the
    physical layout (row numbers) are computed exactly once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
