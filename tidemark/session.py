"""Session factory used by tests and bench; on a cluster the caller brings a session."""
import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(cores: int | str = "*", app: str = "tidemark") -> SparkSession:
    """A local session whose shared folder is a temporary one, removed at exit; TIDEMARK_SHARED names another."""
    shared = os.environ.get("TIDEMARK_SHARED")
    if not shared:
        shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("TIDEMARK_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
