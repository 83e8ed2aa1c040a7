"""Files that every executor can read: the folder named by spark.checkpoint.dir.

Operators that need state between jobs (index runs, batches, solved rounds) write it here, never to a
machine-local folder, so a lost executor costs a task and not the state.
"""
import atexit
import io
import json
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, executors of a cluster could not see a folder of ours: that is an
    error; a local master (tests) gets one, which is removed at exit."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder. This process owns what lies there and removes it at exit (release)."""
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(release)
    _made.append(path)
    return path


def release() -> None:
    """Remove every intermediate table, index and file this process has made. Results that still read them are lost."""
    while _made:
        try:
            drop(_made.pop())
        except (OSError, ValueError):  # the storage is gone already
            pass


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, columnar, survives lost executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put_bytes(uri: str, *parts: bytes) -> None:
    """Write a file under a private name, then rename: a retried task replaces equal bytes with equal bytes."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        for part in parts:
            out.write(part)
    fs.move(tmp, path)


def get_bytes(uri: str) -> bytes | None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return f.read()


def put_json(uri: str, value) -> None:
    put_bytes(uri, json.dumps(value).encode())


def get_json(uri: str):
    raw = get_bytes(uri)
    return None if raw is None else json.loads(raw)


def drop(uri: str) -> None:
    """Delete a folder or file, if it is there."""
    fs, path = open_fs(uri)
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(path)
    elif kind == pafs.FileType.File:
        fs.delete_file(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application: their workers need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    uri = f"{scratch(spark, 'package')}/tidemark.zip"
    put_bytes(uri, packed.getvalue())
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidemark/" in folder:
            drop(folder)
