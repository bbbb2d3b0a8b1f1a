"""What the operators of this subpackage share: tables, the shared folder, cut lineage, code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only a local session may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh place in the shared folder, as a URI."""
    folder = shared_folder(spark)
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor takes nothing of it along."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once no plan reads them any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


BATCH = 2 << 20  # bytes of an Arrow batch


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' path, once an application; bound what a Python worker is sent at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    to = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(to)


def give_back() -> None:
    """Return what this Python worker has freed to the system; idle workers would keep it through later stages."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def through(batches):
    """batches, and memory given back after the last."""
    try:
        yield from batches
    finally:
        give_back()
