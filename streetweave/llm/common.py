"""What the operators of this subpackage share: shared folders, shipping the package, text hygiene."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Rows handed to Python at once. Spark also bounds a batch by bytes, but documents may be long.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and keep Arrow batches small. Cheap when repeated."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, "_streetweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._streetweave_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a local one in local mode; elsewhere that raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_streetweave_shared", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
        sc.setCheckpointDir(root)
        sc._streetweave_shared = root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._streetweave_path = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_streetweave_path", None)
    if path is None:
        return
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        parsed = urlparse(uri)
        if parsed.scheme == "file":
            return fs.LocalFileSystem(), parsed.path
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_shared(uri: str, chunks) -> int:
    """Write byte chunks to a new file of the shared folder, from the driver or a task; returns its size."""
    system, path = _filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    size = 0
    with system.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


class LocalView:
    """A local path to a shared file, for memory-mapping: the file itself, or a copy that is deleted on exit."""

    def __init__(self, uri: str):
        self.uri = uri

    def __enter__(self) -> str:
        system, path = _filesystem(self.uri)
        self.copy = None
        if system.type_name == "local":
            return path
        handle, self.copy = tempfile.mkstemp(prefix="view-")
        with system.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        return self.copy

    def __exit__(self, *exc) -> None:
        if self.copy:
            os.unlink(self.copy)
