"""Helpers the corpus operators share: private column names, row keys, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import veilwatch

_SHIPPED: set[str] = set()
#: The input row as one column, so that no extra input column clashes with an operator's own names.
ROW = "__row"
#: Spark's setting that deletes a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, gets a folder of its own when
    the setting is missing; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship_code(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from any working directory.

    They find it by themselves when its folder is in PYTHONPATH or is the working directory.  On a cluster
    the package is submitted with the job (``--py-files``).
    """
    root = Path(veilwatch.__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    app, local = sc.applicationId, sc.master.split("[")[0] == "local"
    if not local or not root.is_dir() or root in [*known, Path.cwd()] or app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="code-")) / "veilwatch.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "veilwatch").rglob("*.py")):
            out.write(file, file.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(app)


def settled(df: DataFrame, lean: bool = False) -> DataFrame:
    """Write the rows to the shared folder and go on from the files.

    Cuts the lineage, so that a lost executor costs a read and no recomputation.  The files go when
    the driver's JVM ends, or by ``dropped``.  ``lean``: the write's shuffle files go when it ends, not
    when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    try:
        if lean:
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if lean:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    there, store = _stored(spark, path)
    store.deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``settled`` tables that nothing reads any more."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            there, store = _stored(table.sparkSession, folder)
            store.delete(there, True)


def _stored(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pack_row(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``ROW``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def field(df: DataFrame, name: str, kind: str) -> Column:
    """A column of the packed row; null of that type where the table has no such column."""
    if name in df.schema[ROW].dataType.fieldNames():
        return F.col(ROW).getField(name).cast(kind)
    return F.lit(None).cast(kind)


def unpack_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The original columns, then ``columns``; one of the same name is replaced in its place."""
    names = df.schema[ROW].dataType.fieldNames()
    kept = [columns.get(n, F.col(ROW).getField(n)).alias(n) for n in names]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items() if n not in names])


def digest(*values: Column) -> Column:
    """XXH64 over values and over which of them are null."""
    return F.xxhash64(*values, *[v.isNull() for v in values])


def id_key(value: Column) -> Column:
    """An id that joins by plain equality; a null id becomes the smallest long."""
    return F.coalesce(value, F.lit(-(2 ** 63)).cast("long"))


def replaced(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in schema])
