"""A keyed table that micro-batches update: rows by bucket, a manifest that says which files count.

A batch reads the buckets its keys fall into and writes them anew as one folder; then it publishes a
manifest by one rename.  The manifest names the stream and batch that wrote it, so a batch that runs
again starts from the manifest before its own, and a stream with a new checkpoint goes on from whatever
was published last.  Folders that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of the key.  A batch reads and writes the touched ones only.
BUCKETS = 64


class KeptState:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict:
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{version}")
        return json.loads(text.first()[0])

    def before(self, stream: str, batch: int) -> dict:
        """The last manifest that this batch did not write itself."""
        for version in reversed(self._versions()[-2:]):
            found = self._manifest(version)
            if (found["stream"], found["batch"]) != (stream, batch):
                return found
        return {"stream": None, "batch": None, "version": 0, "folders": {}}

    def read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets (all without a list)."""
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.path}/rows/{f}/bucket={b}" for b in wanted if (f := manifest["folders"].get(str(b)))]
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def publish(self, rows: DataFrame, key: str, buckets: list[int], manifest: dict, stream: str,
                batch: int) -> dict:
        """Write ``rows`` as the whole content of ``buckets`` and make them count."""
        folder = uuid.uuid4().hex
        (rows.select(*self.schema.fieldNames(), self.bucket(key).alias("bucket")).hint("rebalance", "bucket")
         .write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}"))
        version = manifest["version"] + 1  # a batch that runs again replaces its own manifest
        done = {"stream": stream, "batch": batch, "version": version,
                "folders": {**manifest["folders"], **{str(b): folder for b in buckets}}}
        self._rename(json.dumps(done), f"{self.path}/manifest/{version}")
        self._expire()
        return done

    def _rename(self, text: str, name: str) -> None:
        draft = self._path(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target):
            self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"cannot publish {name}")

    def _expire(self) -> None:
        kept = self._versions()[-2:]
        named = {f for v in kept for f in self._manifest(v)["folders"].values()}
        for version in self._versions()[:-2]:
            self._fs.delete(self._path(f"{self.path}/manifest/{version}"), False)
        for entry in self._fs.listStatus(self._path(f"{self.path}/rows")):
            if entry.getPath().getName() not in named:
                self._fs.delete(entry.getPath(), True)
