"""Closed days of a report path: many small batch folders merged to few files by one atomic change.

A stream writes a folder per day and batch, thousands a day.  ``compact`` writes what the closed days hold as
one table beside them and then publishes each day's manifest by one rename: it names the table and the batches
merged in it.  From then on ``read_reports`` takes these batches from the table and passes over their folders,
which go afterwards.  A run that fails before the rename leaves a table nobody names, one that fails after it
leaves folders nobody reads; the next run removes both.  One run at a time compacts a path.

The newest batch of every stream stays a folder of its own, as it is the only one that a stream can run again.
Should an older one run again nevertheless, its rows are in the table and its new folder is passed over.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY, _BATCH, _RUN = "report_date=", "batch_id=", "run="


class ReportDays:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str, start: str = "") -> list[str]:
        """Names in a folder that begin with ``start``, without it."""
        at = self._path(folder)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        names = [f.getPath().getName() for f in found]
        return sorted(n[len(start):] for n in names if n.startswith(start) and not n.startswith("."))

    def batches(self) -> dict[str, list[str]]:
        """The batch folders of every day."""
        return {day: self._names(f"{self.path}/{_DAY}{day}", _BATCH) for day in self._names(self.path, _DAY)}

    def manifests(self) -> dict[str, dict]:
        """The last manifest of every day that has one."""
        newest = []
        for day in self._names(f"{self.path}/_days"):
            versions = self._names(f"{self.path}/_days/{day}")
            if versions:
                newest.append(f"{self.path}/_days/{day}/{max(versions, key=int)}")
        if not newest:
            return {}
        texts = self.spark.read.option("wholetext", True).text(newest).collect()
        return {m["day"]: m for m in (json.loads(r[0]) for r in texts)}

    def _under(self, base: str, paths: list[str]) -> list[DataFrame]:
        if not paths:
            return []
        rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/{p}" for p in paths]).drop("run")
        return [rows.withColumns({"report_date": F.col("report_date").cast("date"), "batch_id": F.col("batch_id").cast("string")})]

    def _rows(self, batches: dict[str, list[str]], manifests: dict[str, dict]) -> DataFrame | None:
        """What counts of some days: their tables and the folders that are not in them."""
        merged = {d: set(m["merged"]) for d, m in manifests.items()}
        parts = self._under(self.path, [f"{_DAY}{d}/{_BATCH}{b}" for d, names in batches.items() for b in names
                                        if b not in merged.get(d, ())])
        parts += self._under(f"{self.path}/_closed", [f"{_RUN}{m['folder']}/{_DAY}{d}" for d, m in manifests.items()])
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def read(self) -> DataFrame | None:
        """The reports of all days; nothing where none was written."""
        rows = self._rows(self.batches(), self.manifests())
        return rows.drop("batch_id") if rows is not None else None

    def compact(self, before: str) -> list[str]:
        """Merge the days before a date (``yyyy-mm-dd``); the days whose manifest changed."""
        batches, manifests = self.batches(), self.manifests()
        newest = _newest({b for names in batches.values() for b in names})
        todo = {}
        for day, names in batches.items():
            known = manifests.get(day, {}).get("merged", [])
            merged = sorted(set(names) - newest - set(known))
            if day < before and len(merged) > (0 if known else 1):
                todo[day] = merged
        if todo:
            folder, old = uuid.uuid4().hex, {d: manifests[d] for d in todo if d in manifests}
            (self._rows(todo, old).hint("rebalance", "report_date").write.partitionBy("report_date")
             .parquet(f"{self.path}/_closed/{_RUN}{folder}"))
            for day, merged in todo.items():
                before_it = old.get(day, {"version": 0, "merged": []})
                self._announce({"day": day, "version": before_it["version"] + 1, "folder": folder,
                                "merged": before_it["merged"] + merged})
        self._expire()
        return sorted(todo)

    def _announce(self, manifest: dict) -> None:
        day, version = manifest["day"], manifest["version"]
        draft = self._path(f"{self.path}/_drafts/{manifest['folder']}-{day}")
        target = self._path(f"{self.path}/_days/{day}/{version}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise OSError(f"another run has published version {version} of {day}")

    def _expire(self) -> None:
        """Remove merged folders, older manifests and tables that no manifest names."""
        manifests = self.manifests()
        for day, manifest in manifests.items():
            gone = [f"{_DAY}{day}/{_BATCH}{b}" for b in
                    set(manifest["merged"]) & set(self._names(f"{self.path}/{_DAY}{day}", _BATCH))]
            older = [f"_days/{day}/{v}" for v in self._names(f"{self.path}/_days/{day}") if int(v) < manifest["version"]]
            for name in gone + older:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
        named = {m["folder"] for m in manifests.values()}
        for folder in set(self._names(f"{self.path}/_closed", _RUN)) - named:
            self._fs.delete(self._path(f"{self.path}/_closed/{_RUN}{folder}"), True)


def _newest(names: set[str]) -> set[str]:
    """The batch with the highest number of every stream; names without a number are never run again."""
    top: dict[str, int] = {}
    for stream, dash, number in (n.rpartition("-") for n in names):
        if dash and number.isdigit():
            top[stream] = max(top.get(stream, -1), int(number))
    return {f"{stream}-{number}" for stream, number in top.items()}
