"""Tables that grow by whole commits, in the folder of a store that driver and executors share.

A commit's rows are written to a folder of their own first. Creating its marker, one empty file, is the single step that
makes them part of the table, so a reader sees all of a commit or nothing, a job that died half-way leaves nothing that is
read, and a commit that is made again under its name changes nothing. Nothing is ever written over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffles_cleaned

COMMIT = "commit_id"


class CommittedTable:
    """Rows of one schema; `commit_id` names the commit that a row came with."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.columns = spark.createDataFrame([], schema).columns

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def commits(self) -> dict[str, str]:
        """The data folder of each commit, in the order of their names: as many as there were commits, no rows.

        If two writers raced for one name, the first marker by name counts, for every reader alike.
        """
        markers = self._path("commits")
        system = markers.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(markers):
            return {}
        out: dict[str, str] = {}
        for name in sorted(s.getPath().getName() for s in system.listStatus(markers)):
            if "@" in name and name[0] not in "._":
                out.setdefault(*name.split("@", 1))
        return out

    def read(self, only: list[str] | None = None) -> DataFrame:
        """The rows of all commits, or of some by name; an empty table has none."""
        found = {c: d for c, d in self.commits().items() if only is None or c in only}
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, {COMMIT} string")
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{d}" for d in found.values()])
        return rows.select(*self.columns, F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/~]+)~[^/]*/", 1).alias(COMMIT))

    def append(self, rows: DataFrame, commit: str) -> bool:
        """Commits rows under a name of letters, digits, dot, dash and underscore; False if that name is committed already."""
        if not commit or commit[0] in "._" or not all(c.isalnum() and c.isascii() or c in "._-" for c in commit):
            raise ValueError(f"no name of a commit: {commit!r}")
        if commit in self.commits():
            return False
        data = f"{commit}~{uuid.uuid4().hex}"
        with shuffles_cleaned(self.spark):
            rows.select(*self.columns).write.parquet(f"{self.folder}/data/{data}")
        marker = self._path("commits", f"{commit}@{data}")
        marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(marker, False).close()
        return True
