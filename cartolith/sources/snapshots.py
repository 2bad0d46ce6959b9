"""A few tables of one research that change together, a bucket of rows at a time.

A version is one small file that names, for each table, the folder of each bucket's rows. Changing a table writes the touched
buckets anew, in folders of their own; the version file then makes all of it visible in one step, and readers of the version
before are not disturbed. Of two writers that began from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffles_cleaned

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has made the next version."""


class Snapshot:
    """Tables by name with their schemas, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self.number, self.state = self._last()

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, dict]:
        system, versions = self._system(), self._path("versions")
        found = [s.getPath().getName() for s in system.listStatus(versions)] if system.exists(versions) else []
        numbers = sorted(int(n) for n in found if n.isdigit())
        if not numbers:
            return 0, {"tables": {name: {} for name in self.schemas}, "about": {}}
        text = self.spark.read.text(f"{self.folder}/versions/{numbers[-1]:08d}", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    @property
    def about(self) -> dict:
        """What the version says of itself."""
        return self.state["about"]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets; other buckets' files are not opened."""
        held = self.state["tables"].get(name, {})
        paths = [f"{self.folder}/data/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.folder}/data/{name}").parquet(*paths)
        return rows.select(*self._columns(name))

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[name]).columns

    def stage(self, name: str, rows: DataFrame, buckets: list[int], order: list[str] = (), inner: str | None = None, dealt: bool = False) -> dict[str, str]:
        """Writes the rows (with `_bucket`) of some buckets; returns their new folders. Buckets without rows have none.

        order sorts a file's rows, so that a filter on the first of these columns skips most of it; inner is a column to
        make folders of inside a bucket. Rows that come dealt stay in their tasks, each of which writes files of its own.
        """
        columns = [c for c in self._columns(name) if c != inner]
        place = f"{name}/_version={uuid.uuid4().hex}"
        by = [BUCKET] + ([inner] if inner else [])
        with shuffles_cleaned(self.spark):
            own = rows.where(F.col(BUCKET).isin(buckets)).select(*by, *columns)
            own = own if dealt else own.repartition(*by)
            own.sortWithinPartitions(*by, *order).write.partitionBy(*by).parquet(f"{self.folder}/data/{place}")
        system, made = self._system(), {}
        for status in system.listStatus(self._path("data", place)):
            folder = status.getPath().getName()
            if folder.startswith(BUCKET + "="):
                made[folder.split("=", 1)[1]] = f"{place}/{folder}"
        return made

    def commit(self, changes: dict[str, tuple[list[int], dict[str, str]]], about: dict) -> None:
        """Makes the next version: of each table its touched buckets, and the folders that they have now."""
        tables = {n: dict(t) for n, t in self.state["tables"].items()}
        for name, (touched, made) in changes.items():
            for b in touched:
                tables.setdefault(name, {}).pop(str(b), None)
            tables[name] |= made
        state = {"tables": tables, "about": about}
        system = self._system()
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path("versions", f"{self.number + 1:08d}")
        system.mkdirs(self._path("versions"))
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(state, ensure_ascii=False).encode()))
        out.close()
        # a rename onto a version that exists fails, or is seen to: it is the one step that publishes
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise Conflict(f"version {self.number + 1} exists")
        self.number, self.state = self.number + 1, state
