"""Tables as immutable Parquet folders. A table's snapshot is a list of folders (segments); insertion adds one, other changes write anew.

Names of segments are never used twice, and a writer deletes its own only, so that engines on one root do not disturb each other. Segments
that a change has replaced stay for those who still read an older snapshot, until vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as t
from ..operators.relational import RID, RID_TYPE
from ..plans.bind import quoted
from .catalog import Catalog, Column, Database, Table


class Store:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog
        self.staged: list[str] = []  # written since the last commit

    def schema(self, table: Table) -> T.StructType:
        out = T.StructType([T.StructField(c.name, t.to_spark(c.type), True, {t.METADATA: t.to_json(c.type)}) for c in table.columns])
        return out.add(RID, RID_TYPE)

    def read(self, table: Table, segments: list[str] | None = None) -> DataFrame:
        """The snapshot, or some segments of it, under the columns' present names, and RID."""
        physical = T.StructType([T.StructField(c.physical, t.to_spark(c.type)) for c in table.columns]).add(RID, RID_TYPE)
        segments = table.segments if segments is None else segments
        df = self.spark.read.schema(physical).parquet(*segments) if segments else self.spark.createDataFrame([], physical)
        return df.select(*(F.col(c.physical).alias(c.name, metadata={t.METADATA: t.to_json(c.type)}) for c in table.columns), RID)

    def write(self, database: Database, table: Table, df: DataFrame) -> str:
        """df (columns by name, and RID) as a new segment; only a commit makes it part of a snapshot."""
        path = f"{self.catalog.folder(database, table)}/s{uuid.uuid4().hex}"
        self.staged.append(path)
        df.select(*(quoted(c.name).alias(c.physical) for c in table.columns), RID).write.parquet(path)
        return path

    def touched(self, table: Table, rows: DataFrame) -> list[str]:
        """The segments that rows of the snapshot come from."""
        if len(table.segments) < 2:
            return list(table.segments)
        of = F.regexp_extract(F.input_file_name(), r"/(s[0-9a-f]{32})/[^/]*$", 1).alias("v")
        found = {r.v for r in rows.select(of).distinct().collect()}  # at most a row for each segment
        return [s for s in table.segments if s.rsplit("/", 1)[-1] in found]

    def replace(self, database: Database, table: Table, df: DataFrame, segments: list[str] | None = None) -> None:
        """df in place of some segments, or of all."""
        gone = set(table.segments if segments is None else segments)
        table.segments = [*(s for s in table.segments if s not in gone), self.write(database, table, df)]

    def settle(self) -> None:
        """Deletes what was written since the last commit and is no part of the catalog."""
        staged, self.staged = self.staged, []
        kept = self.catalog.segments() if staged else set()
        for path in staged:
            if path not in kept:
                self.catalog.files.delete(path)

    def vacuum(self, min_age_s: float) -> int:
        """Deletes segments and folders that the catalog does not list and nobody has changed for as long; their number."""
        files, root = self.catalog.files, self.catalog.root
        tables = {self.catalog.folder(d, x): x for u in self.catalog.users.values() for d in u.databases.values() for x in d.tables.values()}
        databases = {self.catalog.folder(d) for u in self.catalog.users.values() for d in u.databases.values()}
        segments, gone = self.catalog.segments(), []

        def old(path: str, known: set[str] | dict, mark: str) -> list[str]:
            """The children that are known; of the others the old ones go."""
            found = [(f"{path}/{name}", age) for name, age in files.children(path) if name.startswith(mark)]
            gone.extend(p for p, age in found if p not in known and age >= min_age_s)
            return [p for p, _ in found if p in known]

        for d in old(root, databases, "d"):
            for x in old(d, tables, "t"):
                old(x, segments, "s")
        for path in gone:
            files.delete(path)
        return len(gone)

    def drop(self, database: Database, table: Table | None = None) -> None:
        self.catalog.files.delete(self.catalog.folder(database, table))


def describe(columns: list[Column]) -> list[tuple[str, ...]]:
    def default(c: Column) -> str:
        return "NULL" if c.default is None or c.default.value is None else str(c.default.value)

    return [(c.name, str(c.type), "YES" if c.nullable else "NO", "PRI" if c.primary_key else "", default(c), "auto_increment" if c.auto else "") for c in columns]
