"""A bitemporal store on Parquet: every write appends versions, reads pick the visible ones.

A table is folders of (columns, commit_ts, valid_from, valid_to, is_deleted), named by its store's commit log (see ``store``). Folders are
never changed: erasing, compaction and changes of columns write a new one, log it in place of the others, and delete those.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoframe.operators import temporal
from chronoframe.operators.store import Store
from chronoframe.operators.temporal import FOREVER

META = ["commit_ts", "valid_from", "valid_to", "is_deleted"]


class Ledger:
    """One table. ``schema`` names its columns; ``key`` is its primary key. Without a ``store`` the table is a store of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "pk", store: Store | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.name, self.store = self.path.rpartition("/")[2], store or Store(spark, path)
        self._shape(spark.createDataFrame([], f"{schema}, commit_ts long, valid_from long, valid_to long, is_deleted boolean").schema)

    def _shape(self, schema: StructType) -> None:
        self.schema = schema
        self.columns = [c for c in schema.names if c not in META]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema if f.name not in META)

    @property
    def clock(self) -> int:
        self.store.refresh()
        return self.store.clock

    # reads

    def _stored(self) -> DataFrame:
        folders = self.store.folders(self.name)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def versions(self) -> DataFrame:
        """All versions, a transaction's own staged ones among them."""
        return reduce(DataFrame.unionByName, (rows for table, rows in self.store.staged or [] if table.name == self.name), self._stored())

    def read(self, as_of: int | None = None, valid_at: int | None = None) -> DataFrame:
        """The visible rows; a read at an earlier time does not see staged rows."""
        source = self._stored() if as_of is not None else self.versions()
        return temporal.visible(source, as_of, valid_at, self.key).select(*self.columns)

    def read_epoch(self, epoch: int) -> DataFrame:
        return self.read(as_of=self.store.time_of(epoch))

    def get(self, key: object, as_of: int | None = None, valid_at: int | None = None) -> DataFrame:
        """A point lookup: the key reaches the scan."""
        source = self._stored() if as_of is not None else self.versions()
        return temporal.visible(source.where(F.col(self.key) == key), as_of, valid_at, self.key).select(*self.columns)

    def scan_prefix(self, prefix: str, limit: int | None = None) -> DataFrame:
        rows = temporal.visible(self.versions().where(F.col(self.key).startswith(prefix)), key=self.key).select(*self.columns).orderBy(self.key)
        return rows if limit is None else rows.limit(limit)

    # writes

    def _append(self, rows: DataFrame, deleted: bool, valid: tuple[int, int]) -> DataFrame:
        ts = self.store.next_ts()
        stamped = rows.select(*self.columns).withColumns({"commit_ts": F.lit(ts).cast("long"), "valid_from": F.lit(valid[0]).cast("long"), "valid_to": F.lit(valid[1]).cast("long"), "is_deleted": F.lit(deleted)})
        stamped = stamped.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        self.store.append("delete" if deleted else "insert", self, stamped)
        return stamped.select(*self.columns)

    def insert(self, rows: DataFrame, valid: tuple[int, int] = (0, FOREVER)) -> DataFrame:
        """Append versions (an existing key gets a new one); returns the rows, for RETURNING."""
        return self._append(rows, False, valid)

    def upsert(self, rows: DataFrame, update: dict[str, Column] | None = None) -> DataFrame:
        """Insert new keys; on conflict do nothing, or set the columns of ``update`` in the existing row."""
        now = self.read()
        new = rows.select(*self.columns).join(now, self.key, "left_anti").select(*self.columns)
        if update is None:
            return self.insert(new)
        old = now.join(rows.select(self.key), self.key, "left_semi").withColumns(update)
        return self.insert(new.unionByName(old.select(*self.columns)))

    def update(self, where: Column, changes: dict[str, Column]) -> DataFrame:
        """Changes see the old row."""
        return self.insert(self.read().where(where).withColumns(changes))

    def delete(self, where: Column) -> DataFrame:
        return self._append(self.read().where(where), True, (0, FOREVER))

    def forget(self, key: object) -> None:
        """Erase every version of a key: the table is written anew without it. The log keeps that it was done, and the key's hash alone."""
        self.store.replace(f"forget {hashlib.sha256(str(key).encode()).hexdigest()} from", self, self._stored().where(~F.col(self.key).eqNullSafe(key)))

    def vacuum(self, before: int) -> None:
        """Drop versions that no read as of ``before`` or later can see, and deleted keys' remains among them."""
        known = temporal.known(self._stored(), self.key)
        self.store.replace("vacuum", self, known.where((F.col("known_to") > before) & ~(F.col("is_deleted") & (F.col("known_to") == FOREVER) & (F.col("commit_ts") <= before))).drop("known_to"))

    def restore(self, rows: DataFrame) -> None:
        """These versions in place of all."""
        self.store.replace("restore", self, rows.select(*self.schema.names), rows.agg(F.max("commit_ts")).first()[0] or 0)

    def reshape(self, columns: list[tuple[str, str, Column]], key: str | None = None) -> None:
        """The table anew with columns (name, type, expression over the old ones), all versions kept."""
        rows = self._stored().select(*(e.cast(kind).alias(name) for name, kind, e in columns), *META)
        ddl = ", ".join(f"`{name}` {kind}" for name, kind, _ in columns)
        self.store.replace("alter", self, rows, schema=ddl, key=key or self.key)
        self.key = key or self.key
        self._shape(rows.schema)

    # transactions: the store's, over all its tables

    def begin(self) -> None:
        self.store.begin()

    def commit(self) -> int:
        return self.store.commit()

    def rollback(self) -> None:
        self.store.rollback()

    def savepoint(self, name: str) -> None:
        self.store.savepoint(name)

    def rollback_to(self, name: str) -> None:
        self.store.rollback_to(name)

    def release(self, name: str) -> None:
        self.store.release(name)


def create_as(spark: SparkSession, path: str, rows: DataFrame, key: str) -> Ledger:
    """A new table with the rows of a query and their types."""
    made = Ledger(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), key)
    made.insert(rows)
    return made
