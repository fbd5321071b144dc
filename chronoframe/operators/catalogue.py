"""Schemas, policies, audit chains, feature history, and column statistics."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.operators.store import Store


def schema_diff(old: T.StructType, new: T.StructType) -> list[tuple[str, str]]:
    """(change, column) sorted: added, removed, or modified in type or nullability."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    out = [("added", c) for c in b.keys() - a.keys()] + [("removed", c) for c in a.keys() - b.keys()]
    out += [("modified", c) for c in a.keys() & b.keys() if (a[c].dataType, a[c].nullable) != (b[c].dataType, b[c].nullable)]
    return sorted(out)


class Migrations:
    """Ordered migrations, each with statements up and down. With a ``store`` what is applied outlives the driver, with a hash of its statements."""

    def __init__(self, run: Callable[[str], object], store: Store | None = None):
        self.run, self.store, self.known = run, store, {}
        self.applied = sorted(int(v) for v in store.names.get("migration", {})) if store else []

    def register(self, version: int, up: list[str], down: list[str]) -> None:
        """ValueError if the version was applied with other statements."""
        kept = self.store.names.get("migration", {}).get(str(version)) if self.store else None
        if kept is not None and kept != self._hash(up, down):
            raise ValueError(f"migration {version} was applied with other statements")
        self.known[version] = (up, down)

    @staticmethod
    def _hash(up: list[str], down: list[str]) -> str:
        return hashlib.sha256(json.dumps([up, down]).encode()).hexdigest()

    def _keep(self, version: int, value: str | None) -> None:
        if self.store:
            self.store.name(f"migration {version} {'applied' if value else 'rolled back'}", "migration", str(version), value)

    def pending(self) -> list[int]:
        return sorted(set(self.known) - set(self.applied))

    def apply(self, version: int) -> None:
        if version in self.applied:
            raise ValueError(f"migration {version} is applied")
        for sql in self.known[version][0]:
            self.run(sql)
        self.applied.append(version)
        self._keep(version, self._hash(*self.known[version]))

    def rollback(self, version: int) -> None:
        if version not in self.applied:
            raise ValueError(f"migration {version} is not applied")
        for sql in self.known[version][1]:
            self.run(sql)
        self.applied.remove(version)
        self._keep(version, None)

    def apply_all(self) -> list[int]:
        todo = self.pending()
        for v in todo:
            self.apply(v)
        return todo


class SchemaRegistry:
    """Versions of named schemas, from 1, kept in a store; an unchanged schema gets no new version."""

    def __init__(self, store: Store):
        self.store = store

    def versions(self, name: str) -> list[T.StructType]:
        return [T.StructType.fromJson(x) for x in self.store.names.get("schema", {}).get(name, [])]

    def register(self, name: str, schema: T.StructType) -> int:
        held = self.versions(name)
        if not held or held[-1] != schema:
            held.append(schema)
            self.store.name(f"schema {name} {len(held)}", "schema", name, [x.jsonValue() for x in held])
        return len(held)

    def diff(self, name: str, old: int, new: int) -> list[tuple[str, str]]:
        held = self.versions(name)
        return schema_diff(held[old - 1], held[new - 1])


class Policies:
    """Row policies, enforced: a role reads a table through the predicates that name it (one without roles lets everybody); a table without policies is open."""

    def __init__(self):
        self.rows: dict[str, list[tuple[str, set[str], Column]]] = {}

    def create(self, name: str, table: str, roles: set[str], predicate: Column) -> None:
        self.rows.setdefault(table, []).append((name, roles, predicate))

    def drop(self, name: str, table: str) -> None:
        self.rows[table] = [p for p in self.rows.get(table, []) if p[0] != name]

    def apply(self, df: DataFrame, table: str, roles: set[str]) -> DataFrame:
        """Rows that a policy for one of the roles lets through; none if there are policies, but not for these roles."""
        if not self.rows.get(table):
            return df
        allowed = F.lit(False)
        for _, names, predicate in self.rows[table]:
            if not names or names & roles:
                allowed = allowed | predicate
        return df.where(allowed)


class AuditLog:
    """Entries with a hash over the entry and the hash before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.entries = spark, []

    @staticmethod
    def _hash(before: str, seq: int, who: str, what: str) -> str:
        return hashlib.sha256(f"{before}|{seq}|{who}|{what}".encode()).hexdigest()

    def add(self, who: str, what: str) -> None:
        before = self.entries[-1][3] if self.entries else ""
        seq = len(self.entries) + 1
        self.entries.append((seq, who, what, self._hash(before, seq, who, what)))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.entries, "seq int, who string, what string, hash string")

    @staticmethod
    def broken(log: DataFrame) -> DataFrame:
        """Entries whose hash doesn't follow from the entry before: each needs its neighbour only."""
        before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
        rows = log.join(before, "seq", "left").withColumn("before", F.coalesce("before", F.lit("")))
        return rows.where(F.sha2(F.concat_ws("|", "before", "seq", "who", "what"), 256) != F.col("hash")).drop("before")


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """Per column: rows, distinct values, nulls, least and greatest as text."""
    cells = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_distinct(c).alias("ndv"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")) for c in columns]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def count_min(df: DataFrame, column: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    """A count-min sketch of a column, as bytes."""
    return df.agg(F.count_min_sketch(column, F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def count_min_cells(df: DataFrame, column: str, width: int = 4096, depth: int = 5) -> DataFrame:
    """The same sketch as a table (row, cell, n) of ``width`` times ``depth`` rows at most, which can be kept, added up and joined."""
    cells = F.array(*(F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(column, F.lit(i)), F.lit(width)).alias("cell")) for i in range(depth)))
    return df.where(F.col(column).isNotNull()).select(F.inline(cells)).groupBy("row", "cell").agg(F.count("*").alias("n"))


def count_min_estimates(cells: DataFrame, values: DataFrame, column: str, width: int = 4096, depth: int = 5) -> DataFrame:
    """(column, estimate) of each value: the least of its cells, 0 where one is empty. The sketch is broadcast: its size is fixed."""
    at = F.array(*(F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(column, F.lit(i)), F.lit(width)).alias("cell")) for i in range(depth)))
    found = values.select(column, F.inline(at)).join(F.broadcast(cells), ["row", "cell"], "left")
    return found.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0).cast("long"))).alias("estimate"))


def point_in_time(history: DataFrame, entity: str, as_of: Column, *values: str) -> DataFrame:
    """Each entity's last feature values up to ``as_of``, from (entity, updated_at, values)."""
    return history.where(F.col("updated_at") <= as_of).groupBy(entity).agg(*(F.max_by(v, "updated_at").alias(v) for v in values))


def suggest_index(plan_text: str, known: set[str]) -> list[str]:
    """Columns that a query's filters name and that ``known`` lacks."""
    import re

    where = re.search(r"\bWHERE\b(.*?)(?:\bGROUP\b|\bORDER\b|\bLIMIT\b|$)", plan_text, re.I | re.S)
    order = re.search(r"\bORDER\s+BY\b(.*?)(?:\bLIMIT\b|$)", plan_text, re.I | re.S)
    named = re.findall(r"([A-Za-z_]\w*)\s*(?:=|<|>|IN\b|LIKE\b|BETWEEN\b)", where[1] if where else "", re.I) + re.findall(r"[A-Za-z_]\w*", re.sub(r"\b(?:ASC|DESC)\b", "", order[1] if order else "", flags=re.I))
    return sorted({c for c in named if c not in known and c.upper() not in ("AND", "OR", "NOT")})


class ModelRegistry:
    """Model versions with a status and running metrics."""

    STATUSES = ("staging", "production", "archived")

    def __init__(self):
        self.models: dict[str, dict[int, dict]] = {}

    def register(self, name: str) -> int:
        versions = self.models.setdefault(name, {})
        versions[len(versions) + 1] = {"status": "staging", "count": 0, "mean": 0.0}
        return len(versions)

    def promote(self, name: str, version: int) -> None:
        """To production; what was there is archived."""
        for v in self.models[name].values():
            v["status"] = "archived" if v["status"] == "production" else v["status"]
        self.models[name][version]["status"] = "production"

    def observe(self, name: str, version: int, metric: float) -> None:
        m = self.models[name][version]
        m["count"] += 1
        m["mean"] += (metric - m["mean"]) / m["count"]

    def production(self, name: str) -> int | None:
        return next((v for v, m in self.models.get(name, {}).items() if m["status"] == "production"), None)


def table_of(registry: ModelRegistry, spark: SparkSession) -> DataFrame:
    rows = [(n, v, m["status"], m["count"], m["mean"]) for n, versions in registry.models.items() for v, m in versions.items()]
    return spark.createDataFrame(rows, "name string, version int, status string, count long, mean double")
