"""Event sourcing over (aggregate_id, sequence_num, event_type, payload, ts[, idempotency_key])."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

if TYPE_CHECKING:
    from chronoframe.plans.engine import Engine


class EventStores:
    """The event stores that a store keeps by name: each a table of events, keyed by aggregate and number, and how often to take snapshots."""

    COLUMNS = "event_key string, aggregate_id string, sequence_num long, event_type string, payload string, ts long, idempotency_key string"

    def __init__(self, engine: Engine):
        self.engine = engine

    def create(self, name: str, snapshot_interval: int | None = None) -> None:
        self.engine.create_table(name, self.COLUMNS, "event_key")
        self.engine.store.name(f"create event store {name}", "events", name, {"snapshot_interval": snapshot_interval})

    def get(self, name: str) -> dict | None:
        """Its snapshot interval; None if there is no such store."""
        return self.engine.named("events").get(name)

    def names(self) -> list[str]:
        return sorted(self.engine.named("events"))

    def events(self, name: str) -> DataFrame:
        return self.engine.tables[name].read().drop("event_key")

    def append(self, name: str, new: DataFrame) -> None:
        """Number new events on and commit them; of two writers at once one fails whole, so numbers stay without gaps or repeats."""
        held = self.events(name)
        first = held.groupBy("aggregate_id").agg(F.max("sequence_num").alias("_last"))
        rows = append(held, new).join(first, "aggregate_id", "left").where("_last IS NULL OR sequence_num > _last")
        self.engine.tables[name].insert(rows.withColumn("event_key", F.concat_ws("/", "aggregate_id", F.lpad(F.col("sequence_num").cast("string"), 20, "0"))))


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """``store`` with ``new`` events numbered on from each aggregate's last; ValueError for an idempotency key that is taken."""
    if "idempotency_key" in new.columns and "idempotency_key" in store.columns:
        keys = new.where("idempotency_key IS NOT NULL").select("aggregate_id", "idempotency_key")
        again = keys.groupBy("aggregate_id", "idempotency_key").count().where("count > 1").select("aggregate_id", "idempotency_key")
        if again.unionAll(keys.join(store, ["aggregate_id", "idempotency_key"], "left_semi")).limit(1).count():
            raise ValueError("idempotency key already used")
    last = store.groupBy("aggregate_id").agg(F.max("sequence_num").alias("_last"))
    order = W.partitionBy("aggregate_id").orderBy("ts")
    numbered = new.join(last, "aggregate_id", "left").withColumn("sequence_num", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("long")).drop("_last")
    return store.unionByName(numbered, allowMissingColumns=True)


def history(store: DataFrame, aggregate_id: object, start: int = 0) -> DataFrame:
    """An aggregate's events from ``start`` on, in order."""
    return store.where((F.col("aggregate_id") == aggregate_id) & (F.col("sequence_num") >= start)).orderBy("sequence_num")


def fold(store: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(aggregate_id, state, last_event_type, sequence_num): of each payload key the value of the last event that has it.

    ``payload`` is a JSON object of scalars. Events up to a snapshot's sequence number are taken from its ``state``.
    """
    rows = store.select("aggregate_id", "sequence_num", "event_type", F.from_json("payload", "map<string,string>").alias("m"))
    if snapshots is not None:
        base = snapshots.select("aggregate_id", F.col("sequence_num").alias("_from"), F.col("state").alias("m"))
        rows = rows.join(base.select("aggregate_id", "_from"), "aggregate_id", "left").where("_from IS NULL OR sequence_num > _from").drop("_from")
        rows = rows.unionByName(base.select("aggregate_id", F.col("_from").alias("sequence_num"), F.lit(None).cast("string").alias("event_type"), "m"))
    keys = rows.select("aggregate_id", "sequence_num", F.explode("m").alias("k", "v")).groupBy("aggregate_id", "k").agg(F.max_by("v", "sequence_num").alias("v"))
    state = keys.groupBy("aggregate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("state"))
    last = rows.groupBy("aggregate_id").agg(F.max_by("event_type", "sequence_num").alias("last_event_type"), F.max("sequence_num").alias("sequence_num"))
    return last.join(state, "aggregate_id", "left")


def snapshot(store: DataFrame) -> DataFrame:
    """(aggregate_id, sequence_num, state): the latest states, for ``fold``."""
    return fold(store).select("aggregate_id", "sequence_num", "state")


def with_event(store: DataFrame, event_type: str) -> DataFrame:
    """Aggregates that have an event of the type."""
    return store.where(F.col("event_type") == event_type).select("aggregate_id").distinct()
