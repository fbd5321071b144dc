"""The commit log: whole commits whatever stops, and what a store keeps beside its tables."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from chronoframe.plans.engine import Engine
from chronoframe.sources import files, paths
from chronoframe.streaming import feed


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    for name in ("a", "b"):
        e.sql(f"CREATE TABLE {name} (id INTEGER PRIMARY KEY, v TEXT)")
    return e


def test_reopened(spark, engine):
    """Tables, epochs, the clock, views and generated columns outlive the engine."""
    engine.sql("CREATE TABLE g (id INTEGER PRIMARY KEY, twice INTEGER GENERATED ALWAYS AS (id * 2) STORED)")
    engine.sql("INSERT INTO a VALUES (1, 'x')")
    engine.sql("BEGIN")
    engine.sql("INSERT INTO a VALUES (2, 'y')")
    engine.sql("INSERT INTO b VALUES (1, 'z')")
    epoch = int(engine.sql("COMMIT").first().status.split()[1])
    engine.sql("DELETE FROM a WHERE id = 1")
    engine.sql("ALTER TABLE b RENAME COLUMN v TO label")
    engine.sql("CREATE VIEW w AS SELECT id FROM a")
    again = Engine(spark, engine.root)
    assert rows(again.sql("SELECT * FROM a")) == [(2, "y")] and rows(again.sql("SELECT label FROM b")) == [("z",)] and rows(again.sql("SELECT * FROM w")) == [(2,)]
    assert rows(again.sql(f"SELECT id FROM a AS OF EPOCH {epoch}")) == [(1,), (2,)] and again.store.clock == engine.store.clock
    again.sql("INSERT INTO g (id) VALUES (4)")
    assert rows(engine.sql("SELECT * FROM g")) == [(4, 8)]  # the first engine sees the other's commit
    again.sql("DROP TABLE a")
    assert rows(engine.sql("SHOW TABLES")) == [("b",), ("g",)] and not Path(engine.root, "a").exists()
    with pytest.raises(ValueError, match="no table a"):
        engine.sql("DROP TABLE a")


@pytest.mark.parametrize("stop", ["before the log", "after the log"])
def test_stopped_commit(spark, engine, monkeypatch, stop):
    """A commit over two tables is seen in both or in neither, wherever its writer stops."""
    engine.sql("INSERT INTO a VALUES (1, 'x')")
    engine.sql("BEGIN")
    engine.sql("INSERT INTO a VALUES (2, 'y')")
    engine.sql("INSERT INTO b VALUES (2, 'y')")

    class Stopped(Exception):
        pass

    real = paths.move

    def move(spark, source, target):
        if ("_log" in target) == (stop == "before the log"):
            raise Stopped
        return real(spark, source, target)

    with monkeypatch.context() as m:
        m.setattr(paths, "move", move)
        with pytest.raises(Stopped):
            engine.sql("COMMIT")
    again = Engine(spark, engine.root)
    done = stop == "after the log"
    assert rows(again.sql("SELECT id FROM a")) == [(1,), (2,)][: 1 + done] and rows(again.sql("SELECT id FROM b")) == [(2,)][:done]
    again.sql("INSERT INTO b VALUES (3, 'z')")
    assert rows(again.sql("SELECT id FROM b")) == [(2,), (3,)][not done :]


def test_two_writers(spark, engine):
    """Of two transactions from the same state the second to commit fails whole; a transaction sees the store as it began."""
    other = Engine(spark, engine.root)
    other.sql("BEGIN")
    other.sql("INSERT INTO a VALUES (1, 'theirs')")
    engine.sql("INSERT INTO a VALUES (2, 'ours')")
    assert rows(other.sql("SELECT id FROM a")) == [(1,)]
    with pytest.raises(ValueError, match="another writer"):
        other.sql("COMMIT")
    assert rows(other.sql("SELECT * FROM a")) == rows(engine.sql("SELECT * FROM a")) == [(2, "ours")]
    other.sql("INSERT INTO a VALUES (3, 'next')")
    assert rows(engine.sql("SELECT id, commit_ts FROM a FOR SYSTEM_TIME ALL")) == [(2, 1), (3, 2)]
    other.sql("BEGIN")
    with pytest.raises(ValueError, match="transaction is open"):
        other.sql("VACUUM a")


def test_audit(engine):
    engine.sql("SET SESSION_USER = 'ann'")
    engine.sql("INSERT INTO a VALUES (1, 'x'), (2, NULL)")
    engine.sql("FORGET KEY '1' FROM a")
    log = engine.sql("SHOW AUDIT LOG").collect()
    assert [r.what.split()[0] for r in log] == ["create", "create", "insert", "forget"] and {r.who for r in log[2:]} == {"ann"} and engine.sql("SHOW AUDIT LOG LIMIT 2").count() == 2
    assert rows(engine.sql("SELECT id FROM a FOR SYSTEM_TIME ALL")) == [(2,)] and engine.store.broken() == []
    found = Path(engine.root, "_log", f"{3:020d}.json")
    found.write_text(json.dumps(json.loads(found.read_text()) | {"who": "bob"}))
    found.with_name(f".{found.name}.crc").unlink(missing_ok=True)
    assert engine.store.broken() == [4]


def test_policies(engine):
    engine.sql("INSERT INTO a VALUES (1, 'x'), (2, 'y'), (3, 'z')")
    engine.sql("CREATE POLICY low ON a FOR SELECT TO clerk, guest USING (id < 2)")
    engine.sql("CREATE POLICY all_rows ON a TO boss USING (true)")
    read = lambda q="SELECT id FROM a": rows(engine.sql(q))
    assert read() == []
    engine.sql("SET SESSION_ROLES = 'clerk'")
    assert read() == read("SELECT id FROM a AS OF 1") == read("SELECT id FROM a FOR SYSTEM_TIME ALL") == [(1,)]
    engine.sql("SET SESSION_ROLES = 'guest, boss'")
    assert len(read()) == 3 and engine.sql("SHOW POLICIES").count() == 2
    with pytest.raises(ValueError, match="exists"):
        engine.sql("CREATE POLICY low ON a USING (true)")
    engine.sql("DROP POLICY low ON a")
    engine.sql("DROP POLICY all_rows ON a")
    engine.sql("SET SESSION_ROLES = ''")
    assert len(read()) == 3
    with pytest.raises(ValueError, match="no policy"):
        engine.sql("DROP POLICY low ON a")


def test_guides_and_shows(engine):
    engine.sql("CREATE PLAN GUIDE 'g' FOR 'SELECT a.id FROM a JOIN b ON a.id = b.id' USING 'BROADCAST(b)'")
    plan = lambda q: engine.sql(q)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("select a.id  FROM a JOIN b ON a.id = b.id") and "BroadcastHashJoin" not in plan("SELECT b.id FROM a JOIN b ON a.id = b.id")
    assert rows(engine.sql("SHOW PLAN GUIDES")) == [("g", "SELECT a.id FROM a JOIN b ON a.id = b.id", "BROADCAST(b)")]
    with pytest.raises(ValueError, match="exists"):
        engine.sql("CREATE PLAN GUIDE 'g' FOR 'SELECT 1' USING 'BROADCAST(b)'")
    engine.sql("DROP PLAN GUIDE 'g'")
    assert engine.sql("SHOW PLAN GUIDES").count() == 0
    engine.sql("INSERT INTO a VALUES (1, 'x')")
    engine.sql("EXPLAIN ANALYZE SELECT * FROM a")
    assert [r[:2] for r in rows(engine.sql("SHOW SLOW QUERIES"))] == [("SELECT * FROM a", 1)] and engine.sql("SHOW ACTIVE QUERIES").columns == ["job", "stages"]
    assert [r[:3] for r in rows(engine.sql("SHOW STATS"))] == [("a", 1, 1), ("b", 0, 1)]


def test_insights(engine):
    engine.put("k/1", "CRITICAL error: login failed")
    engine.put("k/2", "calm")
    assert [(r.bytes, r.tags) for r in engine.sql("EXPLAIN AI 'k/2'").collect()] == [(4, None)]
    for _ in range(2):  # the second run finds nothing new
        engine.observe(once=True).awaitTermination(120)
    got = engine.sql("EXPLAIN AI 'k/1'").collect()
    assert len(got) == 1 and got[0].risk >= 0.75 and got[0].tags == ["operational-error", "security"] and got[0].cluster_id and got[0].preview.startswith("CRITICAL")
    assert engine.sql("EXPLAIN AI 'nothing'").count() == 0


def test_backups(spark, engine, tmp_path):
    """Repeated rows survive; a delta adds what is newer; a damaged backup is found and not restored."""
    engine.sql("INSERT INTO a VALUES (1, 'x'), (1, 'x')")
    full, delta = str(tmp_path / "full"), str(tmp_path / "delta")
    epoch = len(engine.store.entries)
    engine.sql(f"BACKUP TO '{full}'")
    engine.sql("INSERT INTO a VALUES (2, 'y')")
    engine.sql(f"BACKUP TO '{delta}' SINCE EPOCH {epoch}")
    assert spark.read.parquet(f"{delta}/a").count() == 1 and files.restore(spark, f"{full}/a", f"{delta}/a", f"{full}/a").count() == 3
    assert {r.status for r in engine.sql(f"RESTORE FROM '{full}' DRY_RUN").collect()} == {"VALID"} and engine.sql("SELECT * FROM a FOR SYSTEM_TIME ALL").count() == 3
    engine.sql(f"RESTORE FROM '{full}'")
    assert rows(engine.sql("SELECT id, v FROM a FOR SYSTEM_TIME ALL")) == [(1, "x"), (1, "x")]
    next(p for p in Path(full, "a").glob("part-*.parquet") if spark.read.parquet(str(p)).count()).unlink()
    assert {(r.name, r.status) for r in engine.sql(f"VERIFY BACKUP '{full}'").collect()} == {("a", "ISSUES_FOUND"), ("b", "VALID")}
    with pytest.raises(ValueError, match="backup of a"):
        engine.sql(f"RESTORE FROM '{full}'")


def test_feed_after_rewrite(spark, engine, tmp_path):
    """Erasing and compaction deliver nothing again."""
    t, seen = engine.tables["a"], []
    run = lambda: feed.deliver(feed.subscribe(spark, t.path, t.schema, "", "v"), str(tmp_path / "cursor"), lambda df, _: seen.extend(r.v for r in df.collect()), once=True).awaitTermination(120)
    engine.sql("INSERT INTO a VALUES (1, 'x'), (2, 'y')")
    run()
    engine.sql("FORGET KEY '1' FROM a")
    engine.sql("VACUUM")
    engine.sql("INSERT INTO a VALUES (3, 'z')")
    run()
    assert sorted(seen) == ["x", "y", "z"] and rows(engine.sql("SELECT id FROM a")) == [(2,), (3,)]


def test_fulltext_index(spark, engine):
    """Scores through the index are those of a scan, after inserts, updates, erasing and in another engine."""
    from chronoframe.operators import text

    engine.sql("INSERT INTO a VALUES (1, 'running tests in rust'), (2, 'calm'), (3, NULL), (4, 'tests, tests and more testing')")
    engine.sql("CREATE FULLTEXT INDEX words ON a (v)")
    near = lambda df: {r.id: round(r.score, 9) for r in df.collect()}
    scan = lambda: near(text.bm25(engine.tables["a"].read().na.fill(""), "id", "v", "tested rust"))
    assert near(engine.sql("SELECT * FROM fulltext_search(a, 'tested rust')")) == scan() and set(scan()) == {1, 4}
    engine.sql("UPDATE a SET v = 'a test of rust' WHERE id = 2")
    engine.sql("DELETE FROM a WHERE id = 4")
    assert near(engine.sql("SELECT * FROM fulltext_search(a, 'tested rust')")) == scan() and set(scan()) == {1, 2}
    engine.tables["a"].forget(1)
    again = Engine(spark, engine.root)
    assert near(again.sql("SELECT * FROM fulltext_search(a, 'tested rust', 1)")) == scan() and set(scan()) == {2}
    assert again.sql("SELECT * FROM fulltext_search(a, ', .')").count() == 0
    with pytest.raises(ValueError, match="exists"):
        again.sql("CREATE FULLTEXT INDEX words ON a (v)")
    again.sql("DROP FULLTEXT INDEX words ON a")
    with pytest.raises(ValueError, match="no full-text index"):
        again.sql("SELECT * FROM fulltext_search(a, 'test')")


def test_vector_index(spark, engine):
    """Few rows are searched exactly, many through the cells, with most of the nearest found; new rows are found as well."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v").where("id < 1500")
    engine.create_table("e", "id long, v array<float>", "id").insert(e)
    engine.sql("CREATE VECTOR INDEX cells ON e (v) USING IVF_PQ WITH (nlist = 8)")
    engine.sql("INSERT INTO e VALUES (9000, '" + str([float(x) for x in e.where("id = 50").first().v]) + "')")
    hit = 0
    for q in range(50, 1500, 250):
        v = str([float(x) for x in e.where(f"id = {q}").first().v])
        got = {r.id for r in engine.sql(f"SELECT id FROM vector_search(e, v, '{v}', 10)").collect()}
        exact = {r.id for r in engine.sql(f"SELECT id, VECTOR_DISTANCE(v, '{v}', 'cosine') AS d FROM e ORDER BY d, id LIMIT 10").collect()}
        assert q in got and (q != 50 or 9000 in got)
        hit += len(got & exact)
    assert hit >= 54
    plan = lambda k: engine.sql(f"SELECT id FROM vector_search(e, v, '{v}', {k})")._jdf.queryExecution().optimizedPlan().toString()
    assert "cell#" in plan(10) and "cell#" not in plan(200)


def test_registries(spark, engine):
    """Event stores, schema versions and applied migrations outlive the engine."""
    from chronoframe.operators import catalogue, events

    stores = events.EventStores(engine)
    stores.create("orders", 10)
    schema = "aggregate_id string, event_type string, payload string, ts long, idempotency_key string"
    stores.append("orders", spark.createDataFrame([("x", "made", '{"n": 1}', 1, "k"), ("x", "paid", '{"n": 2}', 2, None), ("y", "made", "{}", 1, None)], schema))
    stores.append("orders", spark.createDataFrame([("x", "sent", '{"to": "z"}', 3, None)], schema))
    with pytest.raises(ValueError, match="idempotency"):
        stores.append("orders", spark.createDataFrame([("x", "made", "{}", 4, "k")], schema))
    again = events.EventStores(Engine(spark, engine.root))
    assert again.names() == ["orders"] and again.get("orders") == {"snapshot_interval": 10} and again.get("none") is None
    assert [(r.sequence_num, r.event_type) for r in events.history(again.events("orders"), "x").collect()] == [(1, "made"), (2, "paid"), (3, "sent")]
    assert {r.aggregate_id: r.state for r in events.fold(again.events("orders")).collect()} == {"x": {"n": "2", "to": "z"}, "y": None}

    old, new = (spark.createDataFrame([], ddl).schema for ddl in ("id int, v string", "id long, w string"))
    registry = catalogue.SchemaRegistry(engine.store)
    assert [registry.register("s", x) for x in (old, old, new)] == [1, 1, 2]
    later = catalogue.SchemaRegistry(Engine(spark, engine.root).store)
    assert later.diff("s", 1, 2) == [("added", "w"), ("modified", "id"), ("removed", "v")]

    m = catalogue.Migrations(engine.sql, engine.store)
    m.register(1, ["CREATE TABLE made (id INTEGER PRIMARY KEY, v TEXT)"], ["DROP TABLE made"])
    assert m.apply_all() == [1]
    n = catalogue.Migrations(engine.sql, Engine(spark, engine.root).store)
    assert n.applied == [1]
    with pytest.raises(ValueError, match="other statements"):
        n.register(1, ["SELECT 1"], [])
    m.rollback(1)
    assert m.pending() == [1] and "made" not in Engine(spark, engine.root).tables
