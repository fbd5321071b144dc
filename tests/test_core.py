"""Operators of the core library on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoframe.functions import scalar
from chronoframe.operators import catalogue, events, graph, ledger, risk, temporal, text, timeseries, vectorized, vectors
from chronoframe.plans import catalog
from chronoframe.plans.engine import Engine
from chronoframe.sources import files
from chronoframe.streaming import feed

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    got = one(
        spark, scalar.trim_all(lit(" \t x y\n")), scalar.concat_skip(lit("a"), lit(None).cast("string"), lit("b")), scalar.split_part(lit("a,b"), ",", 0), scalar.split_part(lit("a,b"), ",", 9),
        scalar.initcap_words(lit("  hello   wORLD ")), scalar.sqrt_safe(lit(-1.0)), scalar.log_base10(lit(1000.0)), scalar.log_base10(lit(0.0)), scalar.length_bytes(lit("é")), F.length(scalar.repeat_capped(lit("a"), lit(10**6))),
    )
    assert list(got) == ["x y", "ab", "", "", "Hello World", None, 3.0, None, 2, 10_000]


def test_exp_and_rounding_as_in_sql(spark, tmp_path):
    """The exponential to the last bit and scaled rounding, also where keys are large: 60 times the keys of sf0.1."""
    import duckdb

    orders = spark.range(0, 900_000, 61).selectExpr("id AS o_orderkey", "id AS o_custkey", "100000D + id / 7 AS o_totalprice").union(spark.createDataFrame([(1_000_000, None, None)], "o_orderkey long, o_custkey long, o_totalprice double"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.sql(f"SELECT o_orderkey, ex, sq, lg, l FROM ({catalog.oracle_sql()['fn_numeric']})").fetchall()
    assert rows(catalog.queries()["fn_numeric"](spark, str(tmp_path)).select("o_orderkey", "ex", "sq", "lg", "l")) == sorted(want, key=str)
    sql = Engine(spark, "").sql
    assert rows(sql("SELECT exp(1000), exp(NULL), isnan(exp(double('nan'))), typeof(round(1.25, 1)), round(exp(0), 3)")) == [(float("inf"), None, True, "decimal", 1.0)]
    assert rows(sql("SELECT transform(array(0D, NULL), x -> round(exp(x), 2)) AS a")) == [([1.0, None],)]


@pytest.mark.parametrize(("given", "seconds"), [("1s", 1), ("5m", 300), ("1h", 3600), ("7d", 604800), ("1w", 604800), ("3600", 3600), ("250ms", 1), ("2500ms", 2)])
def test_intervals(given, seconds):
    assert scalar.interval_seconds(given) == seconds


@pytest.mark.parametrize("given", ["invalid", "", "0s", "5y"])
def test_bad_intervals(given):
    with pytest.raises(ValueError):
        scalar.interval_seconds(given)


def test_json(spark):
    j = F.lit('{"a": {"b": [1, 2]}, "s": "x", "t": true, "n": null}')
    got = one(spark, scalar.json_get(j, "s"), scalar.json_text(j, "s"), scalar.json_type(j), scalar.json_type(F.lit("[1]")), scalar.json_type(F.lit("3")), scalar.json_type(F.lit("null")), scalar.json_type(F.lit("oops")), scalar.json_contains(j, {"s": "x", "t": True}), scalar.json_contains(j, {"s": "y"}))
    assert list(got) == ['"x"', "x", "object", "array", "number", "null", None, True, False]


VERSIONS = [("k", 1, 1, 0, 100, False), ("k", 2, 5, 100, 200, False), ("k", 3, 9, 0, temporal.FOREVER, True), ("m", 7, 4, 0, temporal.FOREVER, False)]


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(VERSIONS, "pk string, v int, commit_ts long, valid_from long, valid_to long, is_deleted boolean")


@pytest.mark.parametrize(
    ("as_of", "valid_at", "want"),
    [(None, None, {"m": 7}), (5, None, {"k": 2, "m": 7}), (4, None, {"k": 1, "m": 7}), (5, 50, {"k": 1, "m": 7}), (5, 150, {"k": 2, "m": 7}), (5, 100, {"k": 2, "m": 7}), (5, 200, {"m": 7}), (9, 50, {"m": 7}), (0, None, {})],
)
def test_visibility(versions, as_of, valid_at, want):
    assert {r.pk: r.v for r in temporal.visible(versions, as_of, valid_at).collect()} == want


def test_temporal_ranges(versions):
    at = lambda df: sorted(r.v for r in df.collect())
    assert at(temporal.system_time(versions, 5, 9)) == [2, 7] and at(temporal.system_time(versions, 5, 9, closed=True)) == [2, 3, 7]
    assert at(temporal.application_time(versions, 100, 150)) == [2, 3, 7]


@pytest.mark.parametrize("kind", ["long", "timestamp"])
def test_asof_join(spark, kind):
    """Against a search row by row: a hot key, gaps over many ranges, equal times, times before all and after all, nulls."""
    import random

    r = random.Random(4)
    left = [(i, "hot" if i % 3 else f"k{i % 4}", r.randrange(-50, 4000)) for i in range(400)] + [(900, None, 5), (901, "hot", None), (902, "alone", 7)]
    right = [("hot" if i % 2 else f"k{i % 5}", r.randrange(0, 400) * (1 if i % 7 else 9), i) for i in range(200)] + [("hot", None, -1), (None, 3, -2)]
    a = spark.createDataFrame(left, "id int, k string, t long").withColumn("t", F.col("t").cast(kind))
    b = spark.createDataFrame(right, "k string, u long, v int").withColumn("u", F.col("u").cast(kind))
    got = temporal.asof_join(a, b, "k", "t", "u", "v", "found")
    assert got.columns == ["id", "k", "t", "found"]
    want = {i: max(((u, v) for j, u, v in right if j == k and None not in (t, u) and u <= t), default=(0, None))[1] for i, k, t in left}
    assert {x.id: x.found for x in got.collect()} == want
    assert temporal.asof_join(a, b.limit(0), "k", "t", "u", "v", "found").where("found is not null").count() == 0 and temporal.asof_join(a.limit(0), b, "k", "t", "u", "v", "found").count() == 0


def test_timeseries(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 120, 4.0), ("b", 60, 5.0)], "s string, bucket long, v double")
    full = timeseries.gapfill(df, "1m", "bucket", "s")
    assert rows(full) == [("a", 0, 1.0), ("a", 120, 4.0), ("a", 60, None), ("b", 60, 5.0)]
    assert rows(timeseries.locf(full, "v", "bucket", "s"))[2] == ("a", 60, 1.0)
    assert rows(timeseries.interpolate(full, "v", "bucket", "s"))[2] == ("a", 60, 2.5)
    assert rows(timeseries.rate(timeseries.delta(df, "v", "bucket", "s"), "v", "bucket", "s"))[1] == ("a", 120, 4.0, 3.0, 0.025)


def test_text(spark):
    df = spark.createDataFrame([(1, "Rust programming language"), (2, "Python for data science"), (3, None)], "id int, t string")
    assert [r.id for r in df.where(text.matches(F.col("t"), "programs languages")).collect()] == []
    assert [r.id for r in df.where(text.matches(F.col("t"), "programming")).collect()] == [1]
    assert [r.id for r in df.where(text.matches(F.col("t"), "")).collect()] == []
    got = one(spark, text.highlight(F.lit("running the  tests, now"), "test"), text.stems(F.lit("nations kindness glasses boxes a it's")))
    assert got[0] == "running the <<tests,>> now" and got[1] == ["nation", "kind", "glass", "box", "its"]
    assert [r.id for r in text.bm25(df.na.drop(), "id", "t", "data").collect()] == [2]


def test_text_queries_take_whole_tables(spark, tmp_path):
    """Stems and marks of every document, ids of 50 and more, empty, null and long texts too, against plain Python."""
    import re

    def stem(w):
        for longer, ends, cut in ((5, ("tion", "ness", "ment"), 4), (5, ("ing",), 3), (4, ("ed", "ly", "es"), 2)):
            if len(w) > longer and w.endswith(ends):
                return w[:-cut]
        return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w

    bare = lambda w: re.sub(r"[\W_]", "", w).lower()
    docs = [(0, "the  Licensed works"), (4, None), (5, "Licenses, and licensing!"), (49, ""), (50, "running tests under a License"), (1000, "漢字 Größe " + "licensed words " * 500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.marked for r in catalog.queries()["fts_highlight"](spark, str(tmp_path)).collect()}
    wanted = {stem(w) for w in ("licensing", "licenses", "licensed")}
    assert got == {i: None if t is None else " ".join(f"<<{w}>>" if stem(bare(w)) in wanted else w for w in t.split()) for i, t in docs}
    got = {r.doc_id: r.stems for r in catalog.queries()["fts_stems"](spark, str(tmp_path)).collect()}
    assert got == {i: " ".join(stem(x) for x in map(bare, (t or "").split()) if len(x.encode()) >= 2) or None for i, t in docs}


def test_highlight_takes_marks_from_the_text_at_once(spark):
    """Odd words against each word's own stem; no expression for each word where no word can fit."""
    words = ["Li-censed", "licenses", "LICENSEES", "licensss", "licenstion", "lic.ens", "licens", "--", "license\u00a0x", "\u212aelvin", "kelvins", "licenſes", "x\tlicensing", "\n", "ΣΑΣ.", "İlicens", "l\u0301icenses", "licenseds", "sublicensed", "<<licensed>>", "𝒜 licens🙂ing", "kelvined"]
    texts = [(0, None), (1, ""), (2, "  "), (3, " ".join(words)), (4, "\x0b".join(words) + " "), *((5 + i, f" {w}\r\n{w}") for i, w in enumerate(words))]
    df = spark.createDataFrame(texts, "id int, t string")
    for query in ("licensing licenses licensed", "kelvin", "", "- ,"):
        wanted = text.stems(F.lit(query))
        each = F.filter(F.split("t", r"\s+"), lambda w: w != "")
        want = F.array_join(F.transform(each, lambda w: F.when(F.array_contains(wanted, text.stem(F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))), F.concat(F.lit("<<"), w, F.lit(">>"))).otherwise(w)), " ")
        assert rows(df.select("id", text.highlight(F.col("t"), query))) == rows(df.select("id", want))
        df.createOrReplaceTempView("odd_words")
        assert rows(Engine(spark, "").sql(f"SELECT id, HIGHLIGHT(t, '{query}') AS m FROM odd_words")) == rows(df.select("id", want))
    plan = df.select(text.highlight(F.col("t"), "licensed"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") and "regexp_replace(lambda" not in plan


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert list(one(spark, vectors.euclidean(a, b), vectors.cosine_distance(a, b), vectors.negative_dot(a, a), vectors.norm(a))) == [5.0, 1.0, -25.0, 5.0]
    assert [(r.id, r["rank"]) for r in vectors.search(df, "id", "v", [1.0, 0.1, 0.0], 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    r = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    s = {x.id: x.score for x in vectors.reciprocal_rank_fusion(r, r.where("id = 2"), "id").collect()}
    assert abs(s[1] - 1 / 61) < 1e-12 and abs(s[2] - 2 / 62) < 1e-12


def test_ivf_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vectors.InvertedFile(e, "vec_id", "embedding", 8)
    hit = 0
    for q in range(5):
        v = [float(x) for x in e.where(f"vec_id = {q}").first().embedding]
        exact = {r.vec_id for r in vectors.search(e, "vec_id", "embedding", v, 10, "euclidean").collect()}
        hit += len(exact & {r.vec_id for r in index.search(v, 10, 6).collect()})
    assert hit >= 40


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
def test_ivf_search_in_blocks(spark, metric, monkeypatch):
    """All cells against each pair's own distance: equal vectors, other lengths, nulls, infinite and empty ones; and no join of single rows."""
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    v = lambda i: [float((i * 7 + j * 3) % 11) + (1e-9 if i % 3 else 0.0) for j in range(4)]
    data = [(i, v(i % 40)) for i in range(200)] + [(200, [1.0, 2.0]), (201, None), (202, [1.0, None, 2.0, 3.0]), (203, [0.0] * 4), (250, [2.0, 1.0]), (350, [])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    index = vectors.InvertedFile(df.where("id < 200"), "id", "v", 4)
    index.rows = df.withColumn("cell", index.cell())
    asked = df.where("id % 50 = 0 or id = 203")
    got = index.search_all(asked, 10, 4, metric)
    pairs = asked.select(F.col("id").alias("query"), F.col("v").alias("q")).crossJoin(df).select("query", "id", vectors.METRICS[metric](F.col("v"), F.col("q")).alias("distance")).where("distance is not null")
    from pyspark.sql import Window as W

    want = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where("rank <= 10")
    assert rows(got) == rows(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cells_and_codes_of_odd_vectors(spark):
    """Numbers of nearest centres against each centre's own distance, and not by an expression for each number of each centre."""
    inf, nan = float("inf"), float("nan")
    data = [[float(i % 3), 1.0, float(i % 5), 2.0] for i in range(30)] + [None, [], [1.0], [1.0, 2.0, 0.0], [1.0, None, 4.0, 2.0], [9.0] * 6, [inf, 0.0, nan, 0.0], [nan] * 4]
    df = spark.createDataFrame(list(enumerate(data)), "id int, v array<float>")
    even = df.where("id < 30")
    index, codes = vectors.InvertedFile(even, "id", "v", 3), vectors.ProductQuantizer(even, "id", "v", 2, 4)
    near = lambda v, centres: F.array_sort(F.array(*(F.struct(vectors.euclidean(v, vectors.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres.tolist()))))["i"]
    v = F.col("v")
    want = df.select("id", near(v, index.centres)[0], F.array(*(near(F.slice(v, 2 * p + 1, 2), c)[0] for p, c in enumerate(codes.centres))))
    assert rows(df.select("id", index.cell(), codes.encode(v))) == rows(want)
    assert rows(index._asked(df.withColumn("id", v.isNull()), 2).select("cells")) == rows(df.select(F.slice(near(v, index.centres), 1, 2)))
    assert "lambdafunction" not in df.select(index.cell(), codes.encode(v))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ivf_query_recall(spark, sf):
    """The registered search, for every id divisible by 50, against brute force."""
    import numpy as np

    d = f"/root/testdata/{sf}"
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, v = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    got = {}
    for r in catalog.queries()["vec_ivf"](spark, d).collect():
        got.setdefault(r.query, set()).add(r.vec_id)
    queries = [i for i in ids if i % 50 == 0]
    assert set(got) == set(queries)
    hit = sum(len(got[i] & set(ids[((v - v[ids == i]) ** 2).sum(1).argsort(kind="stable")[:10]])) for i in queries)
    assert hit >= 0.9 * 10 * len(queries)


def test_risk_clusters_as_in_sql(spark, tmp_path):
    """Changes of one minute, risk and tags, of which only one is an error; a change without a type."""
    import duckdb

    made = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, element_at(array('view', 'error', NULL, 'click'), int(id % 4) + 1) AS event_type FROM range(400)")
    made.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("risk_cluster_summary", "risk_insights", "risk_quick"):
        want = con.sql(catalog.oracle_sql()[name]).fetchall()
        assert sorted((a, float(b)) for a, b in catalog.queries()[name](spark, str(tmp_path)).collect()) == sorted((a, float(b)) for a, b in want)


def test_approx_distinct_keeps_a_sketch_a_group(spark, tmp_path):
    spark.sql("SELECT CASE WHEN id % 3 > 0 THEN 'F' WHEN id % 2 > 0 THEN 'O' END AS o_orderstatus, nullif(id % 1000, 7) AS o_custkey FROM range(9000) UNION ALL SELECT 'P', NULL").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["agg_approx_distinct"](spark, str(tmp_path))
    assert rows(got) == rows(spark.read.parquet(f"{tmp_path}/orders.parquet").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey"), F.lit(True)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and all("approx_count_distinct" not in line for line in plan.splitlines() if "o_custkey" in line.partition("[")[2].partition("]")[0])


def test_hierarchy_of_all_customers(spark):
    got = {r.id: r.depth for r in catalog.queries()["cte_hierarchy"](spark, SF).collect()}
    want = {0: 0}
    for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").orderBy("c_custkey").collect():
        if (r.c_custkey - 1) // 3 in want:
            want[r.c_custkey] = want[(r.c_custkey - 1) // 3] + 1
    assert got == want
    many = spark.range(1, 1501).withColumnRenamed("id", "c_custkey")
    many.createOrReplaceTempView("customer")
    from chronoframe.plans import relational

    assert spark.sql(relational.texts("cte_hierarchy")[0]).count() == 1501


def test_events(spark):
    schema = "aggregate_id string, event_type string, payload string, ts long, idempotency_key string"
    store = events.append(spark.createDataFrame([], f"{schema}, sequence_num long"), spark.createDataFrame([("a", "made", '{"x": 1, "y": 2}', 1, "k1"), ("a", "changed", '{"x": 5}', 2, None), ("b", "made", "{}", 1, None)], schema))
    state = {r.aggregate_id: r for r in events.fold(store).collect()}
    assert state["a"].state == {"x": "5", "y": "2"} and (state["a"].last_event_type, state["a"].sequence_num) == ("changed", 2) and state["b"].state is None
    more = events.append(store, spark.createDataFrame([("a", "changed", '{"y": 9}', 3, "k2")], schema))
    assert [r.sequence_num for r in events.history(more, "a", 2).collect()] == [2, 3]
    assert events.fold(more, events.snapshot(store.where("aggregate_id = 'a'"))).where("aggregate_id = 'a'").first().state == {"x": "5", "y": "9"}
    with pytest.raises(ValueError, match="idempotency"):
        events.append(store, spark.createDataFrame([("a", "x", "{}", 4, "k1")], schema))


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("E", "A")], "from_id string, to_id string")
    assert {(r.id, r.depth) for r in graph.bfs(edges, "A", 5).collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2), ("E", 3)}
    assert graph.shortest_path(edges, "A", "E") == ["A", "B", "D", "E"] and graph.shortest_path(edges, "A", "Z") is None
    assert graph.dfs(edges, "A", 9) == [("A", 0), ("B", 1), ("D", 2), ("E", 3), ("C", 1)]
    assert graph.counts(edges) == (5, 6) and rows(graph.neighbors(edges, "A")) == [("B",), ("C",), ("E",)]


def test_risk(spark):
    got = one(spark, *(F.round(risk.quick_score(F.lit(t)), 6) for t in ("CRITICAL error: system failed", '{"status":"timeout"}', "hello world")))
    assert got[0] >= 0.75 and 0 < got[1] < 0.75 and got[2] == 0
    got = one(spark, risk.tags(F.lit("Login failed after deploy")), risk.tags(F.lit("calm")), F.round(risk.score(F.lit("Login failed")), 6))
    assert list(got) == [["operational-error", "release-signal", "security"], ["general-observation"], 0.7]


def test_ledger(spark, tmp_path):
    t = ledger.Ledger(spark, str(tmp_path / "t"), "id string, balance double", "id")
    frame = lambda *r: spark.createDataFrame(r, "id string, balance double")
    t.insert(frame(("a", 1000.0), ("b", 500.0)))
    t.update(F.col("id") == "a", {"balance": F.col("balance") - 100})
    t.delete(F.col("id") == "b")
    assert rows(t.read()) == [("a", 900.0)] and rows(t.read(as_of=1)) == [("a", 1000.0), ("b", 500.0)]
    t.begin()
    t.insert(frame(("c", 1.0)))
    t.savepoint("s")
    t.insert(frame(("d", 2.0)))
    assert t.read().count() == 3
    t.rollback_to("s")
    epoch = t.commit()
    assert rows(t.read()) == [("a", 900.0), ("c", 1.0)]
    t.upsert(frame(("c", 9.0), ("e", 3.0)))
    t.upsert(frame(("c", 9.0)), {"balance": F.lit(7.0)})
    assert rows(t.read()) == [("a", 900.0), ("c", 7.0), ("e", 3.0)] and rows(t.read_epoch(epoch)) == [("a", 900.0), ("c", 1.0)]
    t.begin()
    t.insert(frame(("z", 0.0)))
    t.rollback()
    with pytest.raises(ValueError, match="no transaction"):
        t.commit()
    files.backup(t.versions(), str(tmp_path / "full"))
    files.backup(t.versions(), str(tmp_path / "delta"), since_commit=4)
    assert rows(temporal.visible(files.restore(spark, str(tmp_path / "full"), str(tmp_path / "delta")), key="id").select("id", "balance")) == rows(t.read())
    assert files.verify_backup(spark, str(tmp_path / "full")).first().status == "VALID"
    t.forget("a")
    assert t.versions().where("id = 'a'").count() == 0
    t.vacuum(t.clock)
    assert rows(t.read()) == [("c", 7.0), ("e", 3.0)] and t.versions().count() == 2
    assert ledger.create_as(spark, str(tmp_path / "copy"), t.read(), "id").read().count() == 2


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    t = e.create_table("items", "id int, title string, vec array<double>, props string", "id")
    t.insert(spark.createDataFrame([(1, "running tests", [1.0, 0.0], '{"k": 3}'), (2, "calm", [0.0, 1.0], '{"k": 4}')], "id int, title string, vec array<double>, props string"))
    t.update(F.col("id") == 2, {"title": F.lit("tested twice")})
    assert rows(e.sql("SELECT id FROM items WHERE MATCH(title, 'test')")) == [(1,), (2,)]
    assert rows(e.sql("SELECT id FROM items AS OF 1 WHERE MATCH(title, 'test')")) == [(1,)]
    assert rows(e.sql("SELECT count(*) FROM items FOR SYSTEM_TIME ALL")) == [(3,)]
    assert rows(e.sql("SELECT id, round(vec <-> '[1.0, 0.0]', 3) AS d FROM items WHERE id = 1")) == [(1, 0.0)]
    assert rows(e.sql("SELECT props -> 'k', props ->> 'k' FROM items WHERE id = 2")) == [("4", "4")]
    assert rows(e.sql("SELECT HIGHLIGHT(title, 'test') FROM items WHERE id = 1")) == [("running <<tests>>",)]
    assert rows(e.sql("SELECT id FROM items WHERE id = $1", 2)) == [(2,)] and rows(e.sql("SELECT LOG(100)")) == [(2.0,)]
    assert rows(e.sql("SHOW TABLES")) == [("items",)] and e.describe("items").count() == 4 and "Scan" in e.explain("SELECT * FROM items", analyze=True).first().plan
    e.put("a/1", "x")
    e.put("a/2", "y")
    e.put("b/1", "z")
    assert e.get("a/1") == "x" and e.get("a/2", as_of=1) is None and [r.pk for r in e.scan_prefix("a/").collect()] == ["a/1", "a/2"]
    with pytest.raises(ValueError, match="did you mean items"):
        e.drop_table("item")


@pytest.mark.parametrize("kind", ["csv", "json", "ndjson", "parquet"])
def test_files(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'quote " and, comma', 1.5), (2, "line", None)], "id long, name string, value double")
    files.copy_to(df, str(tmp_path / "f"), kind)
    back = files.copy_from(spark, str(tmp_path / "f"), kind, "id").select(F.col("id").cast("long"), "name", F.col("value").cast("double"))
    assert rows(back) == rows(df)


def test_read_functions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age\nx,3\n,\n")
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    e = Engine(spark, str(tmp_path / "root"))
    assert rows(e.sql(f"SELECT name, age FROM read_csv('{tmp_path}/a.csv')")) == [("x", 3), (None, None)]
    assert rows(e.sql(f"SELECT a FROM read_json('{tmp_path}/a.json')")) == [(1,), (2,)]


def test_catalogue(spark):
    ran = []
    m = catalogue.Migrations(ran.append)
    m.register(2, ["b"], ["b-"])
    m.register(1, ["a"], ["a-"])
    assert m.apply_all() == [1, 2] and m.pending() == []
    m.rollback(2)
    assert ran == ["a", "b", "b-"] and m.pending() == [2]
    with pytest.raises(ValueError):
        m.apply(1)
    log = catalogue.AuditLog(spark)
    for w in "abc":
        log.add(w, f"did {w}")
    assert log.broken(log.frame()).count() == 0
    assert [r.seq for r in log.broken(log.frame().withColumn("what", F.when(F.col("seq") == 2, "lied").otherwise(F.col("what")))).collect()] == [2]
    p = catalogue.Policies()
    p.create("own", "t", {"user"}, F.col("id") == 1)
    assert p.apply(spark.range(3), "t", {"user"}).count() == 1 and p.apply(spark.range(3), "t", {"guest"}).count() == 0 and p.apply(spark.range(3), "u", set()).count() == 3
    assert catalogue.suggest_index("SELECT a FROM t WHERE b = 1 AND c > 2 ORDER BY d DESC", {"b"}) == ["c", "d"]


def test_streams(spark, tmp_path):
    t = ledger.Ledger(spark, str(tmp_path / "t"), "pk string, doc string", "pk")
    frame = lambda *r: spark.createDataFrame(r, "pk string, doc string")
    t.insert(frame(("feed/1", "a"), ("other/1", "b")))
    seen = []
    run = lambda: feed.deliver(feed.subscribe(spark, t.path, t.schema, "feed/"), str(tmp_path / "cursors/c1"), lambda df, _: seen.extend(r.pk for r in df.collect()), once=True).awaitTermination(120)
    run()
    t.insert(frame(("feed/2", "c")))
    run()
    assert seen == ["feed/1", "feed/2"] and feed.cursors(spark, str(tmp_path / "cursors")) == ["c1"]
    assert feed.delete_cursor(spark, str(tmp_path / "cursors"), "c1") and feed.cursors(spark, str(tmp_path / "cursors")) == []
    g = feed.ConsumerGroup(5)
    g.join("x")
    g.join("y")
    assert (g.assignment("x"), g.assignment("y"), g.generation) == ([0, 2, 4], [1, 3], 2)


def test_anomalies(spark, tmp_path):
    times = [i * 1000 for i in range(400)] + [400_000 + i for i in range(0, 10_001, 10)]
    df = spark.createDataFrame([("t", t) for t in times], "name string, at_ms long")
    batch = feed.anomalies_batch(df, 2.5).collect()
    assert len(batch) >= 1 and batch[0].rate > 50
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = feed.anomalies(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w")), 2.5)
    stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.table("found")) == rows(feed.anomalies_batch(df, 2.5))


def test_vectorized(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y")], "j int, v string")
    assert vectorized.hash_join(a, b, "k", "j").first().asDict() == {"k": 1, "v": "x", "v__right": "y"}


def test_every_query_has_columns(spark):
    """All queries analyse, and names with SQL are names of queries."""
    known = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(known) and len(known) > 110
    for name in ("agg_pricing_summary", "bt_bitemporal", "ts_gapfill", "fts_bm25", "join_asof"):
        assert known[name](spark, SF).count() > 0


def test_statements(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    run = lambda q, *a: rows(e.sql(q, *a))
    e.sql("CREATE TABLE IF NOT EXISTS users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER, twice INTEGER GENERATED ALWAYS AS (age * 2) STORED)")
    e.sql("INSERT INTO users (id, name, age) VALUES (1, 'Alice, A', 30), (2, 'Bob', 25)")
    assert run("SELECT * FROM users") == [(1, "Alice, A", 30, 60), (2, "Bob", 25, 50)]
    assert run("INSERT INTO users (id, name, age) VALUES (3, 'Eve', 32) RETURNING id, age + 1 AS next") == [(3, 33)]
    e.sql("INSERT INTO users (id, name, age) VALUES (3, 'Other', 1) ON CONFLICT (id) DO NOTHING")
    e.sql("INSERT INTO users (id, name, age) VALUES (2, 'x', 1) ON CONFLICT (id) DO UPDATE SET name = 'Robert'")
    assert run("UPDATE users SET age = age + 1 WHERE id = 1 RETURNING age") == [(31,)]
    e.sql("DELETE FROM users WHERE id = 3")
    assert run("SELECT id, name, age FROM users") == [(1, "Alice, A", 31), (2, "Robert", 25)]
    assert run("SELECT count(*) FROM users AS OF 1") == [(2,)]
    e.sql("BEGIN")
    e.sql("INSERT INTO users (id, name, age) VALUES (9, 'Z', 9)")
    e.sql("ROLLBACK")
    assert run("SELECT count(*) FROM users") == [(2,)]
    e.sql("ALTER TABLE users ADD COLUMN city TEXT")
    e.sql("ALTER TABLE users RENAME COLUMN name TO label")
    e.sql("ALTER TABLE users DROP COLUMN twice")
    assert run("SELECT id, label, city FROM users") == [(1, "Alice, A", None), (2, "Robert", None)]
    e.sql("CREATE VIEW old AS SELECT id FROM users WHERE age > 30")
    assert run("SELECT * FROM old") == [(1,)]
    e.sql(f"COPY users TO '{tmp_path}/u' FORMAT CSV")
    e.sql("CREATE TABLE again (id INTEGER PRIMARY KEY, label TEXT)")
    e.sql(f"COPY again FROM '{tmp_path}/u' FORMAT CSV")
    assert run("SELECT * FROM again") == [(1, "Alice, A"), (2, "Robert")]
    e.sql(f"BACKUP TO '{tmp_path}/b'")
    e.sql("DELETE FROM again")
    e.sql(f"RESTORE FROM '{tmp_path}/b'")
    assert run("SELECT count(*) FROM again") == [(2,)] and {r.status for r in e.sql(f"VERIFY BACKUP '{tmp_path}/b'").collect()} == {"VALID"}
    e.sql("CREATE TABLE copy AS SELECT id, label FROM users")
    assert run("DESCRIBE copy") == [("id", "bigint", True), ("label", "string", False)] and e.sql("ANALYZE copy").count() == 2
    with pytest.raises(ValueError):
        e.sql("CREATE TABLE users (id INTEGER PRIMARY KEY, x TEXT)")


def test_sql_series_and_vectors(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.sql("CREATE TIMESERIES TABLE m (id INTEGER PRIMARY KEY, ts INTEGER, value REAL) WITH (bucket_size='1m')")
    e.sql("INSERT INTO m VALUES (1, 5, 1.0), (2, 10, 3.0), (3, 130, 5.0)")
    run = lambda q: rows(e.sql(q))
    assert run("SELECT TIME_BUCKET('1m', ts) AS b, avg(value) AS v FROM m GROUP BY TIME_BUCKET('1m', ts)") == [(0, 2.0), (120, 5.0)]
    q = "SELECT TIME_BUCKET_GAPFILL('1m', ts) AS b, {0} AS v FROM m GROUP BY TIME_BUCKET_GAPFILL('1m', ts)"
    assert run(q.format("avg(value)")) == [(0, 2.0), (120, 5.0), (60, None)] and run(q.format("LOCF(avg(value))"))[2] == (60, 2.0) and run(q.format("INTERPOLATE(avg(value))"))[2] == (60, 3.5)
    assert run("SELECT FIRST(value, ts) AS f, LAST(value, ts) AS l, STRING_AGG(id, '-') AS s FROM m") == [(1.0, 5.0, "1-2-3")]
    e.sql("CREATE TABLE items (id INTEGER PRIMARY KEY, vec VECTOR(3))")
    e.sql("INSERT INTO items VALUES (1, '[1,0,0]'), (2, '[0,1,0]')")
    assert run("SELECT id, COSINE_SIMILARITY(vec, '[1,0,0]') AS c, VECTOR_DIMS(vec) AS d, VECTOR_NORM(vec) AS n FROM items WHERE id = 1") == [(1, 1.0, 3, 1.0)]
    assert [r.id for r in e.sql("SELECT id FROM vector_search(items, vec, '[0,1,0]', 1)").collect()] == [2]


def test_quantizers_and_registry(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    pq = vectors.ProductQuantizer(e, "vec_id", "embedding", 16, 32)
    q = [float(x) for x in e.where("vec_id = 0").first().embedding]
    coded = e.select("vec_id", "embedding", pq.encode(F.col("embedding")).alias("c"))
    same = coded.select(F.abs(pq.distance(F.col("c"), q) - vectors.euclidean(pq.decode(F.col("c")), vectors.literal(q))).alias("d")).agg(F.max("d")).first()[0]
    assert same < 1e-6
    near = coded.select(F.avg(vectors.euclidean(pq.decode(F.col("c")), F.col("embedding")) / vectors.norm(F.col("embedding")))).first()[0]
    assert near < 0.8
    r = catalogue.ModelRegistry()
    assert (r.register("m"), r.register("m")) == (1, 2) and r.production("m") is None
    r.promote("m", 1)
    r.promote("m", 2)
    r.observe("m", 2, 1.0)
    r.observe("m", 2, 2.0)
    assert r.production("m") == 2 and rows(catalogue.table_of(r, spark)) == [("m", 1, "archived", 0, 0.0), ("m", 2, "production", 2, 1.5)]
    assert one(spark, risk.flatten_json(F.lit('{"b": [1, {"c": "x"}], "a": null}')))[0] == "a=null b[0]=1 b[1].c=x"


def test_dialect(spark, tmp_path):
    """Functions in this engine's meaning, by name and number of arguments; quotes, comments and lambdas are left alone."""
    e = Engine(spark, str(tmp_path))
    one = lambda x: rows(e.sql(f"SELECT {x} FROM (SELECT 'é' AS s, ' a  b\tc ' AS w, '{{\"a\":{{\"b\":[1,\"x\",null]}},\"t\":true}}' AS j, array(1, 2) AS v, 3661 AS ts)"))[0][0]
    for x, want in [
        ("LENGTH(s)", 2), ("TRIM(w)", "a  b\tc"), ("LTRIM(w)", "a  b\tc "), ("RTRIM(w)", " a  b\tc"), ("CONCAT(s, NULL, '!')", "é!"), ("SUBSTR('abc', 0, 2)", "ab"), ("SUBSTR('abc', -5)", "abc"),
        ("SPLIT_PART('a,b', ',', 0)", ""), ("SPLIT_PART('a,b', ',', 2)", "b"), ("SPLIT_PART('a,b', ',', 9)", ""), ("INITCAP(w)", "A B C"), ("STRPOS('hay', 'y')", 3), ("POSITION('hay', 'q')", 0), ("position('y' IN 'hay')", 3),
        ("SQRT(-1)", None), ("SQRT(16)", 4.0), ("LOG(1000)", 3.0), ("LOG(2, 8)", 3.0), ("LOG(0)", None), ("IIF(true, 1, 2)", 1), ("TYPEOF(1)", "number"), ("TYPEOF('a')", "text"), ("TYPEOF(NULL)", "null"), ("TYPEOF(1.5)", "decimal"),
        ("EPOCH(ts)", 3661), ("EPOCH() > 1000", True), ("EXTRACT('minute', ts)", 1), ("EXTRACT('week', ts)", 1), ("EXTRACT('dow', ts)", 4), ("EXTRACT('none', ts)", 0), ("extract(YEAR FROM CAST(ts AS TIMESTAMP))", 1970),
        ("EPOCH(DATE_ADD(ts, 39))", 3700), ("EPOCH(DATE_SUB(ts, 61))", 3600), ("EPOCH(MAKE_TIMESTAMP(5))", 5), ("TO_CHAR(CAST(2 AS DOUBLE))", "2"), ("TO_CHAR(2.5)", "2.5"), ("CAST(MAKE_INTERVAL(90) AS STRING) LIKE '%01:30%'", True),
        ("JSON_EXTRACT(j, 'a')", '{"b":[1,"x",null]}'), ("JSON_TYPE(j)", "object"), ("JSON_TYPE('[1]')", "array"), ("JSON_TYPE('{')", None), ("j ->> 't'", "true"), ("'[1,2]' -> 1", "2") if False else ("j -> 't'", "true"),
        ("j @> '{\"a\":{\"b\":[\"x\"]}}'", True), ("j @> '{\"a\":{\"b\":[2]}}'", False), ("j @> '{\"a\":{\"b\":[null, 1]}, \"t\":true}'", True), ("j @> '{\"t\":\"true\"}'", False),
        ("VECTOR_DISTANCE('[1,0]', '[0,1]', 'cosine')", 1.0), ("VECTOR_DISTANCE('[1,2]', '[3,4]', 'dot')", -11.0), ("VECTOR_DISTANCE('[0,0]', '[3,4]')", 5.0), ("'LOG(1) a -> b -- c'", "LOG(1) a -> b -- c"), ("STRING_AGG(DISTINCT s)", "é"),
        ("transform(v, x -> 'k')", ["k", "k"]), ("transform(v, j -> 'k')", ["k", "k"]), ("size(filter(v, x -> LENGTH('a') = 1)) /* LOG( */", 2), ("CONCAT('it''s', ' (', 'x)')", "it's (x)"),
    ]:
        got = one(x)
        assert got == want or isinstance(want, float) and abs(got - want) < 1e-9, (x, got)
    assert rows(e.sql("SELECT first(c, true), FIRST(c, d) FROM VALUES (1, 2), (3, 1) t(c, d)")) == [(1, 3)]
    with pytest.raises(ValueError, match="no metric"):
        e.sql("SELECT VECTOR_DISTANCE('[1]', '[2]', 'mile')")


def test_gapfill_before_limit(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("m", "id int, ts long, value double", "id").insert(spark.createDataFrame([(1, 0, 1.0), (2, 180, 4.0)], "id int, ts long, value double"))
    query = "SELECT TIME_BUCKET_GAPFILL('1m', ts) AS b, LOCF(max(value)) AS v FROM m GROUP BY b ORDER BY b DESC LIMIT 3"
    assert e.sql(query).collect() == [(180, 4.0), (120, 1.0), (60, 1.0)]
