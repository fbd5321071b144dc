"""Graph traversal over edges (from_id, to_id[, edge_type]). Frontiers are joined level by level; visited nodes drop out by anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def out_edges(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("from_id") == node)


def in_edges(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("to_id") == node)


def neighbors(edges: DataFrame, node: object) -> DataFrame:
    """Nodes that an edge leads to from ``node``, or from which one leads to it."""
    return out_edges(edges, node).select(F.col("to_id").alias("id")).union(in_edges(edges, node).select(F.col("from_id").alias("id"))).distinct()


def bfs(edges: DataFrame, start: object, max_depth: int, until: object = None) -> DataFrame:
    """(id, depth, path) of the nodes within ``max_depth``; each by its first visit, of equally short paths the least.

    Lineage is cut after each level, so the plan of a level is one join and one anti join.
    """
    spark = edges.sparkSession
    links = edges.select("from_id", "to_id").distinct()
    kind = edges.schema["from_id"].dataType
    level = spark.createDataFrame([(str(start),)], "x string").select(F.col("x").cast(kind).alias("id"), F.lit(0).alias("depth"), F.array(F.col("x").cast("string")).alias("path"))
    seen = level
    for depth in range(1, max_depth + 1):
        found = level.join(links, level["id"] == links["from_id"]).select(F.col("to_id").alias("id"), F.concat("path", F.array(F.col("to_id").cast("string"))).alias("path"))
        found = found.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        level = cut(found.select("id", F.lit(depth).alias("depth"), "path"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
        if until is not None and not level.where(F.col("id") == until).isEmpty():
            break
    return seen


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a single machine without the setting (tests) gets one of its own; a cluster raises."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="chronoframe-"))
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shortest_path(edges: DataFrame, start: object, end: object, max_depth: int = 32) -> list[str] | None:
    """The ids on a shortest path; None if there is none within ``max_depth``."""
    found = bfs(edges, start, max_depth, until=end).where(F.col("id") == end).select("path").first()
    return list(found[0]) if found else None


def dfs(edges: DataFrame, start: object, max_depth: int, most: int = 100_000) -> list[tuple[object, int]]:
    """Preorder (id, depth), smaller ids first. A sequential walk: the nodes within reach must be at most ``most``, else ValueError."""
    reach = bfs(edges, start, max_depth).select("id")
    near = edges.join(reach.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id").distinct().limit(most + 1).collect()
    if len(near) > most:
        raise ValueError("too many edges within reach for a sequential walk")
    after: dict[object, list] = {}
    for a, b in near:
        after.setdefault(a, []).append(b)
    out, stack, seen = [], [(start, 0)], set()
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((node, depth))
        if depth < max_depth:
            stack.extend((x, depth + 1) for x in sorted(after.get(node, []), reverse=True))
    return out


def counts(edges: DataFrame) -> tuple[int, int]:
    """(nodes, edges)."""
    nodes = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    return nodes.count(), edges.count()
