"""Reading and writing files, and backups of ledgers."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoframe.sources import paths


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header row; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.option("multiLine", True).json(path)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "json": read_json, "ndjson": read_ndjson, "parquet": read_parquet}


def copy_to(df: DataFrame, path: str, kind: str) -> None:
    """Write as csv (header, RFC 4180 quotes), json or ndjson (a line per row), or parquet."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif kind in ("json", "ndjson"):
        writer.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def copy_from(spark: SparkSession, path: str, kind: str, key: str = "pk") -> DataFrame:
    """Rows of files; a missing key becomes ``row_<n>``, numbered as Spark numbers rows."""
    df = spark.read.json(path) if kind == "json" else READERS[kind](spark, path)
    made = F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string"))
    return df.withColumn(key, F.coalesce(F.col(key).cast("string"), made) if key in df.columns else made)


def _measured(rows: DataFrame) -> tuple[int, int]:
    got = rows.agg(F.count("*"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()
    return got[0], int(got[1] or 0)


def backup(ledger: DataFrame, path: str, since_commit: int | None = None) -> None:
    """All versions, or those newer than a commit timestamp, and a manifest of what was written."""
    rows = ledger if since_commit is None else ledger.where(F.col("commit_ts") > since_commit)
    rows.write.mode("overwrite").parquet(path)
    n, checksum = _measured(ledger.sparkSession.read.schema(rows.schema).parquet(path))
    manifest = {"rows": n, "checksum": str(checksum), "since": since_commit, "schema": rows.schema.jsonValue()}
    paths.write_text(ledger.sparkSession, f"{path}/_manifest.json", json.dumps(manifest))


def restore(spark: SparkSession, *folders: str) -> DataFrame:
    """A full backup with the deltas after it, in order; of each delta, what is newer than all before it. Rows that repeat stay."""
    rows = spark.read.parquet(folders[0])
    for folder in folders[1:]:
        last = rows.agg(F.max("commit_ts")).first()[0]
        rows = rows.unionByName(spark.read.parquet(folder).where(F.col("commit_ts") > (last if last is not None else -1)))
    return rows


def verify_backup(spark: SparkSession, path: str) -> DataFrame:
    """(status, n_rows, checksum, issues) of a backup: VALID if it holds the rows that its manifest counts, with their checksum."""
    n = checksum = None
    if not paths.exists(spark, f"{path}/_manifest.json"):
        issues = "no manifest"
    else:
        manifest = json.loads(paths.read_text(spark, f"{path}/_manifest.json"))
        try:
            n, checksum = _measured(spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(path))
            issues = "" if n == manifest["rows"] else f"{manifest['rows']} rows expected"
            issues = issues or ("" if str(checksum) == manifest["checksum"] else "rows differ")
        except PySparkException as e:
            issues = f"can't be read: {type(e).__name__}"
    return spark.createDataFrame([("ISSUES_FOUND" if issues else "VALID", n, None if checksum is None else str(checksum), issues)], "status string, n_rows long, checksum string, issues string")
