"""Rows in files: JSON lines with a schema, append-only versions with digests, telemetry spans and metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a schema; a line that doesn't fit stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_digest(df: DataFrame) -> F.Column:
    """SHA-256 of a row as JSON, columns in order."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table whatever its order: two 64-bit sums over row digests."""
    half = lambda a: F.sum(F.conv(F.substring("_d", a, 12), 16, 10).cast("decimal(38,0)"))
    return df.withColumn("_d", row_digest(df)).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", half(1).cast("string"), half(13).cast("string")), 256).alias("digest"))


def append_version(df: DataFrame, path: str, key: str, on_existing: str = "version") -> int:
    """Write df as the next version of key under path, with its digest beside it; 'refuse' fails if there is one."""
    spark = df.sparkSession
    last = latest_version(spark, path, key)
    if last and on_existing == "refuse":
        raise FileExistsError(f"{key} has version {last}")
    version = last + 1
    df.write.parquet(f"{path}/data/key={key}/version={version}")
    table_digest(df).withColumn("key", F.lit(key)).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/manifest")
    return version


def latest_version(spark: SparkSession, path: str, key: str) -> int:
    """The highest version in the manifest, which is written last: data without an entry doesn't count."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/manifest").where(F.col("key") == key).agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def read_version(spark: SparkSession, path: str, key: str, version: int | None = None) -> DataFrame:
    """A version (the latest by default), checked against its digest."""
    version = version or latest_version(spark, path, key)
    df = spark.read.parquet(f"{path}/data/key={key}/version={version}")
    want = spark.read.parquet(f"{path}/manifest").where((F.col("key") == key) & (F.col("version") == version)).first()
    if want is None or table_digest(df).first()["digest"] != want["digest"]:
        raise ValueError(f"{key} version {version} doesn't match its manifest")
    return df


def damaged_replicas(replicas: DataFrame) -> DataFrame:
    """(path, replica, source) of replicas(replica, path, digest, expected, mtime) to repair: copies that differ, and the newest good copy."""
    good = replicas.where("digest = expected").groupBy("path").agg(F.max(F.struct("mtime", "replica")).alias("_g"))
    return replicas.where("digest is null or digest <> expected").join(good, "path", "left").select("path", "replica", F.col("_g.replica").alias("source"))


def spans(df: DataFrame, name: str | None = None, trace_id: str | None = None, **attributes: str) -> DataFrame:
    """Spans(name, trace_id, span_id, parent_id, attributes map) that fit every given filter."""
    for column, value in (("name", name), ("trace_id", trace_id)):
        if value is not None:
            df = df.where(F.col(column) == value)
    for k, v in attributes.items():
        df = df.where(F.col("attributes")[k] == v)
    return df


def children(df: DataFrame, parents: DataFrame) -> DataFrame:
    p = parents.select(F.col("span_id").alias("parent_id"), "trace_id").distinct()
    return df.join(p, ["parent_id", "trace_id"], "left_semi")


def metric_points(lines: DataFrame) -> DataFrame:
    """(name, attributes, value) of the last exported snapshot: lines(time, resource array<scope array<metric array<point>>>) flattened."""
    last = lines.orderBy(F.col("time").desc()).limit(1)
    m = last.select(F.explode("resource").alias("r")).select(F.explode("r").alias("s")).select(F.explode("s").alias("m"))
    return m.select(F.col("m.name").alias("name"), F.explode("m.points").alias("p")).select("name", "p.attributes", "p.value")


def replay(df: DataFrame, time: str = "ts") -> DataFrame:
    """df with offset_seconds from the recording's first row."""
    first = df.agg(F.min(time).alias("_first"))
    return df.join(F.broadcast(first), F.lit(True)).withColumn("offset_seconds", (F.unix_micros(F.col(time)) - F.unix_micros("_first")) / 1_000_000).drop("_first")
