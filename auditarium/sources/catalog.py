"""Catalogs of segments: listing, refreshing, persisting; and JSON-line files of backends."""

from __future__ import annotations

import re
from datetime import datetime
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditarium.operators.replay import replay
from auditarium.sources.wal import store_of


def discover(spark: SparkSession, path: str, pattern: str = "*.wal") -> DataFrame:
    """path, created_at, size, sealed of a log's segments, from the listing alone (no content is read). All but the newest are sealed.

    Its window runs over files, which are few beside records."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("created_at"), F.col("length").alias("size"))
    newest = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("path")))
    return found.withColumn("sealed", newest > 1)


def refresh(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """catalog with sizes as listed now; corrupted where the file is gone."""
    now = listing.select("path", F.col("size").alias("now"))
    return catalog.drop("corrupted").join(now, "path", "left").withColumn("corrupted", F.col("now").isNull()).withColumn("size", F.coalesce("now", "size")).drop("now")


def with_records(catalog: DataFrame, rec: DataFrame) -> DataFrame:
    """catalog with first and last sequences and times, counts and damage of each segment's records."""
    good = F.col("parse_error").isNull()
    info = rec.groupBy("path").agg(
        F.min(F.when(good, F.col("sequence"))).alias("start_seq"), F.max(F.when(good, F.col("sequence"))).alias("end_seq"), F.min(F.when(good, F.col("ts_nanos"))).alias("start_nanos"), F.max(F.when(good, F.col("ts_nanos"))).alias("end_nanos"),
        F.count_if(good).alias("record_count"), (F.count_if(~good) > 0).alias("damaged"),
    )
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return catalog.withColumn("path", name(F.col("path"))).join(info, "path", "left")


def save_index(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """What save_index wrote: no log is read again."""
    return spark.read.parquet(path)


def add(catalog: DataFrame, more: DataFrame) -> DataFrame:
    return catalog.unionByName(more, allowMissingColumns=True)


def remove(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("path").distinct(), "path", "left_anti")


_NAME_TIME = re.compile(r"audit-(\d{8}-\d{6})")


def lines_until(path: str, end=None, pattern: str = "audit-*.json*") -> list[str]:
    """A backend's files that may hold events up to end: those that name a later beginning (audit-YYYYMMDD-HHMMSS) don't."""
    store, base = store_of(path)
    until = None if end is None else end if isinstance(end, datetime) else datetime.fromisoformat(str(end))
    out = []
    for f in store.get_file_info(fs.FileSelector(base)):
        if f.type != fs.FileType.File or not fnmatch(f.base_name, pattern):
            continue
        m = _NAME_TIME.match(f.base_name)
        if until is None or not m or datetime.strptime(m[1], "%Y%m%d-%H%M%S") <= until:
            out.append(f"{path.rstrip('/')}/{f.base_name}")
    return sorted(out)


def read_lines(spark: SparkSession, path: str, schema: str, start=None, end=None, pattern: str = "audit-*.json*") -> DataFrame:
    """JSON lines of a backend (gzip by name), between start and end, both exclusive; files that begin later are not read, lines that are no JSON have _corrupt."""
    paths = lines_until(path, end, pattern)
    full = f"{schema}, _corrupt string"
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(paths) if paths else spark.createDataFrame([], full)
    return replay(rows, start, end, "exclusive")


def line_report(rows: DataFrame) -> DataFrame:
    """Rows, verified and corrupted ones (no JSON, or no time) of each file and of all (file null)."""
    bad = F.col("_corrupt").isNotNull() | F.col("ts").isNull()
    rows = rows.select(F.input_file_name().alias("file"), bad.alias("bad"))
    return rows.rollup("file").agg(F.count("*").alias("total"), F.count_if(~F.col("bad")).alias("verified"), F.count_if("bad").alias("corrupted"))
