"""Labelled, mergeable metrics: histograms by bucket and counters, as rows that add up.

A row is metric, labels (k="v" in order of k), le (the bucket's upper bound; infinity: all; null: the sum of the values, in total) and n, so metrics of any two batches, streams or machines become one by adding. All
sums combine before the shuffle; a hot label set costs a row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of latencies in seconds, and of sizes in bytes.
LATENCY = tuple(0.001 * 2**k for k in range(15))
SIZE = tuple(100.0 * 2**k for k in range(15))
SCHEMA = "metric string, labels string, le double, n long, total double"


def labels_of(names: tuple[str, ...]) -> Column:
    """Label columns as text; null counts as empty, quotes and backslashes are escaped."""
    text = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), text(c), F.lit('"')) for c in sorted(names)))


def histogram(df: DataFrame, metric: str, value: str, labels: tuple[str, ...] = (), bounds: tuple[float, ...] = LATENCY) -> DataFrame:
    """Cumulative buckets of value by labels. Works on a stream, too (complete or update mode). Null values aren't counted."""
    own = F.col(value).cast("double")
    counts = [F.count_if(own <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    rows = df.where(own.isNotNull()).groupBy(labels_of(labels).alias("labels")).agg(*counts, F.count("*").alias("n"), F.sum(own).alias("total"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n"), F.lit(None).cast("double").alias("total")) for k, b in enumerate(bounds)]
    cells += [F.struct(F.lit(float("inf")).alias("le"), "n", F.lit(None).cast("double").alias("total")), F.struct(F.lit(None).cast("double").alias("le"), "n", "total")]
    return rows.select(F.lit(metric).alias("metric"), "labels", F.explode(F.array(*cells)).alias("c")).select("metric", "labels", "c.*")


def counter(df: DataFrame, metric: str, labels: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """Rows, or the sum of value, by labels."""
    amount = F.count("*").cast("double") if value is None else F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0))
    rows = df.groupBy(labels_of(labels).alias("labels")).agg(F.count("*").alias("n"), amount.alias("total"))
    return rows.select(F.lit(metric).alias("metric"), "labels", F.lit(None).cast("double").alias("le"), "n", "total")


def merged(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Metrics of several batches or streams' tables as one."""
    rows = first
    for m in more:
        rows = rows.unionByName(m)
    return rows.groupBy("metric", "labels", "le").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def quantile(metrics: DataFrame, q: float) -> DataFrame:
    """metric, labels, value: the quantile as buckets tell it, by a straight line within its bucket; the largest bound if it lies above all."""
    order = Window.partitionBy("metric", "labels").orderBy("le")  # one row a bound
    rows = metrics.where("le is not null").withColumn("all", F.max("n").over(Window.partitionBy("metric", "labels"))).withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
    hit = rows.where((F.col("n") >= F.col("all") * q) & (F.col("before") < F.col("all") * q))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("all") * q - F.col("before")) / (F.col("n") - F.col("before"))
    return hit.select("metric", "labels", F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("value"))


def increase(samples: DataFrame, value: str, at: str, interval: str, *series: str) -> DataFrame:
    """start, series, increase: by how much counters that are read off (value at a time, for each series) grew in each interval. A reading below the one before means that the counter began anew at 0.
    The first reading of a series tells no growth. Two levels: readings within an interval, then one row an interval, so a series is no one task's."""
    keys = [*series]
    rows = samples.select(*keys, F.col(at).alias("at"), F.col(value).cast("double").alias("v"), F.window(F.col(at).cast("timestamp"), interval)["start"].cast("timestamp_ntz").alias("start"))
    before = F.lag("v").over(Window.partitionBy(*keys, "start").orderBy("at", "v"))
    grown = F.when(F.col("v") >= F.col("before"), F.col("v") - F.col("before")).otherwise(F.col("v"))
    inner = rows.withColumn("before", before).groupBy(*keys, "start").agg(F.coalesce(F.sum(F.when(F.col("before").isNotNull(), grown)), F.lit(0.0)).alias("own"), F.min(F.struct("at", "v")).alias("first"), F.max(F.struct("at", "v")).alias("last"))
    ahead = F.lag("last.v").over(Window.partitionBy(*keys).orderBy("start"))
    joint = F.when(F.col("ahead").isNull(), 0.0).when(F.col("first.v") >= F.col("ahead"), F.col("first.v") - F.col("ahead")).otherwise(F.col("first.v"))
    return inner.withColumn("ahead", ahead).select("start", *keys, (F.col("own") + joint).alias("increase"))


def lines(metrics: DataFrame) -> DataFrame:
    """The metrics as lines of text (line), as scrapers read them."""
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    comma = F.when(F.col("labels") == "", "").otherwise(F.concat("labels", F.lit(",")))
    bucket = F.concat("metric", F.lit("_bucket{"), comma, F.lit('le="'), le, F.lit('"} '), F.col("n").cast("string"))
    total = F.concat("metric", F.lit("{"), "labels", F.lit("} "), F.col("total").cast("string"))
    return metrics.select(F.when(F.col("le").isNotNull(), bucket).otherwise(total).alias("line"))
