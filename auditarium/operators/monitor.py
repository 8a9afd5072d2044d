"""Monitoring: throughput, growth, health, breakers, latencies. Global windows run over buckets (rows of time), never over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions.model import ERROR


def buckets(ev: DataFrame, interval: str) -> DataFrame:
    """Events and errors of each tumbling interval that has any."""
    at = F.date_trunc(interval, "ts").cast("timestamp_ntz")
    return ev.groupBy(at.alias("bucket")).agg(F.count("*").alias("events"), F.count_if(F.col("level") >= ERROR).alias("errors"))


def silence(ev: DataFrame, interval: str, seconds: int) -> DataFrame:
    """buckets with silent_seconds: whole seconds between a bucket's last event and its end."""
    at = F.date_trunc(interval, "ts").cast("timestamp_ntz")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = ev.groupBy(at.alias("bucket")).agg(F.count("*").alias("events"), F.count_if(F.col("level") >= ERROR).alias("errors"), F.max("ts").alias("last"))
    return rows.withColumn("silent_seconds", ((micros("bucket") + seconds * 1_000_000 - micros("last")) / 1_000_000).cast("long")).drop("last")


def throughput(counts: DataFrame, seconds: int, slots: int = 60) -> DataFrame:
    """Events a second over the last slots buckets, silent ones left out."""
    last = Window.orderBy("bucket").rowsBetween(-(slots - 1), 0)
    return counts.withColumn("throughput", F.round(F.avg(F.nullif("events", F.lit(0))).over(last) / seconds, 9))


def growth(counts: DataFrame, seconds: int) -> DataFrame:
    """Change from bucket to bucket, and a second."""
    before = F.lag("events").over(Window.orderBy("bucket"))
    return counts.withColumn("delta", F.col("events") - before).withColumn("rate", F.round((F.col("events") - before) / float(seconds), 9))


def health(stats: DataFrame) -> DataFrame:
    """stats (events, errors, silent_seconds, throughput) with error_rate, integrity_score, status and issues."""
    rate = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("events")), F.lit(0.0))
    issue = lambda when, text: F.when(when, F.lit(text))
    issues = F.array_compact(F.array(issue(rate > 0.5, "error rate over 50%"), issue((rate > 0.05) & (rate <= 0.5), "error rate over 5%"), issue(F.col("silent_seconds") > 300, "no events for 5 minutes"), issue(F.col("throughput") == 0, "no throughput")))
    status = F.when(rate > 0.5, "unhealthy").when(F.size(issues) > 0, "degraded").otherwise("healthy")
    return stats.withColumn("error_rate", F.round(rate, 9)).withColumn("integrity_score", F.round(F.greatest(F.lit(0.0), 100 * (1 - rate)), 6)).withColumn("status", status).withColumn("issues", F.array_join(issues, "; "))


def success_rates(log: DataFrame, *keys: str) -> DataFrame:
    """Calls, failures and success rate (0 if none) of an operation log with ok."""
    return log.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.coalesce(F.round(F.try_divide(F.count_if("ok").cast("double"), F.count("*")), 9), F.lit(0.0)).alias("success_rate"))


def percentiles(df: DataFrame, value: str, *keys: str, exact: bool = True) -> DataFrame:
    """p50, p99 and p999 of value: exact ones from value counts (combined before the shuffle), or sketches."""
    at = (0.5, 0.99, 0.999)
    f = (lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")) if exact else (lambda p: F.percentile_approx(value, p, 100_000))
    return df.groupBy(*keys).agg(*(f(p).alias(n) for p, n in zip(at, ("p50", "p99", "p999"), strict=True)))


def histogram(df: DataFrame, value: str, least: float, n: int = 15) -> DataFrame:
    """Cumulative counts of value up to least * 2^k, k = 0..n-1, and of all (k = n)."""
    bounds = F.array(*(F.lit(float(least * 2**k)) for k in range(n)))
    k = F.size(F.filter(bounds, lambda b: b < F.col(value)))
    counts = df.where(F.col(value).isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("own"))
    every = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("k"))
    return F.broadcast(every).join(counts, "k", "left").select("k", F.sum(F.coalesce("own", F.lit(0))).over(Window.orderBy("k")).alias("n"))


def alerts(counts: DataFrame, threshold: int) -> DataFrame:
    """Buckets in which the errors since the last alert reach the threshold; the count begins anew after each."""
    total = F.sum("errors").over(Window.orderBy("bucket"))
    rows = counts.withColumn("total", total).withColumn("due", F.floor(F.col("total") / threshold))
    return rows.withColumn("before", F.coalesce(F.floor((F.col("total") - F.col("errors")) / threshold), F.lit(0))).where("due > before").select("bucket", "errors", "total", (F.col("due") - F.col("before")).alias("alerts"))


def breaker(log: DataFrame, max_failures: int = 5, reset_seconds: float = 60.0) -> DataFrame:
    """State changes of each component's circuit breaker: component, at, state. log: component, at (seconds), ok.

    Closed opens after max_failures failures with no success between; open lets one call pass after reset_seconds (half-open), which closes or opens it.
    Components are independent; a component's calls come to its task in time order, batch by batch, and only the state is kept."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, failures, opened = None, "closed", 0, 0.0
        for pdf in batches:
            out = []
            for component, at, ok in pdf[["component", "at", "ok"]].itertuples(index=False):
                if component != name:
                    name, state, failures, opened = component, "closed", 0, 0.0
                if state == "open":
                    if at - opened < reset_seconds:
                        continue  # refused
                    state = "half-open"
                    out.append((name, at, state))
                if ok:
                    failures = 0
                    if state == "half-open":
                        state = "closed"
                        out.append((name, at, state))
                else:
                    failures += 1
                    if state == "half-open" or failures >= max_failures:
                        state, opened, failures = "open", at, 0
                        out.append((name, at, state))
            yield pd.DataFrame(out, columns=["component", "at", "state"])

    rows = log.select("component", F.col("at").cast("double").alias("at"), F.col("ok").cast("boolean").alias("ok"))
    return rows.repartition("component").sortWithinPartitions("component", "at").mapInPandas(walk, "component string, at double, state string")
