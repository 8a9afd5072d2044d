"""Structured Streaming: ingest into Parquet or a managed log, a monitor of a log, counts by event time with late data, and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditarium.functions.model import ERROR
from auditarium.sources import managed, manifest


def _timed(ev: DataFrame) -> DataFrame:
    """ev with a time that has a zone (UTC sessions): watermarks ask for one."""
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(ev: DataFrame, interval: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Events and errors of each interval and segment; a closed interval is final after late. Partial sums combine before the shuffle."""
    return _timed(ev).withWatermark("ts", late).groupBy(F.window("ts", interval), "segment").agg(F.count("*").alias("events"), F.count_if(F.col("level") >= ERROR).alias("errors")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "segment", "events", "errors")


def sessions(ev: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each entity: events no more than gap apart (an extension)."""
    return _timed(ev).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "entity_id").agg(F.count("*").alias("events")).select("session_window.start", "session_window.end", "entity_id", "events")


def alerts(ev: DataFrame, threshold: int) -> DataFrame:
    """A row for each time a segment's errors reach the threshold; the count begins anew. State is one number for each segment."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        total += sum(int((f["level"] >= ERROR).sum()) for f in frames)
        state.update((total % threshold,))
        if total >= threshold:
            yield pd.DataFrame({"segment": [key[0]], "alerts": [total // threshold]})

    return ev.select("segment", "level").groupBy("segment").applyInPandasWithState(step, "segment long, alerts long", "errors long", "append", GroupStateTimeout.NoTimeout)


def ingest(ev: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts writing a stream of events as Parquet, by day. Restarting with the same checkpoint goes on without loss or repeats.

    every: a processing time for the trigger; None takes what is there and ends."""
    out = ev.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def append(ev: DataFrame, path: str, checkpoint: str, name: str = "stream", segment_bytes: int = 64 << 20, every: str | None = None):
    """Starts appending a stream of events (ts, event_data, flags) to a managed log: a generation a batch, sequences in order of time behind the log's last one.

    A batch that the log has already (the query ended between the log's commit and its own) is told by its number and changes nothing. Each batch is put down beside the checkpoint
    first, so that numbering and writing see the same rows; the one before is removed."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # the stream's own
        if manifest.load(path).epochs.get(name, -1) >= number:
            return
        own = f"{checkpoint.rstrip('/')}-batches/{number}"
        batch.select("ts", "event_data", "flags").write.mode("overwrite").parquet(own)
        rows = spark.read.schema(batch.select("ts", "event_data", "flags").schema).parquet(own)
        managed.append(managed.numbered(rows, path), path, segment_bytes, name, number)
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-batches/{number - 1}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    out = ev.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def totals(rec: DataFrame) -> DataFrame:
    """Records, damaged runs and bytes of a stream of a log's records (source.follow) so far: state is one row."""
    bad = F.col("parse_error").isNotNull()
    return rec.agg(F.count_if(~bad).alias("records"), F.count_if(bad).alias("errors"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)).alias("bytes"), F.max(F.when(~bad, F.col("sequence"))).alias("last_sequence"))


def monitor(rec: DataFrame, checkpoint: str, tell, every: str | None = None):
    """Starts telling the totals of a log's stream: tell gets a row (records, errors, bytes, last_sequence) after each batch. A restart with the same checkpoint goes on counting."""
    out = totals(rec).writeStream.outputMode("complete").foreachBatch(lambda batch, number: tell(batch.first())).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def replicate(ev: DataFrame, targets: dict[str, str], checkpoint: str):
    """Starts copying a stream to several Parquet targets; each batch has a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        for path in targets.values():
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ev.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
