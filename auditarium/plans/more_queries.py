"""Queries over blocks of shadows, holds, key epochs, metrics, and what the first catalogue left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditarium.functions import checksum
from auditarium.functions.events import decode, typed
from auditarium.functions.session import shared_dir
from auditarium.operators import blocks, compliance, holds, metrics, recover
from auditarium.plans.catalogue import AS_OF, END, EV, SEG, START, _damage, _sunk, simple, stream_of, table, written_log
from auditarium.sources import catalog, export, wal
from auditarium.streaming import live

BLOCK, EPOCH, CUTOFF = 512, 700, "2024-01-20 00:00:00"


def _compared(ev: DataFrame) -> DataFrame:
    """Bytes by kind of a log's files that were damaged, against a copy from before."""
    spark, path = ev.sparkSession, written_log(ev)
    found = [p for p, _ in wal.files(path, ".wal")]
    shadow = shared_dir(spark, "shadow")

    def copy(batches):
        store, base = wal.store_of(shadow)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with store.open_input_file(found[k]) as a, store.open_output_stream(f"{base}/{found[k].rpartition('/')[2]}") as b:
                    b.write(a.read())
            yield batch

    spark.range(0, len(found), 1, len(found)).mapInArrow(copy, "id long").count()
    hit = list(dict.fromkeys((found[0], found[-1])))
    spark.range(0, len(hit), 1, len(hit)).mapInArrow(lambda batches: _damage(path, hit, batches), "id long").count()
    rows = blocks.differences(spark, path, shadow, BLOCK)
    return rows.groupBy(F.split("name", "-")[0].cast("long").alias("segment"), "kind").agg(F.sum(F.col("end") - F.col("start")).alias("bytes"))


_PLACES = f""", placed AS (SELECT *, sum(size) OVER (PARTITION BY segment ORDER BY sequence) - size AS begins FROM ev),
  hits AS (SELECT DISTINCT segment, (begins + CASE sequence WHEN 5 THEN 65 WHEN 10 THEN 13 ELSE 40 END) // {BLOCK} AS block FROM placed WHERE sequence IN (5, 10, 15)),
  sized AS (SELECT s.segment, s.size - CASE WHEN s.segment = (SELECT max(segment) FROM ev) THEN (SELECT size - 67 FROM ev ORDER BY sequence DESC LIMIT 1) ELSE 0 END AS n FROM seg s),
  changed AS (SELECT segment, n, {BLOCK} * (SELECT count(*) FROM hits h WHERE h.segment = sized.segment) + CASE WHEN segment = (SELECT max(segment) FROM ev) THEN n % {BLOCK} ELSE 0 END AS c FROM sized)"""
simple("shadow_blocks", "SELECT segment, kind, bytes::BIGINT AS bytes FROM (SELECT segment, 'changed' AS kind, c AS bytes FROM changed UNION ALL SELECT segment, 'same', n - c FROM changed) WHERE bytes > 0", _compared, SEG + _PLACES)


def _holds(spark: SparkSession, d: str) -> DataFrame:
    """A sign-up holds its user's events for three days, and each thousandth event all events for an hour."""
    rows = table(spark, d, "events")
    own = rows.where("event_type = 'signup' and event_id % 10 = 0").select("event_id", F.col("user_id").cast("string").alias("entity_id"), "ts", F.expr("ts + interval 3 days").alias("end"))
    every = rows.where("event_id % 1000 = 7").select("event_id", F.lit(None).cast("string").alias("entity_id"), "ts", F.expr("ts + interval 1 hour").alias("end"))
    return own.unionByName(every).select(F.col("event_id").alias("hold_id"), "entity_id", F.col("ts").alias("start"), "end")


def _events(spark: SparkSession, d: str) -> DataFrame:
    from auditarium.plans.catalogue import events

    return events(spark, d)


_HELD = f"""{EV}, holds AS (SELECT event_id AS hold_id, user_id::VARCHAR AS entity_id, ts AS start, ts + INTERVAL 3 DAY AS until FROM events WHERE event_type = 'signup' AND event_id % 10 = 0
  UNION ALL SELECT event_id, NULL, ts, ts + INTERVAL 1 HOUR FROM events WHERE event_id % 1000 = 7),
  held AS (SELECT e.sequence, h.hold_id FROM ev e JOIN holds h ON e.ts BETWEEN h.start AND h.until AND (h.entity_id IS NULL OR h.entity_id = e.entity_id))"""
simple("holds_of_events", f"WITH {_HELD} SELECT sequence, hold_id FROM held", lambda spark, d: holds.held(_events(spark, d), _holds(spark, d)), "")
simple("disposable_events", f"WITH {_HELD} SELECT sequence FROM ev WHERE ts < '{CUTOFF}' AND sequence NOT IN (SELECT sequence FROM held)", lambda spark, d: holds.disposable(_events(spark, d), _holds(spark, d), CUTOFF).select("sequence"), "")


def _epochs(ev: DataFrame) -> DataFrame:
    """Records sealed by the key of their epoch, and opened again; keys begin at each second epoch."""
    spark = ev.sparkSession
    last = ev.count() // EPOCH
    keys = spark.range(0, last + 1, 2).select(F.col("id").alias("first_epoch"), F.unhex(F.sha2(F.concat(F.lit("key"), "id").cast("binary"), 256)).alias("key"))
    named = keys.select(F.substring(F.sha2("key", 256), 1, 16).alias("key_id"), "key", "first_epoch")
    rows = compliance.unprotect(compliance.protect_by_epoch(ev, keys, EPOCH), named)
    return rows.select("sequence", "epoch", F.col("first_epoch").alias("key_epoch"), F.col("opened").cast("string").alias("opened"))


simple("key_epochs", f"SELECT sequence, (row_number() OVER (ORDER BY segment, sequence) - 1) // {EPOCH} AS epoch, (row_number() OVER (ORDER BY segment, sequence) - 1) // {EPOCH} // 2 * 2 AS key_epoch, event_data AS opened FROM ev", _epochs)


def _metrics(ev: DataFrame) -> DataFrame:
    """Histograms and counters of two halves of the log, taken by themselves and added."""
    parts = [ev.where(f"sequence % 2 = {k}") for k in (0, 1)]
    found = [metrics.histogram(p, "event_value", "value", ("event_type", "level")).unionByName(metrics.histogram(p, "event_bytes", "size", ("event_type",), metrics.SIZE)).unionByName(metrics.counter(p, "events", ("level",))) for p in parts]
    return metrics.merged(*found).select("metric", "labels", F.coalesce(F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.round("le", 3).cast("string")), F.lit("")).alias("le"), "n", F.round("total", 3).alias("total"))


def _bounds(metric: str, value: str, labels: str, bounds: tuple[float, ...]) -> str:
    rows = " UNION ALL ".join([f"SELECT {b!r}::DOUBLE AS le" for b in bounds])
    name = "CASE WHEN le = 'infinity' THEN '+Inf' ELSE round(le, 3)::VARCHAR END"
    return (
        f"SELECT '{metric}' AS metric, {labels} AS labels, {name} AS le, count(*) FILTER ({value} <= le) AS n, NULL::DOUBLE AS total FROM ev, ({rows} UNION ALL SELECT 'infinity'::DOUBLE) b WHERE {value} IS NOT NULL GROUP BY ALL "
        f"UNION ALL SELECT '{metric}', {labels}, '', count(*), round(sum({value}), 3)::DOUBLE FROM ev WHERE {value} IS NOT NULL GROUP BY ALL"
    )


_BY_TYPE, _BY_LEVEL = """'event_type="' || event_type || '"'""", """'level="' || level || '"'"""
simple("metrics_merged", f"{_bounds('event_value', 'value', _BY_TYPE + chr(32) + '||' + chr(39) + ',' + chr(39) + '||' + _BY_LEVEL, metrics.LATENCY)} UNION ALL {_bounds('event_bytes', 'size', _BY_TYPE, metrics.SIZE)} UNION ALL SELECT 'events', {_BY_LEVEL}, '', count(*), count(*)::DOUBLE FROM ev GROUP BY ALL", _metrics)
simple(
    "counter_increase",
    "SELECT start, series, sum(grown)::DOUBLE AS increase FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, sequence % 3 AS series, CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END AS grown FROM (SELECT *, sequence % 500 AS v, lag(sequence % 500) OVER (PARTITION BY sequence % 3 ORDER BY ts, sequence % 500) AS b FROM ev)) GROUP BY ALL",
    lambda ev: metrics.increase(ev.select((F.col("sequence") % 3).alias("series"), "ts", (F.col("sequence") % 500).alias("v")), "v", "ts", "1 day", "series").select("start", "series", "increase"),
)


def _decoded(ev: DataFrame) -> DataFrame:
    """Events that were written as JSON, their properties in their types."""
    spark, path = ev.sparkSession, shared_dir(ev.sparkSession, "wal")
    body = F.to_json(F.struct(F.col("level").alias("Level"), F.concat(F.lit("{user} did "), "event_type").alias("MessageTemplate"), F.struct(F.col("entity_id").cast("long").alias("user"), "value", (F.col("sequence") % 2 == 0).alias("even"), F.col("event_type").alias("kind")).alias("Properties")))
    wal.write_log(ev.withColumn("event_data", body), path)
    rows = decode(wal.read_log(spark, path))
    return rows.select("sequence", "level", "message_template", typed("user", "long").alias("user_id"), F.round(typed("value", "double"), 6).alias("value"), typed("even", "boolean").alias("even"), typed("kind", "string").alias("kind"), typed("kind", "long").alias("no_number"), F.col("properties")["even"].alias("as_text"))


def _array(ev: DataFrame) -> DataFrame:
    path = shared_dir(ev.sparkSession, "array")
    export.export_array(ev.select("sequence", "level", "event_type"), path)
    return ev.sparkSession.read.text(path).select(F.col("value").alias("line"))


simple("event_decode", "SELECT sequence, level, '{user} did ' || event_type AS message_template, entity_id::BIGINT AS user_id, round(value, 6) AS value, sequence % 2 = 0 AS even, event_type AS kind, NULL::BIGINT AS no_number, (sequence % 2 = 0)::VARCHAR AS as_text FROM ev", _decoded)
simple("export_array", """SELECT CASE WHEN sequence = min(sequence) OVER () THEN '[' ELSE '' END || '{"sequence":' || sequence || ',"level":' || level || ',"event_type":"' || event_type || '"}' || CASE WHEN sequence = max(sequence) OVER () THEN ']' ELSE ',' END AS line FROM ev""", _array)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are over by the watermark: no event of the entity for a day, ten minutes before the latest of all."""
    return _sunk(live.sessions(stream_of(spark, d), "1 day", "10 minutes"), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "entity_id", "events")


def _replicated(spark: SparkSession, d: str) -> DataFrame:
    """What two targets of a replicated stream hold."""
    targets = {k: shared_dir(spark, f"target-{k}") for k in ("a", "b")}
    live.replicate(stream_of(spark, d, 2).select("sequence", "event_data"), targets, shared_dir(spark, "checkpoint")).awaitTermination()
    first, second = (spark.read.parquet(f"{path}/batch=*").select(F.lit(k).alias("target"), "sequence", "event_data") for k, path in targets.items())
    return first.unionByName(second)


def _pruned(ev: DataFrame) -> DataFrame:
    """A backend's files by day, of which those that begin after the range are not read: the events in it, and how many files were."""
    spark, path = ev.sparkSession, shared_dir(ev.sparkSession, "backend")
    days = shared_dir(spark, "days")
    ev.select(F.to_json(F.struct("sequence", "ts")).alias("value"), F.date_format("ts", "yyyyMMdd").alias("day")).repartition("day").write.partitionBy("day").text(days)
    names = [(r["path"], r["day"]) for r in spark.read.format("binaryFile").load(days).select("path", F.col("day").cast("string").alias("day")).collect()]  # a row a file

    def move(batches):
        source, base = wal.store_of(days)[0], wal.store_of(path)[1]
        source.create_dir(base, recursive=True)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with source.open_input_file(wal.store_of(names[k][0])[1]) as a, source.open_output_stream(f"{base}/audit-{names[k][1]}-000000.jsonl") as b:
                    b.write(a.read())
            yield batch

    spark.range(0, len(names), 1, len(names)).mapInArrow(move, "id long").count()
    read = catalog.lines_until(path, END)
    return catalog.read_lines(spark, path, "sequence long, ts timestamp_ntz", START, END).select("sequence", F.lit(len(read)).cast("long").alias("files"))


def _plausible(ev: DataFrame) -> DataFrame:
    """Records that a recovery may believe: of these times, with known flags, of JSON."""
    spark, path = ev.sparkSession, shared_dir(ev.sparkSession, "wal")
    odd = F.when(F.col("sequence") % 5 == 0, F.lit("{no json")).otherwise(F.to_json(F.struct("sequence")))
    late = F.when(F.col("sequence") % 7 == 0, F.col("ts") - F.expr("interval 11 years")).otherwise(F.col("ts"))
    wal.write_log(ev.withColumn("event_data", odd).withColumn("ts", late).withColumn("flags", F.when(F.col("sequence") % 11 == 0, 64).otherwise(F.col("flags"))), path)
    return recover.plausible(wal.read_log(spark, path), AS_OF).select("sequence")


def _mismatched(spark: SparkSession, d: str) -> DataFrame:
    """The first checksum that isn't the stored one: each fifth item's CRC32C was stored wrong, each third one's CRC32."""
    rows = table(spark, d, "benchmark").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id"))).withColumn("data", F.col("text").cast("binary"))  # a benchmark's items are few
    wrong = lambda c, n: F.when(F.col("k") % n == 0, c + 1).otherwise(c)
    return rows.select("item_id", checksum.first_mismatch(F.col("data"), {"CRC32C": wrong(checksum.crc32c(F.col("data")), 5), "CRC32": wrong(F.crc32("data"), 3)}).alias("first"))


_DAY = "INTERVAL 1 DAY"
simple("stream_sessions", f"WITH {EV}, s AS (SELECT *, coalesce(ts > lag(ts) OVER w + {_DAY}, true) AS opens FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts)), n AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY entity_id ORDER BY ts) AS k FROM s), r AS (SELECT min(ts) AS start, max(ts) + {_DAY} AS \"end\", entity_id, count(*) AS events FROM n GROUP BY entity_id, k) SELECT * FROM r WHERE \"end\" <= date_trunc('millisecond', (SELECT max(ts) FROM ev)) - INTERVAL 10 MINUTE", _sessions, "")
simple("stream_replicas", f"WITH {EV} SELECT t.target, sequence, event_data FROM ev, (VALUES ('a'), ('b')) t(target)", _replicated, "")
simple("backend_files_pruned", f"SELECT sequence, (SELECT count(DISTINCT ts::DATE) FROM ev WHERE ts::DATE <= TIMESTAMP '{END}') AS files FROM ev WHERE ts > '{START}' AND ts < '{END}'", _pruned)
simple("plausible_records", f"SELECT sequence FROM ev WHERE sequence % 5 <> 0 AND sequence % 7 <> 0 AND sequence % 11 <> 0", _plausible)
simple("first_mismatch", "WITH k AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) SELECT item_id, CASE WHEN k % 5 = 0 THEN 'CRC32C' WHEN k % 3 = 0 THEN 'CRC32' END AS first FROM k", _mismatched, "")
