"""Queries over managed logs: the events are written as one, and then read, looked up, forged, cut, marked and compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditarium.functions.model import CompactionPolicy
from auditarium.functions.session import shared_dir
from auditarium.operators import chains, verify
from auditarium.plans.catalogue import AS_OF, END, EV, SEG, START, simple, stream_of
from auditarium.sources import index, managed, manifest, wal
from auditarium.streaming import live, source

_EVENT = ("sequence", "ts", "event_data", "flags", "segment")
_LAST = "(SELECT max(segment) FROM ev)"
_MIDDLE = f"({_LAST} // 2)"
POLICY = CompactionPolicy(min_segments=1, target_size=400_000, min_segment_size=1, ratio=0.75)


def log(ev: DataFrame) -> str:
    """The folder of a managed log of the events."""
    path = shared_dir(ev.sparkSession, "managed")
    managed.append(ev.select(*_EVENT), path)
    return path


def _text(rec: DataFrame) -> DataFrame:
    return rec.select("sequence", F.col("event_data").cast("string").alias("event_data"), "flags")


def _last(ev: DataFrame) -> int:
    return ev.agg(F.max("segment")).first()[0]


def replaced(ev: DataFrame) -> DataFrame:
    """The check of a log of which the middle segment was replaced by one of other payloads that holds in itself."""
    spark, path, forged = ev.sparkSession, log(ev), shared_dir(ev.sparkSession, "forged")
    middle = _last(ev) // 2
    wal.write_log(ev.where(F.col("segment") == middle).withColumn("event_data", F.concat("event_data", F.lit("!"))).select(*_EVENT), forged)
    store, base = manifest.store_of(path)
    (target,) = [e["name"] for e in manifest.load(path).ordered() if e["segment"] == middle]
    store.move(wal.files(forged, ".wal")[0][0], f"{base}/{target}")
    return managed.check(spark, path).select("segment", "records", "status", "sealed")


def cut(ev: DataFrame) -> DataFrame:
    """Reports on a log whose last segment and newest generation are gone, without and with the seal that was noted before."""
    spark, path, last = ev.sparkSession, shared_dir(ev.sparkSession, "managed"), _last(ev)
    managed.append(ev.where(F.col("segment") < last).select(*_EVENT), path)
    state = managed.append(ev.where(F.col("segment") == last).select(*_EVENT), path)
    store, base = manifest.store_of(path)
    store.delete_file(f"{base}/{state.ordered()[-1]['name']}")
    store.delete_file(f"{base}/{manifest.FOLDER}/{state.generation:020d}.json")
    reports = [managed.report(spark, path, seal).select(F.lit(name).alias("seal"), "segments", "ok", "valid") for name, seal in (("none", None), ("noted", state.seal))]
    return reports[0].unionByName(reports[1])


def committed(ev: DataFrame) -> DataFrame:
    """Live records and their sum, and segments: before a compaction, by a reader that began before it and reads after it, and after it."""
    spark, path = ev.sparkSession, log(ev)
    managed.mark_deleted(spark, path, ev.where("segment % 2 = 1 and sequence % 3 = 0").select("sequence"))
    sums = lambda rec: rec.agg(F.count("*").alias("records"), F.sum("sequence").alias("sequences"), F.count_distinct("path").alias("segments"))
    before = sums(managed.read(spark, path)).first()
    held = managed.read(spark, path)
    managed.compact(spark, path, POLICY, AS_OF)
    valid = managed.report(spark, path).first()["valid"]
    first = spark.range(1).select(F.lit("before").alias("read"), *(F.lit(before[c]).cast("long").alias(c) for c in ("records", "sequences", "segments")))
    rest = [sums(rec).select(F.lit(name).alias("read"), "records", "sequences", "segments") for name, rec in (("held", held), ("after", managed.read(spark, path)))]
    return first.unionByName(rest[0]).unionByName(rest[1]).withColumn("valid", F.lit(valid))


#: segments that the policy takes: sealed, old enough, with few live bytes (records that are flagged, or marked); runs of them are filled to the target size.
_COMMIT = SEG + f""", dead AS (SELECT segment, sum(size) AS bytes FROM ev WHERE flags & 1 = 1 OR (segment % 2 = 1 AND sequence % 3 = 0) GROUP BY segment),
  chosen AS (SELECT s.segment, s.size, row_number() OVER (ORDER BY start_seq) AS k FROM seg s JOIN dead d USING (segment) WHERE s.segment < {_LAST} AND s.end_time <= TIMESTAMP '{AS_OF}' - INTERVAL {POLICY.max_age_hours} HOUR
    AND 1 - d.bytes::DOUBLE / s.size < {POLICY.ratio}),
  filled AS (WITH RECURSIVE f AS (SELECT k, segment, size AS held, 0 AS g FROM chosen WHERE k = 1 UNION ALL
    SELECT c.k, c.segment, CASE WHEN f.held + c.size > {POLICY.target_size} THEN c.size ELSE f.held + c.size END, CASE WHEN f.held + c.size > {POLICY.target_size} THEN f.g + 1 ELSE f.g END FROM f JOIN chosen c ON c.k = f.k + 1) SELECT * FROM f),
  left_over AS (SELECT e.* FROM ev e LEFT JOIN chosen c USING (segment) WHERE c.segment IS NULL OR NOT (flags & 1 = 1 OR (segment % 2 = 1 AND sequence % 3 = 0))),
  one AS (SELECT (SELECT count(*) FROM ev) AS n, (SELECT sum(sequence) FROM ev)::BIGINT AS s, (SELECT count(*) FROM seg) AS f)"""
_AFTER = "(SELECT count(*) FROM seg) - (SELECT count(*) FROM chosen) + (SELECT count(DISTINCT g) FROM filled)"

simple("integrity_replaced_segment", f"SELECT segment, count(*) AS records, CASE WHEN segment = {_MIDDLE} THEN 'replaced' ELSE 'ok' END AS status, segment < {_MIDDLE} AS sealed FROM ev GROUP BY segment", replaced)
simple("integrity_cut_tail", f"SELECT s.seal, {_LAST} AS segments, {_LAST} AS ok, s.valid FROM (VALUES ('none', true), ('noted', false)) s(seal, valid)", cut)
simple("compact_commit", f"SELECT 'before' AS read, n AS records, s AS sequences, f AS segments, true AS valid FROM one UNION ALL SELECT 'held', n, s, f, true FROM one UNION ALL SELECT 'after', (SELECT count(*) FROM left_over), (SELECT sum(sequence) FROM left_over)::BIGINT, {_AFTER}, true", committed, _COMMIT)


def _marked(ev: DataFrame) -> DataFrame:
    spark, path = ev.sparkSession, log(ev)
    managed.mark_deleted(spark, path, ev.where("sequence % 7 = 0").select("sequence"))
    managed.mark_deleted(spark, path, ev.where("sequence % 11 = 0").select("sequence"))
    return _text(managed.read(spark, path))


def _vacuumed(ev: DataFrame) -> DataFrame:
    spark, path = ev.sparkSession, log(ev)
    managed.mark_deleted(spark, path, ev.where("segment % 2 = 0 and sequence % 4 = 0").select("sequence"))
    managed.vacuum(spark, path, 0.2)
    rows = managed.read(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1)).join(managed.segments(spark, path).select("name", "segment"), "name")
    return rows.select("sequence", "segment", F.col("flags").bitwiseAND(1).cast("int").alias("deleted"))


def _found(ev: DataFrame) -> DataFrame:
    """Each hundredth sequence and some that don't occur, by an index row for sixteen records."""
    spark, path = ev.sparkSession, log(ev)
    idx = index.build(spark, path, shared_dir(spark, "index"), 16)
    wanted = ev.where("sequence % 100 = 5").select("sequence").union(ev.agg(F.max("sequence") + 50))
    return _text(index.find(spark, path, idx, wanted))


def _between(ev: DataFrame) -> DataFrame:
    spark, path = ev.sparkSession, log(ev)
    idx = index.build(spark, path, shared_dir(spark, "index"))
    nanos = spark.sql(f"SELECT unix_micros(timestamp'{START} UTC') * 1000, unix_micros(timestamp'{END} UTC') * 1000").first()
    return _text(index.between(spark, path, idx, nanos[0], nanos[1]))


def _indexed(ev: DataFrame) -> DataFrame:
    spark, path = ev.sparkSession, log(ev)
    return index.build(spark, path, shared_dir(spark, "index"), 10).select("first_sequence", "last_sequence", "records", "bytes", "offset", "flags")


def _from_offset(ev: DataFrame) -> DataFrame:
    """Behind the twentieth record's place in the first file: by seeking there."""
    spark, path = ev.sparkSession, log(ev)
    at = wal.read_headers(spark, path).where("sequence = 20").select("path", (F.col("offset") + F.col("size")).alias("end")).first()
    return wal.read_from(spark, at["path"], at["end"]).where("parse_error is null").select("sequence")


_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY sequence) - 1 AS place, sum(size) OVER (PARTITION BY segment ORDER BY sequence) - size AS begins FROM ev)"

simple("deletion_vectors", "SELECT sequence, event_data, CASE WHEN sequence % 7 = 0 OR sequence % 11 = 0 THEN 1 ELSE flags END AS flags FROM ev", _marked)
simple("vacuum_commit", f"SELECT sequence, segment, (flags & 1 = 1 OR (segment % 2 = 0 AND sequence % 4 = 0))::INTEGER AS deleted FROM ev WHERE NOT (segment % 2 = 0 AND segment < {_LAST} AND (flags & 1 = 1 OR sequence % 4 = 0))", _vacuumed)
simple("find_by_index", "SELECT sequence, event_data, flags FROM ev WHERE sequence % 100 = 5", _found)
simple("range_by_index", f"SELECT sequence, event_data, flags FROM ev WHERE ts BETWEEN '{START}' AND '{END}'", _between)
simple("record_index", "SELECT min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS records, sum(size)::BIGINT AS bytes, min(begins)::BIGINT AS offset, max(flags) AS flags FROM numbered GROUP BY segment, place // 10", _indexed, SEG + ", " + _NUMBERED)
simple("positional_scan_bytes", "SELECT sequence FROM ev WHERE segment = 0 AND sequence > 20", _from_offset)


def _branches(ev: DataFrame) -> DataFrame:
    """A log in which each 977th record is lost and twenty others were written from the middle on as well, with its records in no order."""
    rows = verify.chained(ev.select("segment", "sequence", "event_data").repartition("segment"))
    middle = ev.agg(F.max("sequence")).first()[0] // 2 + 1
    other = F.sha2(F.concat("event_data", F.lit("~")), 256)
    forged = verify.hashed(ev).where(F.col("sequence").between(middle, middle + 20)).withColumn("own", other)
    ahead = forged.select((F.col("sequence") + 1).alias("sequence"), F.when(F.col("sequence") == middle, F.col("hash")).otherwise(F.col("own")).alias("prev_hash"))
    forged = forged.where(F.col("sequence") > middle).select("sequence", F.col("own").alias("hash")).join(ahead, "sequence")
    rec = rows.where("sequence % 977 <> 500").select("sequence", "hash", "prev_hash").unionByName(forged)
    rec = rec.select(F.concat(F.lit("file"), F.pmod(F.xxhash64("hash"), F.lit(13))).alias("path"), F.xxhash64("hash", F.lit(1)).alias("offset"), "sequence", "hash", "prev_hash")
    return chains.branches(rec).select("kind", "main", "first_sequence", "last_sequence", "records", "fork_sequence")


def _monitored(spark, d: str) -> DataFrame:
    """The totals that a monitor tells after a log's first half, and after the rest was written and it went on from its checkpoint."""
    from auditarium.plans.catalogue import events

    ev, path, checkpoint, told = events(spark, d), shared_dir(spark, "wal"), shared_dir(spark, "checkpoint"), []
    last = _last(ev)
    for low, high in ((0, last // 2), (last // 2 + 1, last)):
        wal.write_log(ev.where(F.col("segment").between(low, high)), path)
        live.monitor(source.follow(spark, path), checkpoint, told.append).awaitTermination()
    rows = [spark.range(1).select(F.lit(k).alias("run"), *(F.lit(r[c]).cast("long").alias(c) for c in ("records", "errors", "bytes", "last_sequence"))) for k, r in ((1, told[0]), (2, told[-1]))]
    return rows[0].unionByName(rows[1])


def _ingested(spark, d: str) -> DataFrame:
    """The events as a stream of three batches that becomes a managed log: its records, and whether the seals hold."""
    path = shared_dir(spark, "managed")
    live.append(stream_of(spark, d, 3), path, shared_dir(spark, "checkpoint")).awaitTermination()
    valid, state = managed.report(spark, path).first()["valid"], manifest.load(path)
    return managed.read(spark, path).select(F.col("event_data").cast("string").alias("event_data"), "flags").withColumn("valid", F.lit(valid)).withColumn("last_sequence", F.lit(state.last_sequence()).cast("long")).withColumn("generations", F.lit(state.generation))


def _followed(ev: DataFrame) -> DataFrame:
    """What a stream of a managed log brings: each record once, whatever is rewritten."""
    spark, path, out, checkpoint = ev.sparkSession, shared_dir(ev.sparkSession, "managed"), shared_dir(ev.sparkSession, "out"), shared_dir(ev.sparkSession, "checkpoint")
    last = _last(ev)
    for low, high in ((0, last // 2), (last // 2 + 1, last)):
        managed.append(ev.where(F.col("segment").between(low, high)).select(*_EVENT), path)
        managed.vacuum(spark, path, 0.0001)
        source.follow(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _text(spark.read.schema(wal.SCHEMA).parquet(out))


_KEPT = EV + ", kept AS (SELECT sequence, sequence - row_number() OVER (ORDER BY sequence) AS island FROM ev WHERE sequence % 977 <> 500), m AS (SELECT max(sequence) // 2 + 1 AS m FROM ev)"
_KIND = "CASE WHEN min(sequence) = 1 THEN 'start' ELSE 'lost' END"
simple("chain_branches", f"SELECT {_KIND} AS kind, true AS main, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS records, NULL::BIGINT AS fork_sequence FROM kept GROUP BY island UNION ALL SELECT (SELECT {_KIND} FROM kept WHERE island = (SELECT island FROM kept WHERE sequence = m)), false, m + 1, m + 20, 20, m FROM m", _branches, _KEPT)
_HALF = "(SELECT max(segment) // 2 FROM ev)"
simple("stream_monitor", f"WITH {EV} SELECT r.run, count(*) AS records, 0::BIGINT AS errors, sum(size)::BIGINT AS bytes, max(sequence) AS last_sequence FROM ev JOIN (VALUES (1), (2)) r(run) ON r.run = 2 OR ev.segment <= {_HALF} GROUP BY r.run", _monitored, "")
simple("stream_ingest", f"WITH {EV} SELECT event_data, flags, true AS valid, (SELECT count(*) FROM ev) AS last_sequence, 3 AS generations FROM ev", _ingested, "")
simple("stream_follow", "SELECT sequence, event_data, flags FROM ev", _followed)
