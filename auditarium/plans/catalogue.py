"""The registered queries and their SQL.

Each query reads whole tables of a folder through the operators; its SQL states the same result independently, for another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditarium.functions import checksum, crypto
from auditarium.functions.model import PATTERNS, CompactionPolicy, events_from_table, format_bytes, level_code, profiles
from auditarium.functions.session import shared_dir
from auditarium.operators import compliance, maintain, monitor, protect, recover, replay, stats, verify
from auditarium.sources import catalog, export, records, wal
from auditarium.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

START, END, AS_OF = "2024-01-06 00:00:00", "2024-01-21 00:00:00", "2024-02-01 00:00:00"
POLICY = CompactionPolicy(min_segments=2, target_size=250_000, min_segment_size=60_000, ratio=0.7)

#: About the median of the segments' live ratios.
CYCLE = 0.15

EV = """ev AS (SELECT event_id + 1 AS sequence, ts,
  CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level,
  user_id::VARCHAR AS entity_id, event_type, value, props, concat_ws('|', event_id, user_id, event_type, props) AS event_data,
  (strlen(concat_ws('|', event_id, user_id, event_type, props)) + 72)::BIGINT AS size, event_id // 1000 AS segment,
  CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS flags FROM events)"""
SEG = EV + """, seg AS (SELECT segment, min(sequence) AS start_seq, max(sequence) AS end_seq, min(ts) AS start_time, max(ts) AS end_time,
  sum(size)::BIGINT AS size, count(*) AS record_count, count(*) FILTER (flags & 1 = 1) AS deleted FROM ev GROUP BY segment)"""
LIVE = SEG + """, marked AS (SELECT *, flags & 1 = 1 AS dead, flags & 1 = 0 AND sequence < coalesce(max(sequence) FILTER (flags & 1 = 0) OVER (PARTITION BY segment, entity_id), 0) AS old FROM ev),
  ratios AS (SELECT segment, round(sum(CASE WHEN dead OR old THEN 0 ELSE size END)::DOUBLE / sum(size), 9) AS ratio, sum(size)::BIGINT AS size,
  count(*) FILTER (dead) AS deleted, count(*) FILTER (old) AS superseded, count(*) AS records FROM marked GROUP BY segment)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg_of(ev: DataFrame) -> DataFrame:
    """Segments with sealed (full ones are) and created_at."""
    return replay.segments(ev).withColumn("sealed", F.col("record_count") == 1000).withColumn("created_at", F.col("start_time"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.level_counts(replay.replay(events(spark, sf_dir), START, END), "segment")


def query(name: str, sql: str | None, with_: str = EV):
    """Registers the decorated function of events (or of spark and the folder, if with_ is empty) under name."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, sf_dir: f(events(spark, sf_dir))) if with_ else f
        if sql:
            ORACLES[name] = f"WITH {with_} {sql}" if with_ else sql
        return f

    return register


def simple(name: str, sql: str | None, f: Callable, with_: str = EV) -> None:
    query(name, sql, with_)(f)


# reading ---------------------------------------------------------------------------------------------------
_ROW = ("sequence", "ts", "level", "entity_id", "event_type")
_COLS = ", ".join(_ROW)
simple("replay_range", f"SELECT {_COLS} FROM ev WHERE ts BETWEEN '{START}' AND '{END}'", lambda ev: replay.replay(ev, START, END).select(*_ROW))
simple("replay_from", f"SELECT {_COLS} FROM ev WHERE ts >= '{END}'", lambda ev: replay.replay(ev, END).select(*_ROW))
simple("replay_all", f"SELECT {_COLS} FROM ev", lambda ev: replay.replay(ev).select(*_ROW))
simple("backend_range_exclusive", f"SELECT {_COLS} FROM ev WHERE ts > '{START}' AND ts < '{END}'", lambda ev: replay.replay(ev, START, END, "exclusive").select(*_ROW))
simple("find_by_sequence", f"SELECT {_COLS}, flags FROM ev WHERE sequence = 434", lambda ev: replay.find(ev, 434).select(*_ROW, "flags"))
simple("find_by_sequence_live", f"SELECT {_COLS}, flags FROM ev WHERE sequence = 434 AND flags = 0", lambda ev: replay.find(ev, 434, True).select(*_ROW, "flags"))
simple("range_excl_deleted", f"SELECT {_COLS} FROM ev WHERE flags = 0 AND ts BETWEEN '{START}' AND '{END}'", lambda ev: replay.live(replay.replay(ev, START, END)).select(*_ROW))
simple("positional_scan", "SELECT sequence, segment FROM ev WHERE sequence >= 501", lambda ev: ev.where("sequence >= 501").select("sequence", "segment"))
simple("query_limit", f"SELECT {_COLS} FROM ev WHERE ts >= '{START}' AND level >= 3 AND value > 10 ORDER BY sequence LIMIT 25", lambda ev: replay.query(ev, START, None, ("level >= 3", "value > 10"), 25).select(*_ROW))
simple("route_audit", f"SELECT {_COLS} FROM ev WHERE level >= 4 OR json_extract_string(props, '$.Audit') IS NOT NULL", lambda ev: replay.audit_route(ev).select(*_ROW))
simple("prop_extract", "SELECT sequence, json_extract_string(props, '$.k')::BIGINT AS k FROM ev", lambda ev: ev.select("sequence", F.get_json_object("props", "$.k").cast("long").alias("k")))
simple("level_code", "SELECT sequence, (['VRB','DBG','INF','WRN','ERR','FTL'])[level + 1] AS code FROM ev", lambda ev: ev.select("sequence", level_code(F.col("level")).alias("code")))

# segments and statistics --------------------------------------------------------------------------------------
simple("segment_info", "SELECT * FROM seg", replay.segments, SEG)
simple("segment_prune_time", f"SELECT segment, start_seq, end_seq FROM seg WHERE end_time >= '{START}' AND start_time <= '{END}'", lambda ev: replay.prune(replay.segments(ev), START, END).select("segment", "start_seq", "end_seq"), SEG)
simple("segment_prune_seq", "SELECT segment, start_seq, end_seq FROM seg WHERE end_seq >= 700 AND start_seq <= 2300", lambda ev: replay.prune(replay.segments(ev), first=700, last=2300).select("segment", "start_seq", "end_seq"), SEG)
simple("sequence_span", "SELECT min(sequence) AS first, max(sequence) AS last FROM ev", lambda ev: ev.agg(F.min("sequence").alias("first"), F.max("sequence").alias("last")))
_LEVELS = "count(*) AS total, count(*) FILTER (level >= 4) AS errors, count(*) FILTER (level = 3) AS warnings, count(*) FILTER (level = 2) AS infos, count(*) FILTER (level <= 1) AS debugs"
simple("level_counts", f"SELECT segment, {_LEVELS} FROM ev GROUP BY segment", lambda ev: stats.level_counts(ev, "segment"))
simple("level_counts_range", f"SELECT segment, {_LEVELS} FROM ev WHERE ts BETWEEN '{START}' AND '{END}' GROUP BY segment", lambda ev: stats.level_counts(replay.replay(ev, START, END), "segment"))
simple(
    "log_stats",
    f"""SELECT *, date_diff('microsecond', first_time, last_time) AS duration_micros, bytes // total AS avg_record, bytes // segments AS avg_segment,
  round(greatest(0.0, (segments - (bytes // 67108864 + 1)) / (bytes // 67108864 + 1)::DOUBLE * 100.0), 6) AS fragmentation FROM (
  SELECT {_LEVELS}, arg_min(ts, sequence) AS first_time, arg_max(ts, sequence) AS last_time, min(sequence) AS first_seq, max(sequence) AS last_seq FROM ev),
  (SELECT count(*) AS segments, sum(size)::BIGINT AS bytes FROM seg)""",
    stats.log_stats,
    SEG,
)
simple(
    "segment_stats",
    """SELECT segment, start_seq, end_seq, size, record_count = 1000 AS sealed,
  CASE WHEN end_seq > start_seq THEN end_seq - start_seq + 1 WHEN start_seq > 0 AND record_count <> 1000 THEN -1 ELSE 0 END::BIGINT AS records,
  CASE WHEN record_count = 1000 THEN round(size / 67108864.0::DOUBLE * 100.0, 9) ELSE 0.0 END AS compaction_pct,
  CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0::DOUBLE) ELSE size || ' B' END AS size_text FROM seg""",
    lambda ev: stats.segment_stats(seg_of(ev)),
    SEG,
)
simple("live_ratio", "SELECT * FROM ratios", stats.live_ratio, LIVE)
simple("superseded", "SELECT sequence, segment, entity_id FROM marked WHERE old", lambda ev: stats.with_live(ev).where("superseded").select("sequence", "segment", "entity_id"), LIVE)
simple("compaction_gain", "SELECT coalesce(sum(floor(size * (1 - ratio))), 0)::BIGINT AS gain, count(*) AS segments FROM ratios WHERE ratio < 0.7", lambda ev: stats.compaction_gain(stats.live_ratio(ev), 0.7), LIVE)
simple("format_bytes", "SELECT page_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM (SELECT page_id, strlen(html) AS n FROM pages)", lambda spark, d: table(spark, d, "pages").select("page_id", format_bytes(F.octet_length("html")).alias("size")), "")

# maintenance ----------------------------------------------------------------------------------------------------
simple(
    "compactable_segments",
    f"""SELECT s.segment, s.size, r.ratio FROM seg s JOIN ratios r USING (segment) WHERE s.record_count = 1000 AND s.start_time <= TIMESTAMP '{AS_OF}' - INTERVAL {POLICY.max_age_hours} HOUR AND (s.size < {POLICY.min_segment_size} OR r.ratio < {POLICY.ratio})""",
    lambda ev: maintain.eligible(seg_of(ev).join(stats.live_ratio(ev).select("segment", "ratio"), "segment"), POLICY, AS_OF).select("segment", "size", "ratio"),
    LIVE,
)
simple(
    "compaction_dry_run",
    f"""SELECT s.segment, r.ratio, r.superseded, floor(s.size * (1 - r.ratio))::BIGINT AS gain FROM seg s JOIN ratios r USING (segment) WHERE s.record_count = 1000 AND s.start_time <= TIMESTAMP '{AS_OF}' - INTERVAL {POLICY.max_age_hours} HOUR AND (s.size < {POLICY.min_segment_size} OR r.ratio < {POLICY.ratio})""",
    lambda ev: maintain.dry_run(ev, seg_of(ev), stats.live_ratio(ev), POLICY, AS_OF).select("segment", "ratio", "superseded", "gain"),
    LIVE,
)
simple(
    "compaction_groups",
    f"""SELECT g AS group_no, min(segment) AS first_segment, max(segment) AS last_segment, count(*)::INTEGER AS n, max(bytes)::BIGINT AS bytes FROM fold GROUP BY g
  HAVING g < (SELECT max(g) FROM fold) OR count(*) >= {POLICY.min_segments} OR max(bytes) >= {POLICY.min_segment_size}""",
    lambda ev: maintain.pack(replay.segments(ev), POLICY).select("group_no", F.array_min("segments").alias("first_segment"), F.array_max("segments").alias("last_segment"), "n", "bytes"),
    "RECURSIVE " + SEG + f""", s AS (SELECT row_number() OVER (ORDER BY start_seq) AS i, segment, size FROM seg),
  fold AS (SELECT i, segment, size AS bytes, 0 AS g FROM s WHERE i = 1 UNION ALL
    SELECT s.i, s.segment, CASE WHEN f.bytes + s.size > {POLICY.target_size} THEN s.size ELSE f.bytes + s.size END, CASE WHEN f.bytes + s.size > {POLICY.target_size} THEN f.g + 1 ELSE f.g END FROM fold f JOIN s ON s.i = f.i + 1)""",
)
simple(
    "compact_dedup",
    "SELECT sequence, segment, event_data FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY segment) AS n FROM (SELECT * FROM ev UNION ALL SELECT * REPLACE (segment + 1 AS segment) FROM ev WHERE sequence % 7 = 0)) WHERE n = 1 AND flags & 1 = 0",
    lambda ev: maintain.compacted(ev.unionByName(ev.where("sequence % 7 = 0").withColumn("segment", F.col("segment") + 1))).select("sequence", "segment", "event_data"),
)
simple("vacuum_candidates", "SELECT segment, record_count, deleted FROM seg WHERE deleted::DOUBLE / record_count >= 0.1", lambda ev: maintain.vacuum_candidates(replay.segments(ev)).select("segment", "record_count", "deleted"), SEG)
simple("tombstone_apply", "SELECT sequence, level FROM ev WHERE sequence NOT IN (SELECT sequence - 5 FROM ev WHERE level = 4)", lambda ev: maintain.tombstoned(ev, ev.where("level = 4").select((F.col("sequence") - 5).alias("deleted_sequence"))).select("sequence", "level"))
simple("mark_deleted", "SELECT sequence, CASE WHEN sequence IN (SELECT sequence - 5 FROM ev WHERE level = 4) THEN flags | 1 ELSE flags END AS flags FROM ev", lambda ev: maintain.mark_deleted(ev, ev.where("level = 4").select((F.col("sequence") - 5).alias("sequence"))).select("sequence", "flags"))
simple("segments_kept", "SELECT segment, record_count FROM seg WHERE record_count <> 1000 OR segment IN (SELECT segment FROM seg ORDER BY start_time DESC, segment DESC LIMIT 5)", lambda ev: maintain.newest(seg_of(ev), 5).select("segment", "record_count"), SEG)

# integrity -------------------------------------------------------------------------------------------------------
_CHAIN = EV + f", chain AS (SELECT *, sha256(event_data) AS hash, coalesce(lag(sha256(event_data)) OVER (ORDER BY sequence), '{'0' * 64}') AS prev_hash FROM ev)"
_TAMPERED = _CHAIN + ", now AS (SELECT sequence, ts, prev_hash, sha256(CASE WHEN sequence % 499 = 8 THEN event_data || '!' ELSE event_data END) AS hash FROM chain), checked AS (SELECT *, coalesce(lag(hash) OVER (ORDER BY sequence) = prev_hash, true) AS linked FROM now)"


def tampered(ev: DataFrame) -> DataFrame:
    """A chained log in which some events were changed afterwards."""
    return verify.chained(ev).withColumn("event_data", F.when(F.col("sequence") % 499 == 8, F.concat("event_data", F.lit("!"))).otherwise(F.col("event_data")))


simple("hash_chain", "SELECT sequence, hash, prev_hash FROM chain", lambda ev: verify.chained(ev).select("sequence", "hash", "prev_hash"), _CHAIN)
simple("chain_breaks", "SELECT sequence, prev_hash FROM checked WHERE NOT linked", lambda ev: verify.check_chain(tampered(ev)).where("not linked").select("sequence", "prev_hash"), _TAMPERED)
simple(
    "integrity_report",
    "SELECT count(*) AS total, count(*) FILTER (sequence % 1009 = 0) AS damaged, count(*) FILTER (NOT linked) AS chain_breaks, count(*) FILTER (sequence % 1009 = 0) + count(*) FILTER (NOT linked) AS corrupted, max(sequence) AS last_sequence, arg_max(ts, sequence) AS last_time, count(*) FILTER (sequence % 1009 = 0 OR NOT linked) = 0 AS valid FROM checked",
    lambda ev: verify.integrity_report(verify.check_chain(tampered(ev)), "sequence % 1009 = 0"),
    _TAMPERED,
)
_HOLES = "sequence % 97 NOT IN (5, 6) AND segment <> 3"
simple("sequence_gaps", f"SELECT segment, sequence, before, sequence - before - 1 AS missing FROM (SELECT segment, sequence, lag(sequence) OVER (ORDER BY sequence) AS before FROM ev WHERE {_HOLES}) WHERE sequence - before <> 1", lambda ev: verify.check_gaps(ev.where(_HOLES)))
simple(
    "merkle_root",
    "SELECT h[1] AS root FROM tree WHERE len(h) = 1",
    lambda ev: verify.merkle_root(ev, ev.count()),
    "RECURSIVE " + EV + ", tree AS (SELECT list(sha256(event_data) ORDER BY sequence) AS h FROM ev UNION ALL SELECT list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], h[i]))) FROM tree WHERE len(h) > 1)",
)
simple("digest_md5_b64", "SELECT page_id, to_base64(unhex(md5(html))) AS md5_b64 FROM pages", lambda spark, d: table(spark, d, "pages").select("page_id", F.base64(F.unhex(F.md5("html"))).alias("md5_b64")), "")


@query("manifest_mismatch", "SELECT page_id AS name, md5(html) AS md5_b64, md5(url) AS expected FROM pages WHERE page_id % 5 = 0 AND page_id % 7 <> 0", "")
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    manifest = pages.where("page_id % 7 <> 0").select(F.col("page_id").alias("name"), F.when(F.col("page_id") % 5 == 0, F.md5("url")).otherwise(F.md5("html")).alias("md5_b64"))
    return verify.manifest_mismatch(pages.select(F.col("page_id").alias("name"), F.md5("html").alias("md5_b64")), manifest)


@query("object_integrity", "SELECT count(*) AS objects, sum(strlen(html))::BIGINT AS bytes, count(*) FILTER (page_id % 3 = 0) AS unencrypted, count(*) FILTER (page_id % 4 = 0) AS unlocked, count(*) FILTER (page_id % 5 = 0) AS no_retention FROM pages", "")
def _objects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    return verify.object_integrity(table(spark, d, "pages").select(F.octet_length("html").cast("long").alias("size"), (k % 3 != 0).alias("encrypted"), (k % 4 != 0).alias("locked"), F.when(k % 5 != 0, F.lit(AS_OF).cast("timestamp_ntz")).alias("retention_until")))


@query("backend_shadow", "SELECT count(*) AS events, true AS counts_equal, 0::BIGINT AS differ FROM ev")
def _backend_shadow(ev: DataFrame) -> DataFrame:
    """A backend's files and their shadows: as many, and with equal digests."""
    spark = ev.sparkSession
    path, shadow = shared_dir(spark, "backend"), shared_dir(spark, "shadow")
    export.write_backend(ev.select("sequence", "ts"), path, shadow)
    listed = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(p).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.base64(F.unhex(F.md5("content"))).alias("md5_b64"))
    differ = verify.manifest_mismatch(listed(shadow), listed(path)).agg(F.count("*").alias("differ"))
    rows = spark.read.schema("sequence long").json(shadow).agg(F.count("*").alias("events"))
    return rows.crossJoin(F.broadcast(verify.shadow_check(listed(path), listed(shadow)).select("counts_equal"))).crossJoin(F.broadcast(differ))


@query("shadow_count_check", "SELECT count(*) FILTER (page_id % 11 <> 3) AS primary_files, count(*) FILTER (page_id % 13 <> 4) AS shadow_files, count(*) FILTER (page_id % 11 <> 3 AND page_id % 13 = 4) AS missing_in_shadow, count(*) FILTER (page_id % 11 = 3 AND page_id % 13 <> 4) AS missing_in_primary, count(*) FILTER (page_id % 11 <> 3) = count(*) FILTER (page_id % 13 <> 4) AS counts_equal FROM pages", "")
def _shadow(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "pages").select(F.col("page_id").alias("name"))
    return verify.shadow_check(names.where("name % 11 <> 3"), names.where("name % 13 <> 4"))


@query("wal_round_trip", "SELECT sequence, epoch_us(ts) AS micros, event_data, flags, size::INTEGER AS size, true AS linked FROM ev")
def _round_trip(ev: DataFrame) -> DataFrame:
    spark = ev.sparkSession
    path = shared_dir(spark, "wal")
    wal.write_log(ev, path)
    return wal.check_records(wal.read_log(spark, path)).select("sequence", F.expr("ts_nanos div 1000").alias("micros"), F.col("event_data").cast("string").alias("event_data"), "flags", "size", "linked")


# compliance ------------------------------------------------------------------------------------------------------
_MASK = "CASE WHEN length(x) <= 4 THEN '****' WHEN length(x) <= 8 THEN left(x, 2) || repeat('*', length(x) - 2) ELSE left(x, 2) || repeat('*', length(x) - 4) || right(x, 2) END"
simple("mask_values", f"SELECT c_custkey, {_MASK.replace('x)', 'c_name)').replace('(x,', '(c_name,')} AS masked FROM customer", lambda spark, d: table(spark, d, "customer").select("c_custkey", compliance.mask_text(F.col("c_name")).alias("masked")), "")
for _name, _term in (("email", "EMAIL"), ("phone", "PHONE"), ("ip", "IP"), ("card", "CREDITCARD"), ("ssn", "SSN"), ("mrn", "MRN")):
    simple(f"redact_{_name}", f"SELECT doc_id, regexp_replace(text, '\\b{PATTERNS[_term]}\\b', '[REDACTED]', 'g') AS text FROM documents", lambda spark, d, t=_term: table(spark, d, "documents").select("doc_id", compliance.redact(F.col("text"), [t]).alias("text")), "")
simple("redact_keyword", "SELECT doc_id, regexp_replace(text, '(?i)\\bthe\\b', '[REDACTED]', 'g') AS text FROM documents", lambda spark, d: table(spark, d, "documents").select("doc_id", compliance.redact(F.col("text"), ["the"]).alias("text")), "")
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
simple(
    "required_props",
    f"SELECT sequence, entity_id AS UserId, event_type AS Action, '[MISSING_REQUIRED]' AS PatientId, '[MISSING_REQUIRED]' AS IPAddress, {_STAMP} AS Timestamp FROM ev",
    lambda ev: ev.withColumn("p", compliance.required(F.create_map(F.lit("UserId"), F.col("entity_id"), F.lit("Action"), F.col("event_type")), compliance.profile_of("HIPAA").required, F.col("ts"))).select("sequence", *(F.col("p")[k].alias(k) for k in ("UserId", "Action", "PatientId", "IPAddress", "Timestamp"))),
)
simple(
    "apply_profile",
    f"SELECT sequence, {_MASK.replace('x)', 'entity_id)').replace('(x,', '(entity_id,')} AS PhoneNo, event_type AS Action, 'HIPAA' AS profile, sequence::VARCHAR AS own FROM ev",
    lambda ev: compliance.apply_profile(ev.withColumn("props", F.create_map(F.lit("PhoneNo"), F.col("entity_id"), F.lit("Action"), F.col("event_type"))), "HIPAA").select("sequence", *(F.col("props")[k].alias(n) for k, n in (("PhoneNo", "PhoneNo"), ("Action", "Action"), ("_compliance_profile", "profile"), ("_compliance_sequence", "own")))),
)
simple("mask_json", "SELECT sequence, '\"****\"' AS masked FROM ev", lambda ev: ev.select("sequence", compliance.mask_json(F.get_json_object("props", "$.k")).alias("masked")))
simple(
    "mask_json_types",
    f"SELECT sequence, CASE sequence % 4 WHEN 1 THEN '\"****\"' WHEN 2 THEN '\"' || {_MASK.replace('x)', 'y)').replace('(x,', '(y,')} || '\"' ELSE '\"[REDACTED]\"' END AS masked FROM (SELECT sequence, event_type || '-' || sequence AS y FROM ev)",
    lambda ev: ev.select("sequence", compliance.mask_json(F.when(F.col("sequence") % 4 == 0, F.lit("true")).when(F.col("sequence") % 4 == 1, F.col("sequence").cast("string")).when(F.col("sequence") % 4 == 2, F.concat(F.lit('"'), "event_type", F.lit("-"), F.col("sequence").cast("string"), F.lit('"'))).otherwise(F.lit("[1]"))).alias("masked")),
)
simple("key_rotation", "SELECT sequence, event_data AS opened FROM ev", lambda ev: _rotated(ev))
simple("aes_round_trip", "SELECT sequence, event_data AS opened, (strlen(event_data) + 28)::INTEGER AS sealed_bytes FROM ev", lambda ev: _sealed(ev))


def _rotated(ev: DataFrame) -> DataFrame:
    """Events sealed under one key, then under another, and opened by that one alone."""
    keys = [bytes(range(k, k + 32)) for k in (0, 7)]
    table_of = lambda key: ev.sparkSession.range(1).select(F.substring(F.sha2(F.lit(bytearray(key)), 256), 1, 16).alias("key_id"), F.lit(bytearray(key)).alias("key"))
    rows = compliance.protect(ev, keys[0]).select("sequence", "key_id", "sealed")
    return compliance.unprotect(compliance.rotate(rows, table_of(keys[0]), keys[1]), table_of(keys[1])).select("sequence", F.col("opened").cast("string").alias("opened"))


def _sealed(ev: DataFrame) -> DataFrame:
    key = bytes(range(32))
    keys = ev.sparkSession.range(1).select(F.substring(F.sha2(F.lit(bytearray(key)), 256), 1, 16).alias("key_id"), F.lit(bytearray(key)).alias("key"))
    return compliance.unprotect(compliance.protect(ev, key), keys).select("sequence", F.col("opened").cast("string").alias("opened"), F.octet_length("sealed").alias("sealed_bytes"))


_NAMES = "CASE c_custkey % 5 WHEN 0 THEN ['HIPAA'] WHEN 1 THEN ['GDPR', 'INVALID'] WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN ['INVALID'] ELSE ['SOX', 'PCI-DSS'] END"


@query(
    "profile_flags",
    f"""WITH p(name, encryption, signing, days) AS (VALUES ('HIPAA', true, true, 2190), ('PCI-DSS', true, true, 365), ('SOX', true, true, 2555), ('GDPR', true, false, 1095)),
  n AS (SELECT c_custkey AS id, unnest(CASE WHEN len(names) = 0 THEN [NULL] ELSE names END) AS name FROM (SELECT c_custkey, {_NAMES} AS names FROM customer))
  SELECT id, coalesce(bool_or(encryption), false) AS encryption, coalesce(bool_or(signing), false) AS signing, coalesce(max(days), 0) AS max_days FROM n LEFT JOIN p USING (name) GROUP BY id""",
    "",
)
def _flags(spark: SparkSession, d: str) -> DataFrame:
    lists = (["HIPAA"], ["GDPR", "INVALID"], [], ["INVALID"], ["SOX", "PCI-DSS"])
    own = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists))
    return compliance.needs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.get(own, (F.col("c_custkey") % 5).cast("int")).alias("names")), profiles(spark))


simple("retention_cutoff", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY", lambda spark, d: compliance.retention(table(spark, d, "orders"), "o_orderdate", "1998-01-01", compliance.retention_days("PCI-DSS")).select("o_orderkey", "o_orderdate"), "")
simple(
    "lifecycle_actions",
    "SELECT l_returnflag, action, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN age >= 365 AND l_returnflag <> 'R' THEN 'delete' WHEN age >= 90 THEN 'archive' WHEN age >= 30 THEN 'compress' ELSE 'keep' END AS action FROM (SELECT l_returnflag, date_diff('day', l_shipdate, TIMESTAMP '1997-01-01') AS age FROM lineitem)) GROUP BY 1, 2",
    lambda spark, d: compliance.lifecycle(table(spark, d, "lineitem"), "l_shipdate", "1997-01-01", "standard", F.col("l_returnflag") == "R").groupBy("l_returnflag", "action").agg(F.count("*").alias("n")),
    "",
)

# exports -----------------------------------------------------------------------------------------------------------
_TIME = "regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"
_TEXT = "'User ' || entity_id || ' did ' || event_type || ' {unknown}'"
_EXPORT = f"SELECT {_TIME} AS Timestamp, (['VRB','DBG','INF','WRN','ERR','FTL'])[level + 1] AS Level, 'User {{UserId}} did {{Action:u}} {{unknown}}' AS MessageTemplate, {_TEXT} AS RenderedMessage, '{{\"Action\":\"' || event_type || '\",\"UserId\":\"' || entity_id || '\"}}' AS Properties, '' AS Exception FROM ev"


def messages(ev: DataFrame) -> DataFrame:
    return ev.select("sequence", "ts", "level", F.lit("User {UserId} did {Action:u} {unknown}").alias("message_template"), F.create_map(F.lit("UserId"), F.col("entity_id"), F.lit("Action"), F.col("event_type")).alias("properties"), F.lit(None).cast("string").alias("exception"))


simple("export_csv", _EXPORT, lambda ev: export.table(messages(ev)))
simple("render_message", f"SELECT sequence, {_TEXT} AS message FROM ev", lambda ev: messages(ev).select("sequence", export.render(F.col("message_template"), F.col("properties")).alias("message")))
simple("replay_text", f"SELECT '[' || {_TIME} || '] ' || (['VRB','DBG','INF','WRN','ERR','FTL'])[level + 1] || ': ' || {_TEXT} AS value FROM ev", lambda ev: export.lines(messages(ev)))

# monitoring ----------------------------------------------------------------------------------------------------------
_HOURS = EV + ", hours AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS events, count(*) FILTER (level >= 4) AS errors FROM ev GROUP BY 1)"
hours = lambda ev: monitor.buckets(ev, "hour")
simple("throughput_sliding", "SELECT *, round(avg(nullif(events, 0)) OVER (ORDER BY bucket ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) / 3600, 9) AS throughput FROM hours", lambda ev: monitor.throughput(hours(ev), 3600), _HOURS)
simple("growth_rate", "SELECT *, events - lag(events) OVER (ORDER BY bucket) AS delta, round((events - lag(events) OVER (ORDER BY bucket)) / 3600.0::DOUBLE, 9) AS rate FROM hours", lambda ev: monitor.growth(hours(ev), 3600), _HOURS)
simple("error_alerts", "SELECT bucket, errors, total::BIGINT AS total, (total // 20 - (total - errors) // 20)::BIGINT AS alerts FROM (SELECT *, sum(errors) OVER (ORDER BY bucket) AS total FROM hours) WHERE total // 20 > (total - errors) // 20", lambda ev: monitor.alerts(hours(ev), 20), _HOURS)
simple(
    "error_rate_health",
    f"""SELECT bucket, events, errors, silent_seconds, throughput, round(r, 9) AS error_rate, round(greatest(0.0, 100 * (1 - r)), 6) AS integrity_score,
  CASE WHEN r > 0.5 THEN 'unhealthy' WHEN r > 0.05 OR silent_seconds > 300 OR throughput = 0 THEN 'degraded' ELSE 'healthy' END AS status,
  concat_ws('; ', CASE WHEN r > 0.5 THEN 'error rate over 50%' END, CASE WHEN r > 0.05 AND r <= 0.5 THEN 'error rate over 5%' END, CASE WHEN silent_seconds > 300 THEN 'no events for 5 minutes' END, CASE WHEN throughput = 0 THEN 'no throughput' END) AS issues
  FROM (SELECT bucket, events, errors, (events % 400)::BIGINT AS silent_seconds, (events % 3)::BIGINT AS throughput, errors::DOUBLE / events AS r FROM hours)""",
    lambda ev: monitor.health(hours(ev).withColumn("silent_seconds", F.col("events") % 400).withColumn("throughput", F.col("events") % 3)),
    _HOURS,
)
_SILENCE = "((epoch_us(bucket) + 3600000000 - epoch_us(last)) // 1000000)::BIGINT"
simple(
    "health_by_hour",
    f"""SELECT bucket, errors, silent_seconds, CASE WHEN r > 0.5 THEN 'unhealthy' WHEN r > 0.05 OR silent_seconds > 300 THEN 'degraded' ELSE 'healthy' END AS status
  FROM (SELECT bucket, errors, {_SILENCE} AS silent_seconds, errors::DOUBLE / events AS r FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS events, count(*) FILTER (level >= 4) AS errors, max(ts) AS last FROM ev GROUP BY 1))""",
    lambda ev: monitor.health(monitor.silence(ev, "hour", 3600).withColumn("throughput", F.col("events") / 3600)).select("bucket", "errors", "silent_seconds", "status"),
)
simple("breaker_success_rate", "SELECT segment, count(*) AS calls, count(*) FILTER (level = 4) AS failures, round(count(*) FILTER (level <> 4)::DOUBLE / count(*), 9) AS success_rate FROM ev GROUP BY segment", lambda ev: monitor.success_rates(ev.withColumn("ok", F.col("level") != 4), "segment"))
simple("breaker_states", None, lambda ev: monitor.breaker(ev.select(F.col("entity_id").alias("component"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("level") != 4).alias("ok")).withColumn("at", F.col("at") / 1e6), 2, 3600.0))
simple("latency_percentiles", "SELECT event_type, v[ceil(0.5 * len(v))::INTEGER] AS p50, v[ceil(0.99 * len(v))::INTEGER] AS p99, v[ceil(0.999 * len(v))::INTEGER] AS p999 FROM (SELECT event_type, list_sort(list(value)) AS v FROM ev GROUP BY event_type)", lambda ev: monitor.percentiles(ev, "value", "event_type"))
simple("latency_histogram", "SELECT k::INTEGER AS k, (SELECT count(*) FROM ev WHERE k = 15 OR value <= 0.001 * power(2, k)) AS n FROM range(16) r(k)", lambda ev: monitor.histogram(ev, "value", 0.001))
simple(
    "group_commit",
    "SELECT segment, count(*) AS batches, count(*) FILTER (n = 60) AS by_size, count(*) FILTER (n < 60) AS by_timer, round(avg(n), 9) AS avg_batch FROM (SELECT segment, date_trunc('day', ts) AS d, (sequence % 1000) // 60 AS b, count(*) AS n FROM ev GROUP BY 1, 2, 3) GROUP BY segment",
    lambda ev: ev.groupBy("segment", F.date_trunc("day", "ts"), F.expr("(sequence % 1000) div 60")).agg(F.count("*").alias("n")).groupBy("segment").agg(F.count("*").alias("batches"), F.count_if(F.col("n") == 60).alias("by_size"), F.count_if(F.col("n") < 60).alias("by_timer"), F.round(F.avg("n"), 9).alias("avg_batch")),
)
simple("scenario_summary", "SELECT event_type AS scenario, count(*) FILTER (value <= 50) AS passed, count(*) FILTER (value > 50) AS failed, count(*) FILTER (value > 50) = 0 AS success FROM ev GROUP BY 1", lambda ev: ev.groupBy(F.col("event_type").alias("scenario")).agg(F.count_if(F.col("value") <= 50).alias("passed"), F.count_if(F.col("value") > 50).alias("failed"), (F.count_if(F.col("value") > 50) == 0).alias("success")))

# written logs ------------------------------------------------------------------------------------------------------
# A log of the events, each segment a file; segment 0 has a wrong bit in its fifth record's payload and in its tenth's header, two in the hash before its fifteenth, and the last segment ends within its last record.
_N = "(SELECT max(segment) FROM ev)"
_DAMAGED = EV + f""", good AS (SELECT *, sequence IN (5, 10, 15) OR sequence = (SELECT max(sequence) FROM ev) AS bad FROM ev)"""


def written_log(ev: DataFrame, damage: bool = False, lose: int | None = None) -> str:
    """The folder of a log of ev; damaged as above, or without a segment's file."""
    spark = ev.sparkSession
    path = shared_dir(spark, "wal")
    wal.write_log(ev, path)
    store, _ = wal.store_of(path)
    found = [p for p, _ in wal.files(path, ".wal")]
    if lose is not None:
        for p in found:
            if int(p.rpartition("/")[2].split("-")[0]) == lose:
                store.delete_file(p)
    if damage:
        hit = list(dict.fromkeys((found[0], found[-1])))
        spark.range(0, len(hit), 1, len(hit)).mapInArrow(lambda batches: _damage(path, hit, batches), "id long").count()
    return path


def _damage(path: str, files: list[str], batches):
    """Writes a task's files again with what is wrong in them: the first of a log, and the last."""
    store, _ = wal.store_of(path)
    for batch in batches:
        for k in batch.column(0).to_pylist():
            with store.open_input_file(files[k]) as handle:
                data = bytearray(handle.read())
            rows = list(records.split(bytes(data)))
            if k == 0:
                data[rows[4].offset + records.HEAD.size + 1] ^= 1
                data[rows[9].offset + 13] ^= 2
                data[rows[14].offset + 40] ^= 3
            if k == len(files) - 1:
                del data[rows[-1].offset + records.HEAD.size + 3 :]
            with store.open_output_stream(files[k]) as handle:
                handle.write(bytes(data))
        yield batch


def read(ev: DataFrame, damage: bool = False, lose: int | None = None, mode: str = "RESYNC") -> DataFrame:
    return wal.read_log(ev.sparkSession, written_log(ev, damage, lose), mode)


simple("recovery_report", "SELECT count(*) FILTER (NOT bad) AS recovered, count(*) FILTER (bad) AS corrupted, sum(CASE WHEN NOT bad THEN 0 WHEN sequence < 16 THEN size ELSE 67 END)::BIGINT AS bytes_skipped, max(sequence) FILTER (NOT bad) AS last_good_sequence FROM good", lambda ev: recover.report(recover.recover(ev.sparkSession, written_log(ev, True))), _DAMAGED)
simple("recovered_log", "SELECT row_number() OVER (ORDER BY sequence) AS sequence, event_data, true AS linked FROM good WHERE NOT bad", lambda ev: _recovered(ev), _DAMAGED)
simple("broken_links", f"SELECT sequence, 'lost' AS kind FROM good WHERE sequence IN (6, 11, 16) UNION ALL SELECT min(sequence), 'start' FROM good GROUP BY segment", lambda ev: recover.broken_links(read(ev, True)).select("sequence", "kind"), _DAMAGED)
simple("chain_map", "SELECT sequence FROM good WHERE NOT bad", lambda ev: recover.chain_map(read(ev, True)).where(F.length("hash") == 64).select("sequence"), _DAMAGED)
simple("forensic_report", "SELECT 'standard' AS method, count(*) FILTER (NOT bad) AS pieces, sum(size - 72) FILTER (NOT bad)::BIGINT AS bytes FROM good UNION ALL SELECT 'header', 1, size - 72 FROM good WHERE sequence = 10 UNION ALL SELECT 'payload', 1, size - 72 FROM good WHERE sequence = 5 UNION ALL SELECT 'json', 1, strlen(props) FROM good WHERE sequence = 15 UNION ALL SELECT 'tail', 1, 3 FROM range(1) UNION ALL SELECT 'shadow', count(*), sum(size - 72)::BIGINT FROM good WHERE bad", lambda ev: recover.forensic_report(recover.forensic(ev.sparkSession, written_log(ev, True), written_log(ev))), _DAMAGED)
simple("strict_scan", "SELECT sequence, event_data FROM good WHERE NOT bad AND (segment > 0 OR sequence < 5)", lambda ev: read(ev, True, mode="STOP_AT_ERROR").where("parse_error is null").select("sequence", F.col("event_data").cast("string").alias("event_data")), _DAMAGED)
simple("skipping_scan", "SELECT sequence, event_data FROM good WHERE NOT bad AND (segment > 0 OR sequence < 10)", lambda ev: read(ev, True, mode="SKIP").where("parse_error is null").select("sequence", F.col("event_data").cast("string").alias("event_data")), _DAMAGED)
simple("chain_breaks_lost_segment", "SELECT min(sequence) AS sequence FROM ev WHERE segment > 0", lambda ev: wal.check_records(read(ev, lose=0)).where("not linked").groupBy().agg(F.min("sequence").alias("sequence")))
_LOST = EV + ", left_over AS (SELECT *, segment = 1 AND sequence = (SELECT min(sequence) FROM ev WHERE segment = 1) AS first_left FROM ev WHERE segment <> 0)"
simple("integrity_lost_first_segment", "SELECT count(*) AS total, 0::BIGINT AS damaged, count(*) FILTER (first_left) AS chain_breaks, count(*) FILTER (first_left) AS corrupted, max(sequence) AS last_sequence, count(*) FILTER (first_left) = 0 AS valid FROM left_over", lambda ev: verify.integrity_report(verify.check_chain(verify.chained(ev).where("segment <> 0"))).drop("last_time"), _LOST)
simple("integrity_damaged_log", "SELECT count(*) FILTER (NOT bad) AS records, count(*) FILTER (bad) AS damaged, (SELECT count(*) FROM good a JOIN good b ON b.sequence = a.sequence + 1 AND b.segment = a.segment WHERE a.bad AND NOT b.bad) AS chain_breaks, false AS valid FROM good", lambda ev: _integrity(ev), _DAMAGED)
simple("log_stats_files", f"SELECT count(*) AS total, count(DISTINCT segment) AS files, true AS has_corruption, false AS is_sealed, true AS in_order FROM good WHERE NOT bad", lambda ev: _file_stats(ev), _DAMAGED)
simple("log_continued", "SELECT sequence, event_data, true AS linked FROM ev UNION ALL SELECT sequence + (SELECT max(sequence) FROM ev), event_data, true FROM ev", lambda ev: _continued(ev))
simple("segment_catalog", "SELECT segment, min(sequence) AS start_seq, max(sequence) AS end_seq, count(*) AS record_count, sum(size)::BIGINT AS size, segment < (SELECT max(segment) FROM ev) AS sealed, false AS damaged FROM ev GROUP BY segment", lambda ev: _catalog(ev))
simple("index_saved", "SELECT segment, start_seq, end_seq FROM seg", lambda ev: _index(ev), SEG)
simple("compact_range", "SELECT CASE WHEN segment BETWEEN 1 AND 2 AND (SELECT max(segment) FROM ev) > 1 THEN 1 ELSE segment END AS segment, sequence FROM ev WHERE NOT (segment BETWEEN 1 AND 2 AND (SELECT max(segment) FROM ev) > 1 AND flags & 1 = 1)", lambda ev: maintain.compact_range(ev, replay.segments(ev), 1500, 2500).select("segment", "sequence"))
simple("index_scan", "SELECT sequence, flags, size::INTEGER AS size FROM ev", lambda ev: wal.read_headers(ev.sparkSession, written_log(ev)).select("sequence", "flags", "size"))
simple("compact_cycle", f"SELECT e.sequence, e.event_data FROM ev e JOIN seg s USING (segment) JOIN ratios r USING (segment) WHERE NOT (e.flags & 1 = 1 AND s.record_count = 1000 AND r.ratio < {CYCLE} AND s.start_time <= TIMESTAMP '{AS_OF}' - INTERVAL {POLICY.max_age_hours} HOUR)", lambda ev: maintain.compact_cycle(ev, seg_of(ev).join(stats.live_ratio(ev).select("segment", "ratio"), "segment"), CompactionPolicy(min_segments=1, target_size=POLICY.target_size, min_segment_size=1, ratio=CYCLE), AS_OF).select("sequence", "event_data"), LIVE)
simple("vacuum_rewrite", "SELECT sequence, segment FROM ev JOIN seg USING (segment) WHERE NOT (record_count = 1000 AND deleted::DOUBLE / record_count >= 0.1 AND flags & 1 = 1)", lambda ev: maintain.vacuumed(ev, seg_of(ev)).select("sequence", "segment"), SEG)
simple("merkle_proofs", "SELECT sequence, sha256(event_data) AS hash, ceil(log2((SELECT count(*) FROM ev)))::INTEGER AS steps, true AS valid FROM ev WHERE sequence % 97 = 1", lambda ev: _proofs(ev))
simple("signature_chain", "SELECT count(*) AS records, 0::BIGINT AS wrong_data, 0::BIGINT AS wrong_signatures, 0::BIGINT AS broken_links, true AS valid FROM nation", lambda spark, d: _signed(spark, d), "")
simple("custody_entries", "SELECT n_nationkey::BIGINT AS sequence, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS entry, 64 AS signature_bytes FROM nation", lambda spark, d: protect.custody(table(spark, d, "nation").withColumn("sequence", F.col("n_nationkey").cast("long")), bytes(range(32)), ("n_name", "n_regionkey")).select("sequence", "entry", F.octet_length("signature").alias("signature_bytes")), "")
simple("filter_named_level", "SELECT sequence, level FROM ev WHERE level >= 4 OR level = 2", lambda ev: ev.where(replay.condition("level >= ERROR or level = 'information'")).select("sequence", "level"))
simple("journal_scan", "SELECT event_id AS position, concat_ws('|', event_id, event_type) AS data FROM events WHERE event_id % 3 = 0", lambda spark, d: _journal(spark, d), "")
simple("backend_report", f"SELECT count(*) AS total, count(*) FILTER (sequence % 50 <> 0) AS verified, count(*) FILTER (sequence % 50 = 0) AS corrupted FROM ev", lambda ev: _backend(ev)[1])
simple("backend_range", f"SELECT sequence FROM ev WHERE sequence % 50 <> 0 AND ts > '{START}' AND ts < '{END}'", lambda ev: _backend(ev)[0])
simple("days_read", f"SELECT sequence FROM ev WHERE ts > '{START}' AND ts < '{END}'", lambda ev: _days(ev)[0])
simple("days_manifest", "SELECT count(*) AS total, count(DISTINCT date_trunc('hour', ts)) AS hours, min(ts) AS first_time, max(ts) AS last_time FROM ev", lambda ev: _days(ev)[1])
simple("csv_read_back", f"SELECT * FROM ({_EXPORT})", lambda ev: _csv(ev))
simple("replay_csv", f"SELECT {_TIME} AS Timestamp, (['VRB','DBG','INF','WRN','ERR','FTL'])[level + 1] AS Level, {_TEXT} AS Message, '{{\"Action\":\"' || event_type || '\",\"UserId\":\"' || entity_id || '\"}}' AS Properties FROM ev", lambda ev: export.replay_table(messages(ev)))


def _altered(data: Column, at: int) -> Column:
    """data with another byte at a place, counted from 0: "!", or "?" where "!" stands already."""
    return F.concat(F.substring(data, 1, at), F.when(F.substring(data, at + 1, 1) == F.lit(b"!"), F.lit(b"?")).otherwise(F.lit(b"!")), F.substring(data, at + 2, 1 << 30))


simple("bad_blocks", "SELECT page_id, CASE WHEN page_id % 4 = 1 AND strlen(html) > 1024 THEN 1 ELSE -1 END AS block FROM pages", lambda spark, d: table(spark, d, "pages").select("page_id", checksum.bad_block(F.when((F.col("page_id") % 4 == 1) & (F.octet_length("html") > 1024), _altered(F.col("html").cast("binary"), 1024)).otherwise(F.col("html").cast("binary")), checksum.block_sums(F.col("html").cast("binary"), 1024), 1024).alias("block")), "")
_BYTES = "list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(text), (2 * i - 1)::INTEGER, 2))::UTINYINT::UBIGINT)"


def _crc_table(name: str, polynomial: int) -> str:
    """The table of a cyclic sum's polynomial in SQL, eight shifts an entry."""
    step = f"CASE WHEN v & 1 = 1 THEN xor(v >> 1, {polynomial}::UBIGINT) ELSE v >> 1 END"
    return f"{name} AS (WITH RECURSIVE t AS (SELECT i, i::UBIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, {step}, k + 1 FROM t WHERE k < 8) SELECT list(v ORDER BY i) AS {name}_of FROM t WHERE k = 8)"


def _crc(name: str, bits: int) -> str:
    """A cyclic sum in SQL: a fold over the bytes."""
    most = 2**bits - 1
    return f"xor(list_reduce(list_prepend({most}::UBIGINT, bytes), lambda c, b: xor(c >> 8, {name}_of[((xor(c, b) & 255) + 1)::BIGINT])), {most}::UBIGINT)::VARCHAR AS {name}"


simple("checksum_crcs", f"WITH {_crc_table('crc32', 0xEDB88320)}, {_crc_table('crc32c', 0x82F63B78)}, {_crc_table('crc64', 0xD800000000000000)}, b AS (SELECT item_id, {_BYTES} AS bytes FROM benchmark) SELECT item_id, {_crc('crc32', 32)}, {_crc('crc32c', 32)}, {_crc('crc64', 64)} FROM b, crc32, crc32c, crc64", lambda spark, d: _crcs(spark, d), "")


simple("checksum_crc32", f"WITH {_crc_table('crc32', 0xEDB88320)}, b AS (SELECT page_id, {_BYTES.replace('text', 'url')} AS bytes FROM pages) SELECT page_id, {_crc('crc32', 32)} FROM b, crc32", lambda spark, d: table(spark, d, "pages").select("page_id", checksum.checksum(F.col("url"), "CRC32").cast("string").alias("crc32")), "")


def _crcs(spark: SparkSession, d: str) -> DataFrame:
    """As text: the largest sums of 64 bits have no signed number."""
    sums = (("CRC32", "crc32"), ("CRC32C", "crc32c"), ("CRC64", "crc64"))
    return table(spark, d, "benchmark").select("item_id", *(F.conv(F.hex(checksum.checksum(F.col("text"), a)), 16, 10).alias(name) for a, name in sums))


simple("stream_counts", f"WITH {EV} SELECT date_trunc('day', ts)::TIMESTAMP AS start, segment, count(*) AS events, count(*) FILTER (level >= 4) AS errors FROM ev WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR GROUP BY ALL", lambda spark, d: _streamed(spark, d), "")
simple("stream_alerts", f"WITH {EV}, e AS (SELECT segment, count(*) FILTER (level >= 4) // 7 AS alerts FROM ev GROUP BY segment) SELECT * FROM e WHERE alerts > 0", lambda spark, d: _alerted(spark, d), "")


def _recovered(ev: DataFrame) -> DataFrame:
    spark = ev.sparkSession
    path = shared_dir(spark, "repaired")
    wal.write_log(recover.repaired(read(ev, True)), path)
    return wal.check_records(wal.read_log(spark, path)).select("sequence", F.col("event_data").cast("string").alias("event_data"), "linked")


def _integrity(ev: DataFrame) -> DataFrame:
    rec = read(ev, True)
    checked = wal.check_records(rec).agg(F.count("*").alias("records"), F.count_if(~F.col("linked")).alias("chain_breaks"))
    return checked.crossJoin(F.broadcast(rec.agg(F.count_if(F.col("parse_error").isNotNull()).alias("damaged")))).select("records", "damaged", "chain_breaks", (F.col("damaged") + F.col("chain_breaks") == 0).alias("valid"))


def _file_stats(ev: DataFrame) -> DataFrame:
    path = written_log(ev, True)
    rec = wal.read_log(ev.sparkSession, path)
    files = catalog.with_records(catalog.discover(ev.sparkSession, path), rec)
    rows = rec.where("parse_error is null").select("sequence", F.lit(2).alias("level"), F.timestamp_micros(F.expr("ts_nanos div 1000")).alias("ts"), F.col("size").cast("long").alias("size"), F.col("path").alias("segment"))
    return stats.log_stats(rows, files).select("total", "files", "has_corruption", "is_sealed", (F.col("created_at") <= F.col("modified_at")).alias("in_order"))


def _continued(ev: DataFrame) -> DataFrame:
    path = written_log(ev)
    wal.continue_log(ev, path)
    return wal.check_records(wal.read_log(ev.sparkSession, path)).select("sequence", F.col("event_data").cast("string").alias("event_data"), "linked")


def _catalog(ev: DataFrame) -> DataFrame:
    path = written_log(ev)
    rows = catalog.with_records(catalog.discover(ev.sparkSession, path), wal.read_log(ev.sparkSession, path))
    newest = F.regexp_extract("path", r"/(\d+)-\d+-[^/]*$", 1).cast("long")  # files of one write may have one time: names tell which is the last
    last = rows.agg(F.max(newest).alias("last"))
    return rows.crossJoin(F.broadcast(last)).select(newest.alias("segment"), "start_seq", "end_seq", "record_count", "size", (newest < F.col("last")).alias("sealed"), "damaged")


def _index(ev: DataFrame) -> DataFrame:
    path = shared_dir(ev.sparkSession, "index")
    catalog.save_index(replay.segments(ev), path)
    return catalog.load_index(ev.sparkSession, path).select("segment", "start_seq", "end_seq")


def _proofs(ev: DataFrame) -> DataFrame:
    n = ev.count()
    proofs = verify.merkle_proofs(ev, ev.where("sequence % 97 = 1").select("sequence"), n)
    return verify.check_proofs(proofs, verify.merkle_root(ev, n).first()["root"]).select("sequence", "hash", F.size("proof").alias("steps"), "valid")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("segment"), F.col("n_nationkey").cast("long").alias("sequence"), F.lit(AS_OF).cast("timestamp_ntz").alias("ts"), F.col("n_name").alias("event_data"))
    key, seed = bytes(range(32)), bytes(range(1, 33))
    keys = spark.range(1).select(F.lit(crypto.key_id(key)).alias("key_id"), F.lit(bytearray(key)).alias("key"))
    return protect.chain_report(protect.verify(protect.protect(ev, "HIPAA", key, seed), keys, crypto.ed25519_public(seed)))


def _journal(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the events, two of three complete, written where they are and read as journals."""
    path = shared_dir(spark, "journal")

    def write(batches):
        store, base = wal.store_of(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            body = b"".join(records.journal_entry(k, f"{k}|{kind}".encode(), int(k % 3 > 0)) for k, kind in zip(batch.column("event_id").to_pylist(), batch.column("event_type").to_pylist(), strict=True))
            if body:
                with store.open_output_stream(f"{base}/{batch.column('event_id')[0].as_py():020d}.journal") as handle:
                    handle.write(body)
            yield batch.slice(0, 0).select(["event_id"])

    table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), "event_type").mapInArrow(write, "event_id long").count()
    return wal.incomplete(wal.read_journal(spark, path)).select("position", F.col("data").cast("string").alias("data"))


def _backend(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as a backend's JSON lines, of which each fiftieth is broken: those of a range, and the report."""
    spark = ev.sparkSession
    path = shared_dir(spark, "backend")
    line = F.when(F.col("sequence") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("sequence", "ts")))
    ev.select(line.alias("value")).write.text(path)
    rows = lambda *at: catalog.read_lines(spark, path, "sequence long, ts timestamp_ntz", *at, pattern="part-*")
    return rows(START, END).select("sequence"), catalog.line_report(rows()).where("file is null").drop("file")


def _days(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = ev.sparkSession
    path = shared_dir(spark, "days")
    export.write_days(ev.select("sequence", "ts", "level"), path)
    found = export.manifest(spark, path).agg(F.sum("records").alias("total"), F.count_distinct(F.regexp_extract("name", "(.*)/", 1)).alias("hours"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    return export.read_days(spark, path, "sequence long, ts timestamp_ntz, level int", START, END).select("sequence"), found


def _csv(ev: DataFrame) -> DataFrame:
    path = shared_dir(ev.sparkSession, "csv")
    export.export(messages(ev), path, "csv")
    return ev.sparkSession.read.option("header", True).option("escape", "\\").schema(", ".join(f"{c} string" for c in export.COLUMNS)).csv(path).fillna("", ["Exception"])


def stream_of(spark: SparkSession, d: str, parts: int = 1) -> DataFrame:
    """The events as a stream, a file a batch."""
    path = shared_dir(spark, "stream")
    events(spark, d).repartitionByRange(parts, "sequence").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _sunk(out: DataFrame, mode: str) -> DataFrame:
    """What a stream gives as it runs to its end."""
    spark, path = out.sparkSession, shared_dir(out.sparkSession, "sunk")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day of event time; days that aren't over by the watermark stay open."""
    counts = live.counts(stream_of(spark, d), "1 day", "1 hour")
    return _sunk(counts, "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "segment", "events", "errors")


def _alerted(spark: SparkSession, d: str) -> DataFrame:
    """Alerts for each seventh error of a segment, over batches that cut segments."""
    return _sunk(live.alerts(stream_of(spark, d, 3), 7), "append").groupBy("segment").agg(F.sum("alerts").alias("alerts"))


# checksums (no SQL engine at hand has these) --------------------------------------------------------------------
simple("checksums", None, lambda spark, d: table(spark, d, "benchmark").select("item_id", *(checksum.checksum(F.col("text"), a).alias(a.lower()) for a in checksum.ALGORITHMS), checksum.composite(checksum.crc32c(F.col("text").cast("binary")), F.crc32(F.col("text").cast("binary"))).alias("both")), "")
simple("block_checksums", None, lambda spark, d: table(spark, d, "pages").select("page_id", checksum.block_sums(F.col("html").cast("binary"), 1024).alias("sums")), "")
