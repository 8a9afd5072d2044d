"""Managed logs: a folder of segments with a manifest (see manifest), so that what is written, replaced or marked takes effect at once and whole.

Tasks write segments beside those that are there; nobody reads them until the driver commits a generation that names them. Readers hold the generation that they began with.
Compaction and vacuum take segments out and put others in by one commit; marking records as deleted writes a vector of offsets for each segment that is hit and leaves the
segments, and their hash chains, as they are. Files that no kept generation names are removed by `clean`.

Verification reads each segment once, in Spark, and folds one row a segment into seals again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditarium.functions.model import FLAG_DELETED, CompactionPolicy
from auditarium.functions.session import shared_dir
from auditarium.operators import maintain

from . import manifest, records, wal
from .manifest import FOLDER, NO_SEAL, State, store_of

ENTRY = (
    "name string, segment long, records long, first_sequence long, last_sequence long, first_nanos long, last_nanos long, size long, deleted long, deleted_bytes long, last_hash string, seal string, vector string, created double"
)


def _rename(spark: SparkSession):
    """A rename that fails where the target exists, of the session's file systems (on HDFS it is atomic)."""

    def run(source: str, target: str) -> bool:
        jvm = spark._jvm
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        store = a.getFileSystem(spark._jsc.hadoopConfiguration())
        return not store.exists(b) and store.rename(a, b)

    return run


def _commit(spark: SparkSession, path: str, actions: list[dict], base: State, **more) -> State:
    return manifest.commit(path, actions, base, rename=_rename(spark), **more)


def written(ev: DataFrame, path: str, segment_bytes: int = 64 << 20) -> list[dict]:
    """Writes events (sequence, ts, event_data, flags; segment) as segments that no generation names yet; their entries. Without a column segment, ranges of sequences of about
    segment_bytes become segments."""
    job = uuid.uuid4().hex
    store, base = store_of(path)
    if "segment" not in ev.columns:
        size = ev.agg(F.sum(F.octet_length("event_data") + records.OVERHEAD)).first()[0] or 0
        ev = ev.repartitionByRange(max(1, -(-size // segment_bytes)), "sequence").withColumn("segment", F.spark_partition_id())
    wal.write_log(ev, path, segment_bytes, job=job)
    name = f"{base}/{FOLDER}/_{job}.staged"
    with store.open_input_stream(name) as handle:
        entries = json.loads(handle.read())
    store.delete_file(name)
    return sorted(entries, key=lambda e: (e["first_sequence"], e["name"]))


def append(ev: DataFrame, path: str, segment_bytes: int = 64 << 20, stream: str | None = None, epoch: int | None = None) -> State:
    """Events (sequence, ts, event_data, flags; segment or not) behind those of a managed log, or as a new one: one generation. Their sequences must be above the log's. An epoch that a
    stream has written already changes nothing."""
    spark = ev.sparkSession
    state = manifest.load(path)
    if stream is not None and state.epochs.get(stream, -1) >= epoch:
        return state
    entries = written(ev, path, segment_bytes)
    if entries and entries[0]["first_sequence"] <= state.last_sequence():
        raise ValueError(f"sequence {entries[0]['first_sequence']} is not above the log's last one, {state.last_sequence()}")
    return _commit(spark, path, [{"add": e} for e in entries], state, stream=stream, epoch=epoch)


def numbered(ev: DataFrame, path: str, order: str = "ts") -> DataFrame:
    """ev with sequences behind the log's last one, in order of a column: ranges of it, their counts, and places in them; no task sees all rows. Ranges are put down as a table first, since
    their borders come from a sample, and counts and places must be of the same ones."""
    first, own = manifest.load(path).last_sequence(), shared_dir(ev.sparkSession, "numbered")
    ev.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id()).write.parquet(own)
    dealt = ev.sparkSession.read.parquet(own)
    part = F.shiftright("__id", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("sequence", first + F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id", "__part", "__before")


def segments(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """One row for each segment of a generation, in no order."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(e.get(c) for c in columns) for e in manifest.load(path, generation).ordered()], ENTRY)


def read(spark: SparkSession, path: str, generation: int | None = None, include_deleted: bool = True, **options) -> DataFrame:
    """Records of a generation, marked ones with the deleted flag."""
    return wal.read_log(spark, path, include_deleted=include_deleted, generation=manifest.load(path, generation).generation, **options)


def _name(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def check(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """One row for each segment of a generation, in order (place): name, segment, status and sealed.

    status: ok; missing; damaged (a checksum fails); broken (its records don't name each other); replaced (whole in itself, but other records than were committed).
    sealed: whether the seals, folded from what the files hold, still are the manifest's: the first segment that differs unseals all behind it, too."""
    state = manifest.load(path, generation)
    rows = segments(spark, path, state.generation)
    there = {f.base_name for f in store_of(path)[0].get_file_info(fs.FileSelector(store_of(path)[1])) if f.type == fs.FileType.File}
    left = [n for n in state.segments if n in there]
    rec = wal.read_log(spark, path, generation=state.generation, files=None if len(left) == len(state.segments) else left)
    good = F.col("parse_error").isNull()
    linked = wal.check_records(rec, None).groupBy(_name("path").alias("name")).agg(
        F.count("*").alias("records"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.sum(F.col("size").cast("long")).alias("size"), F.max_by("hash", "offset").alias("last_hash"), F.count_if(~F.col("inner")).alias("breaks")
    )
    damage = rec.where(~good).groupBy(_name("path").alias("name")).agg(F.count("*").alias("damage"))
    found = linked.join(damage, "name", "full_outer").select("name", F.struct(*manifest.SEALED).alias("found"), F.coalesce("breaks", F.lit(0)).alias("breaks"), F.coalesce("damage", F.lit(0)).alias("damage"))
    same = F.lit(True)
    for c in manifest.SEALED:
        same = same & F.col(c).eqNullSafe(F.col(f"found.{c}"))
    status = F.when(~F.col("there"), "missing").when(F.col("damage") > 0, "damaged").when(F.col("breaks") > 0, "broken").when(~same, "replaced").otherwise("ok")
    names = spark.createDataFrame([(n,) for n in there & set(state.segments)], "name string").withColumn("there", F.lit(True))
    joined = rows.join(names, "name", "left").withColumn("there", F.coalesce("there", F.lit(False))).join(found, "name", "left").withColumn("status", status)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, place = NO_SEAL, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                before = manifest.seal_of(before, {k: (row["found"] or {}).get(k) for k in manifest.SEALED})
                out.append((place, row["name"], row["segment"], row["first_sequence"], row["last_sequence"], row["records"], row["status"], before == row["seal"]))
                place += 1
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names="place name segment first_sequence last_sequence records status sealed".split())

    small = joined.select("name", "segment", "first_sequence", "last_sequence", "records", "seal", "status", "found")  # one row a segment: a stream through one task that keeps one hash
    return small.coalesce(1).sortWithinPartitions("first_sequence", "name").mapInArrow(fold, "place long, name string, segment long, first_sequence long, last_sequence long, records long, status string, sealed boolean")


def report(spark: SparkSession, path: str, seal: str | None = None, generation: int | None = None) -> DataFrame:
    """One row: segments, ok, missing, damaged, broken, replaced, unsealed, history_ok (all generations follow from each other), known (seal, noted elsewhere, is a generation's), valid.

    A log that was cut off together with its newest generations is whole in itself; only a noted seal tells."""
    heads = manifest.history(path, generation)
    whole = all(h["valid"] for h in heads) and (not heads or heads[-1]["root"] == manifest.load(path, generation).root())
    known = seal is None or seal in {h["seal"] for h in heads} or (seal == NO_SEAL)
    kinds = [F.count_if(F.col("status") == k).alias(k) for k in ("ok", "missing", "damaged", "broken", "replaced")]
    one = check(spark, path, generation).agg(F.count("*").alias("segments"), *kinds, F.count_if(~F.col("sealed")).alias("unsealed"))
    return one.withColumn("history_ok", F.lit(whole)).withColumn("known", F.lit(known)).withColumn("valid", (F.col("ok") == F.col("segments")) & (F.col("unsealed") == 0) & F.col("history_ok") & F.col("known"))


def candidates(state: State, low: int, high: int) -> list[str]:
    """Names of the segments that may hold sequences from low to high."""
    return [e["name"] for e in state.ordered() if e["first_sequence"] <= high and e["last_sequence"] >= low]


def find(spark: SparkSession, path: str, sequence: int, generation: int | None = None) -> DataFrame:
    """The record of a sequence: only segments whose sequences span it are read."""
    state = manifest.load(path, generation)
    return wal.read_log(spark, path, generation=state.generation, files=candidates(state, sequence, sequence)).where((F.col("parse_error").isNull()) & (F.col("sequence") == sequence))


def mark_deleted(spark: SparkSession, path: str, sequences: DataFrame) -> State:
    """Marks records (column sequence) as deleted: a vector for each segment that is hit, and one commit. Segments stay as they are; sequences that the log doesn't have change nothing."""
    state = manifest.load(path)
    ordered = state.ordered()
    if not ordered:
        return state
    firsts = np.array([e["first_sequence"] for e in ordered], np.int64)
    lasts = np.maximum.accumulate(np.array([e["last_sequence"] for e in ordered], np.int64))
    names = [e["name"] for e in ordered]

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments that may hold a batch's sequences: the last that begins before it, and those before that one that reach it."""
        for batch in batches:
            wanted = np.unique(batch.column(0).drop_null().to_numpy().astype(np.int64))
            at, found = np.searchsorted(firsts, wanted, "right") - 1, set()
            while len(at):
                inside = (at >= 0) & (lasts[np.maximum(at, 0)] >= wanted)
                found.update(at[inside].tolist())
                at, wanted = at[inside] - 1, wanted[inside]
            yield pa.RecordBatch.from_pydict({"name": pa.array([names[k] for k in sorted(found)], pa.string())})

    files = [r["name"] for r in sequences.select(F.col("sequence").cast("long").alias("sequence")).distinct().mapInArrow(hit, "name string").distinct().collect()]  # no more than segments
    if not files:
        return state
    vectors = {e["name"]: e["vector"] for e in ordered}
    _, base = store_of(path)

    def write(rows):
        store, _ = store_of(path)
        name = rows.column("name")[0].as_py()
        own, sizes = rows.column("offset").to_numpy(), rows.column("size").to_numpy()
        before = wal.read_vector(store, f"{base}/{FOLDER}/{vectors[name]}") if vectors[name] else np.zeros(0, np.int64)
        new = ~np.isin(own, before) & (rows.column("flags").to_numpy() & FLAG_DELETED == 0)
        target = f"{uuid.uuid4().hex}.vector"
        with store.open_output_stream(f"{base}/{FOLDER}/{target}") as out:
            out.write(np.unique(np.concatenate((before, own))).astype(np.int64).tobytes())
        return pa.table({"name": [name], "vector": [target], "deleted": [int(new.sum())], "bytes": [int(sizes[new].sum())]})

    heads = wal.read_headers(spark, path, files=files, generation=state.generation)
    rows = heads.join(sequences.select(F.col("sequence").cast("long").alias("sequence")).distinct(), "sequence").select(_name("path").alias("name"), "offset", F.col("size").cast("long").alias("size"), "flags")
    done = rows.groupBy("name").applyInArrow(write, "name string, vector string, deleted long, bytes long").collect()  # a row a segment
    marks = [{"mark": {"name": r["name"], "vector": r["vector"], "deleted": state.segments[r["name"]]["deleted"] + r["deleted"], "deleted_bytes": state.segments[r["name"]]["deleted_bytes"] + r["bytes"]}} for r in done if r["deleted"]]
    return _commit(spark, path, marks, state, kind="mark") if marks else state


def catalog(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """Segments as maintain's policies see them: segment (the place in order), size, sealed (all but the last), created_at (the last record's time), ratio of live bytes, start_seq."""
    state = manifest.load(path, generation)
    rows = [(k, e["name"], e["size"], k + 1 < len(state.segments), e["last_nanos"] // 1000, 1 - e["deleted_bytes"] / max(1, e["size"]), e["first_sequence"], e["records"], e["deleted"]) for k, e in enumerate(state.ordered())]
    return spark.createDataFrame(rows, "segment long, name string, size long, sealed boolean, micros long, ratio double, start_seq long, record_count long, deleted long").withColumn("created_at", F.timestamp_micros("micros").cast("timestamp_ntz")).drop("micros")


def _events(rec: DataFrame) -> DataFrame:
    return rec.where("parse_error is null").select("path", "offset", "sequence", F.timestamp_micros(F.expr("ts_nanos div 1000")).cast("timestamp_ntz").alias("ts"), "event_data", "flags")


def _replace(spark: SparkSession, path: str, state: State, into: dict[str, int], kind: str) -> State:
    """Segments (by name) rewritten as the segments that into numbers, without deleted and repeated records, by one commit. Segment i of what is new takes the number of the
    first segment that it replaces."""
    numbers = {name: state.segments[name]["segment"] for name in into}
    firsts: dict[int, int] = {}
    for e in state.ordered():
        if e["name"] in into:
            firsts.setdefault(into[e["name"]], numbers[e["name"]] or 0)
    target = spark.createDataFrame([(name, k) for name, k in into.items()], "name string, __group long")
    rec = wal.read_log(spark, path, generation=state.generation, files=list(into))
    damage = rec.where("parse_error is not null").select("path").limit(1).collect()
    if damage:
        raise ValueError(f"{damage[0]['path']} is damaged: repair comes before {kind}")
    rows = _events(rec).withColumn("name", _name("path")).join(target, "name").withColumnRenamed("__group", "segment").withColumn("copy", F.struct("name", "offset"))
    entries = written(maintain.compacted(rows).select("sequence", "ts", "event_data", "flags", "segment"), path, 1 << 62)
    actions = [{"remove": name} for name in into] + [{"add": e | {"segment": firsts[e["segment"]]}} for e in entries]
    return _commit(spark, path, actions, state, kind=kind)


def compact(spark: SparkSession, path: str, policy: CompactionPolicy, as_of: str) -> State:
    """One cycle: eligible segments (old, and small or with few live bytes) are grouped to the target size, each group becomes one segment, all by one commit. Without such groups nothing changes."""
    state = manifest.load(path)
    groups = maintain.pack(maintain.eligible(catalog(spark, path, state.generation), policy, as_of), policy).collect()  # no more than segments
    ordered = state.ordered()
    into = {ordered[k]["name"]: g["group_no"] for g in groups for k in g["segments"]}
    return _replace(spark, path, state, into, "compact") if into else state


def vacuum(spark: SparkSession, path: str, share: float = 0.1) -> State:
    """Sealed segments of which at least a share is deleted are rewritten without that, each for itself, by one commit."""
    state = manifest.load(path)
    ordered = state.ordered()
    into = {e["name"]: k for k, e in enumerate(ordered[:-1]) if e["records"] and e["deleted"] and e["deleted"] / e["records"] >= share}
    return _replace(spark, path, state, into, "vacuum") if into else state


def keep_newest(spark: SparkSession, path: str, count: int = 1000) -> State:
    """The newest segments stay, older ones go out of the log (their files stay until `clean`)."""
    state = manifest.load(path)
    old = state.ordered()[:-count]
    return _commit(spark, path, [{"remove": e["name"]} for e in old], state, kind="keep") if old else state


def clean(path: str, keep: int = 10, archive: str | None = None, before: float | None = None) -> list[str]:
    """Removes the files that none of the newest `keep` generations names: segments (into a folder archive beside them, if one is named), vectors, and what failed commits left. before:
    only files last changed before this time (seconds), so that a commit that is going on keeps its own; None spares none."""
    store, base = store_of(path)
    last = manifest.newest(path)
    if last is None:
        return []
    used: set[str] = set()
    for n in range(max(1, last - keep + 1), last + 1):
        for e in manifest.load(path, n).segments.values():
            used |= {e["name"], e["vector"]}
    gone = []
    for folder, ends in ((base, (".wal",)), (f"{base}/{FOLDER}", (".vector", ".staged"))):
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.type == fs.FileType.File and f.base_name.endswith(ends) and f.base_name not in used and (before is None or f.mtime.timestamp() < before):
                if archive and f.base_name.endswith(".wal"):
                    store.create_dir(f"{base}/{archive}", recursive=True)
                    store.move(f.path, f"{base}/{archive}/{f.base_name}")
                else:
                    store.delete_file(f.path)
                gone.append(f.base_name)
    return sorted(gone)
