"""Commands over audit logs: verify, replay, export, stats, compact, vacuum, recover, monitor, version.

    python -m auditarium.cli stats --wal DIR --format json

A log is a folder of segments (or one file). Times are RFC 3339, now, "24h ago", "7d ago" or signed durations.
"""

from __future__ import annotations

import argparse
import csv
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditarium.functions.events import decode
from auditarium.functions.model import CompactionPolicy
from auditarium.functions.session import shared_dir
from auditarium.functions.timeexpr import parse_range
from auditarium.operators import maintain, recover, replay, stats
from auditarium.sources import catalog, export, managed, manifest, wal
from auditarium.streaming import live, source

VERSION = "0.1.0"


def _emit(ev: DataFrame, fmt: str, output: str | None) -> None:
    """To a folder if one is named, else row by row to standard output, without holding the result."""
    if output:
        export.export(ev, output, fmt)
        return
    table = export.lines(ev) if fmt == "text" else export.replay_table(ev) if fmt == "csv" else export.table(ev)
    write = csv.writer(sys.stdout, lineterminator="\n").writerow
    if fmt == "csv":
        write(table.columns)
    for row in table.toLocalIterator():
        if fmt == "csv":
            write(row)
        else:
            print(row[0] if fmt == "text" else json.dumps(row.asDict()))


def verify(spark: SparkSession, a) -> int:
    """Of a managed log by its seals (and a noted one); of others by their chains, in one scan."""
    if manifest.newest(a.wal) is not None:
        row = managed.report(spark, a.wal, a.seal).first()
        print(json.dumps(row.asDict() | {"seal": manifest.load(a.wal).seal}))
        return 0 if row["valid"] else 1
    rec = wal.read_log(spark, a.wal)
    row = wal.check_records(rec, damaged=True).agg(F.count_if(F.col("parse_error").isNull()).alias("records"), F.count_if(F.col("parse_error").isNotNull()).alias("damaged"), F.count_if(~F.col("linked")).alias("chain_breaks"), F.max("sequence").alias("last_sequence")).first()
    ok = not row["damaged"] and not row["chain_breaks"]
    print(json.dumps({"valid": ok} | row.asDict()))
    return 0 if ok else 1


def do_replay(spark: SparkSession, a) -> int:
    ev = decode(wal.read_log(spark, a.wal))
    if a.filter:
        ev = ev.where(replay.condition(a.filter))
    _emit(replay.replay(ev, *parse_range(a.start, a.end)).orderBy("sequence"), a.format, a.output)
    return 0


def do_stats(spark: SparkSession, a) -> int:
    ev = decode(wal.read_log(spark, a.wal))
    rec = wal.read_log(spark, a.wal)
    files = catalog.with_records(catalog.discover(spark, a.wal), rec)
    row = {"path": a.wal, "compression": "none"} | stats.log_stats(ev, files.withColumn("damaged", F.coalesce("damaged", F.lit(False)))).first().asDict()
    print(json.dumps(row, default=str) if a.format == "json" else "\n".join(f"{k:>14}  {v}" for k, v in row.items()))
    if a.verbose:
        replay.segments(ev).orderBy("start_seq").show(1000, False)
    return 0


def do_compact(spark: SparkSession, a) -> int:
    policy = CompactionPolicy(ratio=a.threshold)
    if manifest.newest(a.wal) is not None and not a.output and not a.dry_run:  # a managed log, in place
        state = managed.compact(spark, a.wal, policy, str(datetime.now(UTC).replace(tzinfo=None)))
        print(json.dumps({"generation": state.generation, "segments": len(state.segments), "seal": state.seal}))
        return 0
    ev = decode(wal.read_log(spark, a.wal))
    ratios = stats.live_ratio(ev)
    if a.dry_run:
        ratios.where(F.col("ratio") < policy.ratio).withColumn("gain", F.floor(F.col("size") * (1 - F.col("ratio")))).show(1000, False)
        return 0
    if not a.output:
        raise SystemExit("compact writes a new log: name it by --output")
    if a.start is not None or a.end is not None:
        rows = maintain.compact_range(ev, replay.segments(ev), a.start or 0, a.end if a.end is not None else 2**63 - 1)
    elif a.force:
        rows = maintain.compacted(ev)
    else:
        seg = replay.segments(ev)
        last = seg.agg(F.max("end_seq").alias("last"))  # the segment that is still written isn't sealed
        seg = seg.crossJoin(F.broadcast(last)).withColumn("sealed", F.col("end_seq") < F.col("last")).withColumn("created_at", F.col("start_time")).join(ratios.select("segment", "ratio"), "segment")
        rows = maintain.compact_cycle(ev, seg, policy, str(datetime.now(UTC).replace(tzinfo=None)))
    wal.write_log(rows, a.output)
    return 0


def do_vacuum(spark: SparkSession, a) -> int:
    if manifest.newest(a.wal) is not None and not a.output:
        state = managed.vacuum(spark, a.wal, a.threshold)
        print(json.dumps({"generation": state.generation, "segments": len(state.segments), "seal": state.seal}))
        return 0
    if not a.output:
        raise SystemExit("vacuum writes a new log: name it by --output")
    ev = decode(wal.read_log(spark, a.wal))
    wal.write_log(maintain.vacuumed(ev, replay.segments(ev).withColumn("sealed", F.lit(True)), a.threshold), a.output)
    return 0


def do_recover(spark: SparkSession, a) -> int:
    rec = recover.recover(spark, a.wal, a.max_record_size)
    report = recover.report(rec).first().asDict()
    if a.forensic:
        report["methods"] = {r["method"]: r["pieces"] for r in recover.forensic_report(recover.forensic(spark, a.wal, a.shadow, a.max_record_size)).collect()}
    if a.verify_checksum:
        report["broken_links"] = {r["kind"]: r["count"] for r in recover.broken_links(rec).groupBy("kind").count().collect()}
    print(json.dumps(report))
    if report["corrupted"] and not a.skip_corrupted:
        return 1
    if a.output:
        wal.write_log(recover.repaired(rec), a.output)
    return 0


def do_monitor(spark: SparkSession, a) -> int:
    if a.interval < 1:
        raise SystemExit("the interval must be a second or more")
    seen: list = []
    query = live.monitor(source.follow(spark, a.wal), a.checkpoint or shared_dir(spark, "monitor"), seen.append, f"{a.interval} seconds")
    before = None
    try:
        for k in range(a.checks or sys.maxsize):
            if k:
                query.awaitTermination(a.interval)
            else:
                query.processAllAvailable()
            row = seen[-1].asDict() if seen else {"records": 0, "errors": 0, "bytes": 0, "last_sequence": None}
            del seen[:-1]
            rate = 0.0 if before is None else (row["records"] - before) / a.interval
            before = row["records"]
            print(json.dumps(row | {"rate": rate, "alert": row["errors"] >= a.threshold}), flush=True)
    finally:
        query.stop()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditarium")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        if name != "version":
            c.add_argument("--wal", required=True)
        for names, kw in options:
            c.add_argument(*names.split(), **kw)
        c.set_defaults(run=run)

    times = [("--start", {}), ("--end", {})]
    command("verify", verify, ("--seal", {}))
    command("replay", do_replay, *times, ("--format", {"choices": ["text", "json", "csv"], "default": "text"}), ("--output", {}), ("--filter", {}))
    command("export", do_replay, *times, ("--format", {"choices": list(export.FORMATS), "default": "jsonl"}), ("--output", {"required": True}), ("--filter", {}))
    command("stats", do_stats, ("--format", {"choices": ["table", "json"], "default": "table"}), ("--verbose", {"action": "store_true"}))
    command("compact", do_compact, ("--threshold", {"type": float, "default": 0.5}), ("--dry-run", {"action": "store_true"}), ("--force", {"action": "store_true"}), ("--output", {}), ("--start", {"type": int}), ("--end", {"type": int}))
    command("vacuum", do_vacuum, ("--threshold", {"type": float, "default": 0.1}), ("--output", {}))
    command("recover", do_recover, ("--output", {}), ("--skip-corrupted", {"action": argparse.BooleanOptionalAction, "default": True}), ("--verify-checksum", {"action": "store_true"}), ("--forensic", {"action": "store_true"}), ("--shadow", {}), ("--max-record-size", {"type": int, "default": 10 << 20}))
    command("monitor", do_monitor, ("--interval", {"type": float, "default": 10}), ("--threshold", {"type": int, "default": 10}), ("--checks", {"type": int}), ("--checkpoint", {}))
    command("version", None)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    return a.run(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
