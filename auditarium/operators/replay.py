"""Reading events: time ranges, sequences, filters, and pruning of segments.

Predicates are plain comparisons of columns, so they reach the scan (row groups are skipped by their statistics).
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditarium.functions.model import ERROR, FLAG_DELETED, LEVEL_CODES


def _at(x: datetime | str) -> Column:
    return F.lit(x).cast("timestamp_ntz")


def _time(x: datetime | str) -> datetime:
    return x if isinstance(x, datetime) else datetime.fromisoformat(x)


_LEVEL_NAMES = {n: k for k, n in enumerate(("VERBOSE", "DEBUG", "INFORMATION", "WARNING", "ERROR", "FATAL"))} | {n: k for k, n in enumerate(LEVEL_CODES)} | {"INFO": 2, "WARN": 3}


def condition(text: str) -> Column:
    """A filter as users write it: SQL over the event's columns, in which a level may be named (level >= ERROR, level = 'warning')."""
    named = re.sub(r"(\blevel\s*(?:[<>]=?|=|==|!=|<>)\s*)'?([A-Za-z]+)'?", lambda m: m[1] + str(_LEVEL_NAMES.get(m[2].upper(), m[2])), text, flags=re.I)
    return F.expr(named)


def replay(ev: DataFrame, start=None, end=None, bounds: str = "inclusive") -> DataFrame:
    """Events between start and end, both optional. bounds: inclusive (logs) or exclusive (backends), at both ends."""
    if bounds not in ("inclusive", "exclusive"):
        raise ValueError(f"bounds must be inclusive or exclusive, not {bounds}")
    if start is not None and end is not None and _time(start) > _time(end):
        raise ValueError("start is after end")
    ts, closed = F.col("ts"), bounds == "inclusive"
    if start is not None:
        ev = ev.where(ts >= _at(start) if closed else ts > _at(start))
    if end is not None:
        ev = ev.where(ts <= _at(end) if closed else ts < _at(end))
    return ev


def live(ev: DataFrame) -> DataFrame:
    """Events without the deleted flag."""
    return ev.where(F.col("flags").bitwiseAND(FLAG_DELETED) == 0)


def find(ev: DataFrame, sequence: int, only_live: bool = False) -> DataFrame:
    """The event of a sequence number; no rows if there is none (strict callers use `found`)."""
    return (live(ev) if only_live else ev).where(F.col("sequence") == sequence)


def found(ev: DataFrame, sequence: int, only_live: bool = False):
    """The event of a sequence number as a row; raises LookupError if there is none."""
    row = find(ev, sequence, only_live).first()
    if row is None:
        raise LookupError(f"sequence {sequence} not found")
    return row


def query(ev: DataFrame, start=None, end=None, filters: list[str] | tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Events of a range that pass all filters (see condition), the first by sequence if there is a limit."""
    ev = replay(ev, start, end)
    for f in filters:
        ev = ev.where(condition(f))
    return ev if limit is None else ev.orderBy("sequence").limit(limit)


def audit_route(ev: DataFrame, prop: str = "Audit") -> DataFrame:
    """Events that go to the audit log: with the property, or errors and worse."""
    return ev.where(F.get_json_object("props", f"$.{prop}").isNotNull() | (F.col("level") >= ERROR))


def segments(ev: DataFrame) -> DataFrame:
    """One row for each segment: sequences, times, bytes, records, deleted records."""
    return ev.groupBy("segment").agg(
        F.min("sequence").alias("start_seq"), F.max("sequence").alias("end_seq"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.sum("size").alias("size"), F.count("*").alias("record_count"), F.count_if(F.col("flags").bitwiseAND(FLAG_DELETED) != 0).alias("deleted"),
    )


def prune(seg: DataFrame, start=None, end=None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Segments that overlap a time range and a range of sequences."""
    if start is not None:
        seg = seg.where(F.col("end_time") >= _at(start))
    if end is not None:
        seg = seg.where(F.col("start_time") <= _at(end))
    if first is not None:
        seg = seg.where(F.col("end_seq") >= first)
    if last is not None:
        seg = seg.where(F.col("start_seq") <= last)
    return seg
