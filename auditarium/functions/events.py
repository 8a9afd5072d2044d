"""Payloads of records as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditarium.functions.model import LEVEL_CODES

PAYLOAD = "Timestamp string, Level int, MessageTemplate string, Properties map<string,string>, Exception string"


def decode(rec: DataFrame) -> DataFrame:
    """Records as events. A payload is a JSON event; anything else is its own message. properties has its values as text, typed as they are (numbers, truth values, nested ones)."""
    text = F.col("event_data").cast("string")
    body = F.from_json(text, PAYLOAD)
    at = F.timestamp_micros(F.expr("ts_nanos div 1000")).cast("timestamp_ntz")
    typed = F.try_variant_get(F.try_parse_json(text), "$.Properties", "map<string,variant>")
    return rec.where("parse_error is null").select(
        "path", "offset", "sequence", at.alias("ts"), F.coalesce(body["Level"], F.lit(LEVEL_CODES.index("INF"))).alias("level"), F.coalesce(body["MessageTemplate"], text).alias("message_template"),
        F.coalesce(body["Properties"], F.create_map().cast("map<string,string>")).alias("properties"), typed.alias("typed"), body["Exception"].alias("exception"), body["Properties"]["entity_id"].alias("entity_id"),
        "flags", F.xxhash64("path").alias("segment"), "event_data", F.col("size").cast("long").alias("size"), "prev_hash", "hash",
    )


def typed(name: str, kind: str) -> Column:
    """A property of a decoded event in its type; null where it is missing or of another one."""
    return F.try_variant_get(F.col("typed")[name], "$", kind)
