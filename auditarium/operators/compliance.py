"""Compliance transforms: required properties, masking, redaction, retention, encryption. All but signing are column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions.model import GUARDS, MISSING, PATTERNS, PROFILES, REDACTED, Profile, bounded


def profile_of(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"no profile {name}")
    return PROFILES[name]


def sensitive(key: Column, terms: tuple[str, ...]) -> Column:
    """Whether a property's name contains a term, case aside."""
    return F.coalesce(reduce(lambda a, t: a | F.lower(key).contains(t), sorted({t.lower() for t in terms}), F.lit(False)), F.lit(False))


def mask_text(x: Column) -> Column:
    """A value with its middle starred: up to 4 characters all, up to 8 the first two stay, else the first and last two."""
    n = F.length(x)
    return F.when(n <= 4, F.lit("****")).when(n <= 8, F.concat(F.left(x, F.lit(2)), F.repeat(F.lit("*"), n - 2))).otherwise(F.concat(F.left(x, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(x, F.lit(2))))


def mask_json(value: Column) -> Column:
    """A JSON value masked by its type: texts by mask_text, numbers ****, others [REDACTED]. value: its JSON text."""
    return F.when(value.startswith('"'), F.concat(F.lit('"'), mask_text(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")), F.lit('"'))).when(value.rlike(r"^-?\d"), F.lit('"****"')).otherwise(F.lit(f'"{REDACTED}"'))


def redact(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """text with what the terms stand for replaced: patterns where a term names one, else the term as a whole word, case aside."""
    for term in terms:
        kind = term.upper()
        if kind in PATTERNS:  # most texts hold nothing like it, which a plain search tells
            guard = text.contains(GUARDS[kind]) if kind == "EMAIL" else text.rlike(GUARDS[kind])
            text = F.when(guard, F.regexp_replace(text, bounded(PATTERNS[kind], kind), REDACTED)).otherwise(text)
        else:
            text = F.regexp_replace(text, "(?i)" + bounded(re.escape(term)), REDACTED)
    return text


def required(props: Column, names: tuple[str, ...], ts: Column) -> Column:
    """props (a map) with the required names it lacks: the event's time for Timestamp, else a mark."""
    add = [F.struct(F.lit(n).alias("key"), (F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if n == "Timestamp" else F.lit(MISSING)).alias("value")) for n in names]
    missing = F.filter(F.array(*add), lambda e: ~F.map_contains_key(props, e["key"])) if add else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_concat(props, F.map_from_entries(missing))


def apply_profile(ev: DataFrame, profile: str, mask: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Events with props (a map of texts) completed, masked and marked by the profile, and the template redacted, in that order.

    The record's own sequence serves as the compliance sequence, so no global numbering is needed."""
    own = profile_of(profile)
    terms = own.mask + extra
    props = required(F.col("props"), own.required, F.col("ts"))
    if mask and terms:
        props = F.transform_values(props, lambda k, v: F.when(sensitive(k, terms), mask_text(v)).otherwise(v))
    props = F.map_concat(props, F.create_map(F.lit("_compliance_profile"), F.lit(profile), F.lit("_compliance_sequence"), F.col("sequence").cast("string")))
    out = ev.withColumn("props", props)
    return out.withColumn("message_template", redact(F.col("message_template"), terms)) if mask and "message_template" in ev.columns else out


def retention(df: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows past their retention at as_of (a fixed time, so results are reproducible)."""
    return df.where(F.col(at) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


def retention_days(profile: str, wanted: int | None = None) -> int:
    """A profile's retention, or a wanted one within its bounds."""
    own = profile_of(profile)
    if wanted is None:
        return own.retention_days
    if not own.min_days <= wanted <= own.max_days:
        raise ValueError(f"{profile} retention is from {own.min_days} to {own.max_days} days, not {wanted}")
    return wanted


#: Presets of what happens to logs by age: days until compressed, archived, deleted.
LIFECYCLES = {"short": (7, 30, 90), "standard": (30, 90, 365), "long": (90, 365, 2555), "permanent": (90, 365, None)}


def lifecycle(df: DataFrame, at: str, as_of: str, preset: str, hold: Column | None = None) -> DataFrame:
    """df with age_days and action: delete, archive, compress or keep. Held rows are never deleted."""
    compress, archive, delete = LIFECYCLES[preset]
    age = F.datediff(F.lit(as_of).cast("timestamp_ntz"), F.col(at))
    hold = F.lit(False) if hold is None else hold
    action = F.when(age >= (archive), "archive").when(age >= compress, "compress").otherwise("keep")
    if delete is not None:
        action = F.when((age >= delete) & ~hold, "delete").otherwise(action)
    return df.withColumn("age_days", age).withColumn("action", action)


def protect(ev: DataFrame, key: bytes, data: str = "event_data") -> DataFrame:
    """ev with sealed: data encrypted by AES-256-GCM (nonce, ciphertext, tag), and key_id."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    own = F.lit(bytearray(key))
    return ev.withColumn("sealed", F.aes_encrypt(F.col(data).cast("binary"), own, F.lit("GCM"), F.lit("DEFAULT"))).withColumn("key_id", F.substring(F.sha2(own, 256), 1, 16))


def unprotect(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with opened (null where the key is unknown or the data is not authentic). keys: key_id, key; a small table."""
    return rows.join(F.broadcast(keys), "key_id", "left").withColumn("opened", F.try_aes_decrypt("sealed", "key", F.lit("GCM"), F.lit("DEFAULT"))).drop("key")


def rotate(rows: DataFrame, keys: DataFrame, key: bytes) -> DataFrame:
    """Sealed rows (key_id, sealed) under a new key; those that no known key opens stay as they are, with their key_id."""
    old = rows.select(F.struct("key_id", "sealed").alias("old"), *(c for c in rows.columns if c not in ("key_id", "sealed")))
    opened = unprotect(old.select("*", F.col("old.key_id").alias("key_id"), F.col("old.sealed").alias("sealed")), keys)
    new = protect(opened.drop("key_id", "sealed"), key, "opened")
    kept = F.col("opened").isNull()
    return new.withColumn("key_id", F.when(kept, F.col("old.key_id")).otherwise(F.col("key_id"))).withColumn("sealed", F.when(kept, F.col("old.sealed")).otherwise(F.col("sealed"))).select(rows.columns)


def epochs(ev: DataFrame, every: int = 1_000_000) -> DataFrame:
    """ev with epoch: which key's turn it is when a key is used `every` times. The place of a record in the log is its place in the segment plus the records of those before: one
    row a segment is summed, no task sees all records."""
    counts = ev.groupBy("segment").agg(F.count("*").alias("__n"))
    ahead = counts.select("segment", (F.sum("__n").over(Window.orderBy("segment")) - F.col("__n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy("sequence")) - 1
    return ev.withColumn("__place", place).join(ahead, "segment").withColumn("epoch", F.floor((F.col("__ahead") + F.col("__place")) / every)).drop("__place", "__ahead")


def protect_by_epoch(ev: DataFrame, keys: DataFrame, every: int = 1_000_000, data: str = "event_data") -> DataFrame:
    """ev with sealed and key_id by the key that is valid in a record's epoch: the latest of keys (first_epoch, key) that began by then; null before the first one."""
    rows = epochs(ev, every)
    found = rows.select("epoch").distinct().withColumn("key", F.lit(None).cast("binary"))  # a row for each `every` records
    marks = found.select("epoch", F.lit(1).alias("__asks"), "key").unionByName(keys.select(F.col("first_epoch").cast("long").alias("epoch"), F.lit(0).alias("__asks"), "key"))
    valid = marks.withColumn("key", F.last("key", True).over(Window.orderBy("epoch", "__asks"))).where("__asks = 1").select("epoch", "key")
    sealed = F.aes_encrypt(F.col(data).cast("binary"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"))
    return rows.join(valid, "epoch", "left").withColumn("sealed", sealed).withColumn("key_id", F.substring(F.sha2("key", 256), 1, 16)).drop("key")


def needs(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each id with an array of profile names: does any ask for encryption, for signing, and the longest retention. Unknown names count as asking nothing."""
    rows = names.select("id", F.explode_outer("names").alias("name")).join(F.broadcast(profiles), "name", "left")
    flag = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    return rows.groupBy("id").agg(flag("encryption").alias("encryption"), flag("signing").alias("signing"), F.coalesce(F.max("retention_days"), F.lit(0)).alias("max_days"))
