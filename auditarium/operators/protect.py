"""Compliance records: events encrypted and signed in a chain, and their verification.

A signature covers the previous record's data hash, the record's own and its sequence, so signing and verifying need one neighbour: a lag by segment, and no
pass over the whole log. Chains begin anew with each segment.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditarium.functions import crypto
from auditarium.operators.compliance import profile_of


def _message(data_hash: bytes, prev_hash: bytes, sequence: bytes) -> bytes:
    return prev_hash + data_hash + struct.pack("<Q", int(sequence))


def _text(c: Column) -> Column:
    return c.cast("string").cast("binary")


def protect(ev: DataFrame, profile: str, key: bytes, seed: bytes | None = None, data: str = "event_data", rsa: tuple[int, int] | None = None) -> DataFrame:
    """ev as compliance records: encrypted (the profile asks for it), and signed as the profile asks if a key of that kind is given: a seed for Ed25519, or rsa
    (modulus, private exponent) for RSA-PSS. The other kind of key raises."""
    own = profile_of(profile)
    if own.signing == "RSA-PSS" and seed or own.signing == "Ed25519" and rsa:
        raise ValueError(f"{profile} asks for {own.signing} signatures")
    body = F.col(data).cast("binary")
    out = ev.select("segment", "sequence", "ts", F.lit(profile).alias("profile"), body.alias("plain"), F.unhex(F.sha2(body, 256)).alias("data_hash"))
    out = out.withColumn("prev_hash", F.coalesce(F.lag("data_hash").over(Window.partitionBy("segment").orderBy("sequence")), F.lit(bytearray(32))))
    out = out.withColumn("sealed", F.aes_encrypt("plain", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"))).withColumn("key_id", F.lit(crypto.key_id(key)))
    if not (own.signing and (seed or rsa)):
        return out.withColumn("signature", F.lit(None).cast("binary")).drop("plain")
    sign = (lambda h, p, s: crypto.ed25519_sign(seed, _message(h, p, s))) if seed else (lambda h, p, s: crypto.rsa_pss_sign(*rsa, _message(h, p, s)))
    return out.withColumn("signature", crypto.by_row(sign, "binary", F.col("data_hash"), F.col("prev_hash"), _text(F.col("sequence")))).drop("plain")


def verify(records: DataFrame, keys: DataFrame, public: bytes | tuple[int, int]) -> DataFrame:
    """records with opened, whether their data is what was hashed (data_ok), the signature holds (signed_ok, null if there is none), and the chain goes on (linked).
    public: an Ed25519 key, or modulus and exponent of an RSA one."""
    out = records.join(F.broadcast(keys), "key_id", "left").withColumn("opened", F.try_aes_decrypt("sealed", "key", F.lit("GCM"), F.lit("DEFAULT"))).drop("key")
    holds = (lambda m, x: crypto.rsa_pss_verify(*public, m, x)) if isinstance(public, tuple) else (lambda m, x: crypto.ed25519_verify(public, m, x))
    check = lambda h, p, s, x: holds(_message(h, p, s), x)
    before = F.lag("data_hash").over(Window.partitionBy("segment").orderBy("sequence"))
    return (
        out.withColumn("data_ok", F.coalesce(F.unhex(F.sha2("opened", 256)) == F.col("data_hash"), F.lit(False)))
        .withColumn("signed_ok", crypto.by_row(check, "boolean", F.col("data_hash"), F.col("prev_hash"), _text(F.col("sequence")), F.col("signature")))
        .withColumn("linked", before.isNull() | (before == F.col("prev_hash")))
    )


def chain_report(checked: DataFrame) -> DataFrame:
    """One row: records, and how many have wrong data, wrong signatures and broken links. Profiles without signatures have none to be wrong."""
    wrong = lambda c: F.count_if(~F.col(c))
    return checked.agg(F.count("*").alias("records"), wrong("data_ok").alias("wrong_data"), wrong("signed_ok").alias("wrong_signatures"), wrong("linked").alias("broken_links")).withColumn("valid", F.col("wrong_data") + F.col("wrong_signatures") + F.col("broken_links") == 0)


def custody(ev: DataFrame, seed: bytes, fields: tuple[str, ...]) -> DataFrame:
    """A signed entry of custody for each event: the fields as canonical JSON, and its signature."""
    entry = F.to_json(F.struct(*sorted(fields)))
    return ev.select("sequence", entry.alias("entry"), crypto.by_row(lambda x: crypto.ed25519_sign(seed, x), "binary", entry.cast("binary")).alias("signature"))
