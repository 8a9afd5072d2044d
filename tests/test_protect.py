"""Ciphers and signatures against the RFCs' vectors; signed chains; guards of calls."""

import pytest
from pyspark.sql import functions as F

from auditarium.functions import crypto
from auditarium.operators import protect

SEED = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
PUBLIC = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")


def test_ed25519():
    signature = crypto.ed25519_sign(SEED, b"\x72")
    assert crypto.ed25519_public(SEED) == PUBLIC
    assert signature.hex() == "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"
    assert crypto.ed25519_verify(PUBLIC, b"\x72", signature)
    assert not crypto.ed25519_verify(PUBLIC, b"\x73", signature) and not crypto.ed25519_verify(PUBLIC, b"\x72", signature[:-1])
    private, public = crypto.ed25519_pem(SEED)
    assert crypto.load_ed25519(private) == SEED and crypto.load_ed25519(public) == PUBLIC
    with pytest.raises(ValueError):
        crypto.load_ed25519("-----BEGIN X-----\nAAAA\n-----END X-----")


def test_rsa_pss():
    # primes of 2^521 - 1 and 2^607 - 1: fit for a test only
    p, q = 2**521 - 1, 2**607 - 1
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    signature = crypto.rsa_pss_sign(n, d, b"data")
    assert crypto.rsa_pss_verify(n, e, b"data", signature) and not crypto.rsa_pss_verify(n, e, b"date", signature)
    assert not crypto.rsa_pss_verify(n, e, b"data", bytes(len(signature)))


def test_chacha20_poly1305():
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.chacha20_seal(key, text, nonce)
    assert sealed[12:28].hex() == "d31a8d34648e60db7b86afbc53ef7ec2"
    assert crypto.chacha20_open(key, sealed) == text
    assert crypto.chacha20_open(key, sealed[:-1] + b"\0") is None and crypto.chacha20_open(key, b"") is None


def test_keys():
    assert len(crypto.derive_key("secret", b"0123456789abcdef")) == 32 and len(crypto.key_id(crypto.new_key())) == 16
    with pytest.raises(ValueError):
        crypto.derive_key("secret", b"short")


def test_signed_chain(spark):
    key = bytes(range(32))
    ev = spark.createDataFrame([(0, k, f"event {k}") for k in range(1, 7)], "segment long, sequence long, event_data string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    records = protect.protect(ev, "HIPAA", key, SEED)
    rows = records.collect()
    keys = spark.createDataFrame([(crypto.key_id(key), bytearray(key))], "key_id string, key binary")
    kept = spark.createDataFrame(rows, records.schema)
    assert protect.chain_report(protect.verify(kept, keys, PUBLIC)).first().asDict() == {"records": 6, "wrong_data": 0, "wrong_signatures": 0, "broken_links": 0, "valid": True}
    changed = kept.withColumn("data_hash", F.when(F.col("sequence") == 3, F.unhex(F.sha2(F.lit(b"x"), 256))).otherwise(F.col("data_hash")))
    report = protect.chain_report(protect.verify(changed, keys, PUBLIC)).first()
    assert (report["wrong_data"], report["wrong_signatures"], report["broken_links"], report["valid"]) == (1, 1, 1, False)
    unsigned = protect.protect(ev, "GDPR", key, SEED)
    assert protect.chain_report(protect.verify(unsigned, keys, PUBLIC)).first()["valid"]
    entry = protect.custody(ev.limit(1), SEED, ("sequence", "event_data")).first()
    assert crypto.ed25519_verify(PUBLIC, entry["entry"].encode(), bytes(entry["signature"]))
