"""Row functions: checksums, masks, times, bytes, records; fixtures of the blueprint with a fixed anchor."""

import struct
import zlib
from datetime import datetime

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditarium.functions import checksum, model, timeexpr
from auditarium.operators import compliance
from auditarium.sources import export, records

NOW = datetime(2024, 1, 1)


def test_checksums_of_the_check_string(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "b binary")
    rows = df.select(*(checksum.checksum(F.col("b"), a).alias(a) for a in checksum.ALGORITHMS)).collect()
    assert rows[0].asDict() == {"CRC32": 0xCBF43926, "CRC32C": 0xE3069283, "CRC64": 0xB90956C775A41001 - (1 << 64), "XXHash64": checksum._signed(xxhash.xxh64_intdigest(b"123456789"))}
    assert (rows[1]["CRC32C"], rows[1]["CRC64"]) == (0, 0) and set(rows[2]) == {None}
    with pytest.raises(ValueError, match="no checksum"):
        checksum.checksum(F.col("b"), "MD4")


def test_blocks_and_mismatches(spark):
    data = bytes(range(256)) * 40
    bad = bytearray(data)
    bad[2048] ^= 1
    df = spark.createDataFrame([(bytearray(data), bad, bytearray(b""))], "good binary, bad binary, none binary")
    sums = checksum.block_sums(F.col("good"), 1024)
    row = df.select(sums.alias("sums"), checksum.bad_block(F.col("good"), sums, 1024).alias("ok"), checksum.bad_block(F.col("bad"), sums, 1024).alias("bad"), checksum.block_sums(F.col("none"), 1024).alias("none"), checksum.first_mismatch(F.col("good"), {"CRC64": checksum.crc64(F.col("good")), "CRC32": F.lit(1)}).alias("wrong"), checksum.composite(F.lit(1), F.lit(-1)).alias("both")).first()
    assert row["sums"] == [zlib.crc32(data[k : k + 1024]) for k in range(0, len(data), 1024)]
    assert (row["ok"], row["bad"], row["none"], row["wrong"], row["both"]) == (-1, 2, [], "CRC32", (1 << 32) + 0xFFFFFFFF)


def test_rolling_sums(spark):
    data = b"a rolling window of bytes"
    row = spark.createDataFrame([(bytearray(data),)], "b binary").select(checksum.rolling(F.col("b"), 7).alias("r")).first()
    assert row["r"] == [zlib.adler32(data[k : k + 7]) for k in range(len(data) - 6)]


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (512, "512 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1 << 20, "1.0 MB"), (1 << 30, "1.0 GB"), (1 << 40, "1.0 TB")])
def test_format_bytes(spark, n, text):
    assert spark.range(1).select(model.format_bytes(F.lit(n)).alias("t")).first()["t"] == text


def test_level_codes(spark):
    assert [r["c"] for r in spark.range(-1, 8).orderBy("id").select(model.level_code(F.col("id").cast("int")).alias("c")).collect()] == ["L-1", "VRB", "DBG", "INF", "WRN", "ERR", "FTL", "L6", "L7"]


@pytest.mark.parametrize(("value", "masked"), [("ab", "****"), ("abcd", "****"), ("abcde", "ab***"), ("abcdefgh", "ab******"), ("123-45-6789", "12*******89"), (None, None)])
def test_mask_text(spark, value, masked):
    assert spark.createDataFrame([(value,)], "v string").select(compliance.mask_text(F.col("v")).alias("m")).first()["m"] == masked


def test_mask_json_by_type(spark):
    rows = spark.createDataFrame([(x,) for x in ('"123-45-6789"', "12", "-1.5", "true", "null", '{"a":1}', "[1]")], "v string")
    assert [r["m"] for r in rows.select(compliance.mask_json(F.col("v")).alias("m")).collect()] == ['"12*******89"', '"****"', '"****"', *['"[REDACTED]"'] * 4]


def test_redaction(spark):
    text = "SSN 123-45-6789, ü123-45-6789, x123-45-6789, mail a.b@c.org, +1 (555) 123-4567, 10.0.0.1, AB123456, 4111 1111 1111 1111, pin"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    redacted = lambda *terms: df.select(compliance.redact(F.col("t"), terms).alias("r")).first()["r"]
    assert redacted("ssn").startswith("SSN [REDACTED], ü[REDACTED], x123-45-6789,")
    assert "mail [REDACTED]," in redacted("email") and ", [REDACTED], 4111" in redacted("mrn") and redacted("PIN").endswith(", [REDACTED]")
    assert redacted("ip").count("[REDACTED]") == 1 and redacted("pan").endswith("[REDACTED], pin")


def test_profiles_mask_and_complete(spark):
    ev = spark.createDataFrame([(7, datetime(2024, 1, 1, 1, 2, 3), {"SSN": "123-45-6789", "PatientId": "P-001", "UserId": "D-001", "Action": "VIEW", "shipping": "fast-one"}, "Email of {UserId}")], "sequence long, ts timestamp_ntz, props map<string,string>, message_template string")
    got = compliance.apply_profile(ev, "HIPAA").first()
    assert got["props"] == {"SSN": "12*******89", "PatientId": "P-001", "UserId": "D-001", "Action": "VIEW", "shipping": "fast-one", "Timestamp": "2024-01-01T01:02:03.000000Z", "IPAddress": "[MISSING_REQUIRED]", "_compliance_profile": "HIPAA", "_compliance_sequence": "7"}
    assert compliance.apply_profile(ev, "PCI-DSS").first()["props"]["shipping"] == "fa******"
    assert compliance.apply_profile(ev, "GDPR", mask=False).first()["message_template"] == "Email of {UserId}"
    with pytest.raises(ValueError, match="no profile"):
        compliance.apply_profile(ev, "ISO")


def test_retention_bounds():
    assert compliance.retention_days("HIPAA", 2555) == 2555 and compliance.retention_days("GDPR") == 1095
    for days in (100, 5000):
        with pytest.raises(ValueError, match="retention"):
            compliance.retention_days("HIPAA", days)


def test_profile_predicates(spark):
    names = [["HIPAA"], ["PCI-DSS"], ["SOX"], ["GDPR"], ["INVALID"], [], ["GDPR", "HIPAA"]]
    rows = compliance.needs(spark.createDataFrame(list(enumerate(names)), "id long, names array<string>"), model.profiles(spark)).orderBy("id").collect()
    assert [r["encryption"] for r in rows] == [True, True, True, True, False, False, True]
    assert [r["signing"] for r in rows] == [True, True, True, False, False, False, True]
    assert [r["max_days"] for r in rows] == [2190, 365, 2555, 1095, 0, 0, 2190]


def test_sealing(spark):
    key = b"test-key-32-bytes-long-exactly!!"
    ev = compliance.protect(spark.createDataFrame([("secret",)], "event_data string"), key)
    keys = spark.createDataFrame([(ev.first()["key_id"], bytearray(key))], "key_id string, key binary")
    assert bytes(compliance.unprotect(ev, keys).first()["opened"]) == b"secret"
    assert compliance.unprotect(ev.withColumn("sealed", F.concat(F.col("sealed"), F.lit(b"x"))), keys).first()["opened"] is None
    assert compliance.unprotect(ev, keys.limit(0)).first()["opened"] is None


def test_rendering(spark):
    df = spark.createDataFrame([("{Name} paid {amount:F2} to {who}", {"Name": "A $1 \\ b", "amount": "5"})], "t string, p map<string,string>")
    assert df.select(export.render(F.col("t"), F.col("p")).alias("m")).first()["m"] == "A $1 \\ b paid 5 to {who}"


@pytest.mark.parametrize(("text", "want"), [("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05+01:00", datetime(2024, 1, 2, 2, 4, 5)), ("now", NOW), ("24h ago", datetime(2023, 12, 31)), ("7d ago", datetime(2023, 12, 25)), ("-2h30m", datetime(2023, 12, 31, 21, 30)), ("1.5h", datetime(2024, 1, 1, 1, 30))])
def test_times(text, want):
    assert timeexpr.parse_time(text, NOW) == want


@pytest.mark.parametrize("text", ["", "yesterday", "5", "1x", "h"])
def test_bad_times(text):
    with pytest.raises(ValueError, match="unrecognized"):
        timeexpr.parse_time(text, NOW)


def test_bad_settings():
    for bad in ({"segment_bytes": 0}, {"sync": "never"}, {"sync_ms": 0}, {"profile": "ISO"}):
        with pytest.raises(ValueError):
            model.LogConfig(**bad)
    with pytest.raises(ValueError):
        model.CompactionPolicy(ratio=2)
    assert export.backend("s3", "read") == "s3"
    with pytest.raises(export.Unsupported):
        export.backend("gcs", "read")


def test_record_layout():
    raw = records.encode(42, 5, b"{}", b"\1" * 32, 1)
    assert len(raw) == 72 + 2 and raw[:4] == b"GLTM" and struct.unpack_from("<HHIq", raw, 4) == (1, 1, 2, 5)
    got = records.record_at(raw, 0)
    assert (got.sequence, got.flags, got.event_data, got.prev_hash) == (42, 1, b"{}", b"\1" * 32)


def test_junk_between_records():
    a, b = records.encode(1, 0, b"one"), records.encode(2, 0, b"two")
    got = list(records.split(a + b"CORRUPTED DATA HERE!!!" + b))
    assert [x.event_data if isinstance(x, records.Record) else x.size for x in got] == [b"one", 22, b"two"]
    assert [type(x) for x in records.split(a + b"junk" + b, "STOP_AT_ERROR")] == [records.Record, records.Damage]
    assert [x.size for x in records.split(a + b[:-1]) if isinstance(x, records.Damage)] == [len(b) - 1]


@given(st.lists(st.binary(max_size=60), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 7)), max_size=5), st.integers(0, 2000))
def test_damage_never_yields_wrong_records(payloads, flips, cut):
    whole = [records.encode(k, k, p) for k, p in enumerate(payloads)]
    data = bytearray(b"".join(whole))
    for at, bit in flips:
        data[at % len(data)] ^= 1 << bit
    if cut < len(data):
        del data[cut:]
    got = list(records.split(bytes(data)))
    assert all(bytes(data[x.offset : x.offset + x.size]) in whole for x in got if isinstance(x, records.Record))
    assert sum(x.size for x in got) == len(data)


def test_header_repair_and_json_carving():
    raw = bytearray(records.encode(9, 9, b'{"a":1}'))
    raw[13] ^= 4
    assert records.record_at(bytes(raw), 0) == "header checksum"
    assert records.flipped_header(bytes(raw), 0).sequence == 9
    assert records.json_objects(b'xx{"a":"}"}yy{"b":{"c":1}}{') == [(2, b'{"a":"}"}'), (13, b'{"b":{"c":1}}')]


def test_salvage_goes_on_within_a_run():
    raws = [bytearray(records.encode(k, 9, b'{"a":%d}' % k)) for k in range(4)]
    for raw, place in zip(raws, (13, 1, 60, 9), strict=True):
        raw[place] ^= 4
    assert list(records.salvaged(bytes(raws[2]))) == [(0, "payload", b'{"a":2}')]  # a wrong bit of the hash before it
    raws[2][61] ^= 1  # and another: what is left is its JSON
    run = b"??" + b"".join(map(bytes, raws))
    size = len(raws[0])
    assert [tuple(x) for x in records.salvaged(run)] == [(2, "header", b'{"a":0}'), (2 + size, "header", b'{"a":1}'), (2 + 2 * size + records.HEAD.size, "json", b'{"a":2}'), (2 + 3 * size, "header", b'{"a":3}')]


def test_journal():
    data = b"".join(records.journal_entry(at, b"x" * 5, k == 1) for k, at in enumerate((0, 100, 200)))
    assert [(s, p, e) for _, s, p, _, e in records.journal(data)] == [(0, 0, None), (1, 100, None), (0, 200, None)]
    broken = bytearray(data)
    broken[-1] ^= 1
    assert [e for *_, e in records.journal(bytes(broken))] == [None, None, "checksum"]
    assert len(list(records.journal(data[:-1]))) == 2
