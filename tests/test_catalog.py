"""Catalogs of segments and JSON-line backends."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from auditarium.sources import catalog, records, wal


def test_catalog(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k in range(3):
        with open(f"{folder}/{k}.wal", "wb") as f:
            f.write(b"".join(records.encode(10 * k + j, j, b"x") for j in range(1, 4)))
        os.utime(f"{folder}/{k}.wal", (1000 + k, 1000 + k))
    found = catalog.discover(spark, folder)
    rows = {r["path"].rpartition("/")[2]: r for r in catalog.with_records(found, wal.read_log(spark, folder)).collect()}
    assert [rows[f"{k}.wal"]["sealed"] for k in range(3)] == [True, True, False]
    assert [(rows[f"{k}.wal"]["start_seq"], rows[f"{k}.wal"]["end_seq"], rows[f"{k}.wal"]["record_count"]) for k in range(3)] == [(1, 3, 3), (11, 13, 3), (21, 23, 3)]
    catalog.save_index(found, f"{folder}/index")
    kept = catalog.load_index(spark, f"{folder}/index")
    os.remove(f"{folder}/1.wal")
    now = catalog.refresh(kept, catalog.discover(spark, folder))
    assert {r["path"].rpartition("/")[2]: r["corrupted"] for r in now.collect()} == {"0.wal": False, "1.wal": True, "2.wal": False}
    assert catalog.remove(now, now.where("corrupted")).count() == 2
    assert catalog.add(now, now.limit(1)).count() == 4


def test_lines(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/audit-1.json", "w") as f:
        f.write('{"ts":"2024-01-01T00:00:00","n":1}\n{"ts":"2024-01-02T00:00:00","n":2}\nbroken\n')
    with open(f"{folder}/audit-2.json", "w") as f:
        f.write('{"ts":"2024-01-03T00:00:00","n":3}\n{"n":4}\n')
    schema = "ts timestamp_ntz, n int"
    assert [r["n"] for r in catalog.read_lines(spark, folder, schema, datetime(2024, 1, 1), datetime(2024, 1, 3)).select("n").collect()] == [2]
    report = {(r["file"] or "all").rpartition("/")[2]: (r["total"], r["verified"], r["corrupted"]) for r in catalog.line_report(catalog.read_lines(spark, folder, schema)).collect()}
    assert report == {"audit-1.json": (3, 2, 1), "audit-2.json": (2, 1, 1), "all": (5, 3, 2)}
    assert len(catalog.read_lines(spark, folder, schema).where(F.col("_corrupt").isNull()).select("n", "_corrupt").collect()) == 4
