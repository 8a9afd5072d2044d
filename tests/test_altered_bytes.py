"""Queries that damage what they read: the damage is there whatever the bytes were."""

import duckdb
import pytest

from auditarium.plans import catalogue


@pytest.mark.parametrize("there", ["!", "?", "x", "é"])
def test_bad_blocks_of_pages_with_any_byte_at_the_place(spark, tmp_path, there):
    pages = [(k, None if k == 13 else "a" * n + there + "b" * k) for k, n in ((1, 1024), (2, 1024), (5, 1023), (9, 5000), (13, 0), (17, 1020), (21, 1024 - len(there.encode())))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES["bad_blocks"](spark, str(tmp_path)).select("page_id", "block").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(catalogue.ORACLES["bad_blocks"]).fetchall())
