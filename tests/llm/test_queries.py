"""The registered queries on the smallest tables: against SQL where it can state them, else by their contracts."""

import hashlib
import os
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from auditarium.llm import registry

TABLES = "documents pages benchmark labels embeddings".split()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, oracle, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    relation = oracle.sql(registry.ORACLES[name])
    assert columns == sorted(relation.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall())


def test_pages_query(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    rows = __spark_entry__.queries()["op1_html_extraction"](spark, sf).collect()
    assert sorted((r["page_id"], r["url"]) for r in rows) == sorted((p["page_id"], p["url"]) for p in pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_toxicity_query(spark, sf, documents):
    rows = __spark_entry__.queries()["op2_toxicity"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_lattice_query(spark, sf, oracle):
    import math

    rows = {r["doc_id"]: r for r in __spark_entry__.queries()["op5_lattice"](spark, sf).collect()}
    docs = [(d, [*((t or "").encode().lower().split()), None]) for d, t in oracle.sql("SELECT doc_id, text FROM documents").fetchall()]
    assert len(rows) == len(docs)
    count: dict = {}
    for d, ws in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for d, ws in docs:
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(ws), sum(w in count for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
        assert -math.inf < r["score"] < 0


def test_language_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in __spark_entry__.queries()["op8_language_id"](spark, sf).collect()}
    langs = {d["lang"] for d in documents} - {None}
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["lang_pred"] in langs | {"und"} and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [(d["lang"], rows[d["doc_id"]]["lang_pred"]) for d in documents if rows[d["doc_id"]]["held_out"] and d["lang"] and len(d["text"] or "") > 100]
    assert sum(a == b for a, b in held) > 0.9 * len(held)


def test_media_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in __spark_entry__.queries()["op10_media"](spark, sf).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        raw = (d["text"] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_packing_query(spark, sf, documents):
    from test_corpus_operators import check_packed

    rows = __spark_entry__.queries()["op7_packing"](spark, sf).collect()
    assert check_packed([(d["doc_id"], d["text"]) for d in documents], rows, 2048) > 0.97


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and os.path.basename(registry.__file__) == "registry.py"
