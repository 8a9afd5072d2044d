"""Archives whose directory is damaged, partitions of a bounded number, and long texts of few and of many words in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from auditarium.llm import media, substring_dedup
from auditarium.llm.shared import SPACE_WORDS, word_hashes, words


def archives(folder):
    return sorted(f for f in folder.iterdir() if f.name.endswith(".zip"))


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(40)] + [(None, "no id")], "doc_id long, text string").repartition(4)
    media.write_archives(docs, str(tmp_path))
    return tmp_path


def test_damaged_directories(spark, folder):
    first, second, third, _ = archives(folder)
    first.write_bytes(first.read_bytes()[:-30])  # the end of its directory is gone
    data = bytearray(second.read_bytes())
    at = data.rfind(b"PK\x01\x02")
    data[at + 10] ^= 77  # a method that nobody knows, of its last member
    second.write_bytes(bytes(data))
    data = bytearray(third.read_bytes())
    at = data.rfind(b"PK\x01\x02")
    data[at + 46 + 9] ^= 8  # its name
    third.write_bytes(bytes(data))
    for size in (16 << 20, 300):
        rows = media.read_archives(spark, str(folder), rangeBytes=size).collect()
        bad = [r for r in rows if r["error"]]
        assert sum(r["archive"] == first.name for r in rows) == 1 and [r["media"] for r in bad] == [None] * len(bad)
        assert {r["archive"]: r["error"].split(":")[0] for r in bad}[first.name] == "directory" and {r["archive"] for r in bad} <= {first.name, third.name}
        assert sum(r["archive"] == second.name for r in rows) >= 5  # its members are read by their places
        assert all(media.decode(r["media"]) for r in rows if not r["error"]) and len(rows) > 25


def test_partitions_are_bounded(folder, monkeypatch):
    reader = media._Reader({"path": str(folder), "rangeBytes": "100"})
    many = reader.partitions()
    assert len(many) > 40 and all(sum(b - a for _, a, b in p.parts) <= 100 for p in many)
    monkeypatch.setattr(media, "PARTITIONS", 3)
    few = reader.partitions()
    assert 3 <= len(few) <= 4
    for parts in (many, few):  # each byte of each archive once
        ranges = sorted(x for p in parts for x in p.parts)
        assert sum(b - a for _, a, b in ranges) == sum(f.stat().st_size for f in archives(folder)) and len(set(ranges)) == len(ranges)


@pytest.mark.parametrize("same", [True, False])
def test_long_texts_in_bounded_memory(same):
    """Twenty megabytes of one word, and of words that differ."""
    n = 4_000_000 if same else 2_600_000
    text = b"word " * n if same else b" ".join(b"%07d" % k for k in range(n))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, at = words(data, offsets, SPACE_WORDS)
    h = word_hashes(data, starts, ends)
    tracemalloc.start()
    found = substring_dedup.names(h, at, 20, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600e6 and len(found[0]) > 100_000
    if same:
        taker = substring_dedup._Units(0, 20)
        m = 300_000  # a run each: one text is kept, and a number
        part = pa.RecordBatch.from_pydict({"id": [1] * m, "dk": [2] * m, "h": found[0][:m], "lo": found[2][:m].astype(np.int32), "hi": found[3][:m].astype(np.int32)})
        list(taker.take(substring_dedup.PART, part))
        list(taker.take(substring_dedup.PART, part))  # the row is there twice
        import zstandard

        doc = pa.RecordBatch.from_pydict({"id": [1], "dk": [2], "text": [zstandard.compress(b"word " * (m + 19))]})
        list(taker.take(substring_dedup.DOCUMENT, doc))
        assert len(taker.found) == 1 and next(iter(taker.found.values())) == [m, (1, 2, 0)]
