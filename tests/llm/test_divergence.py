"""Source divergence against plain whole-number arithmetic, over hot sources, nulls, ties and many seats and buckets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditarium.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, rank int, n string"


def brute(rows, least=3, top=200):
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for own in {g[0] for g in groups}:
        kept = sorted((t for t, d in documents[own].items() if d >= least), key=lambda t: t.encode())
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (n + v) for t in kept}

        members = sorted(s for lang, s in groups if lang == own)
        p = {s: shares(groups[own, s]) for s in members}
        q = shares(sum((groups[own, s] for s in members), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in members:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in members if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if groups[own, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(own, s, part, item, -value, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found)]
    return sorted(out)


def collection(seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "étude", "ÉTUDE", "x1y", "naïve", "日本", "a_b", "zz"] + ["w" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 40)))), rng.choice(("en", "de", "de", None)), "hot" if k % 3 == 0 else f"s{rng.randint(0, 22)}") for k in range(300)]
    return rows + [(500, None, "en", "silent"), (501, "", "fr", None), (502, "12 34", "fr", "a"), (503, "only once", "es", "one"), (None, "the the zz", "de", "hot"), (504, "long " * 30000 + "tail", "en", "hot"), rows[4], rows[4]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("cells", "seat", "top"), [(1 << 17, 8, 200), (60, 1, 5), (300, 4, 3)])
def test_divergence(spark, cells, seat, top, monkeypatch):
    monkeypatch.setattr(dv, "BROADCAST", 1 if seat == 1 else 100_000)
    rows = collection()
    assert got(dv.divergence(frame(spark, rows), top=top, cells=cells, seat=seat)) == brute(rows, top=top)


def test_empty_and_single(spark):
    rows = [(1, "a b c", "en", "x")]
    assert got(dv.divergence(frame(spark, rows))) == []
    assert dv.divergence(frame(spark, rows).limit(0)).count() == 0
    assert got(dv.divergence(frame(spark, [(1, "a", "en", "x"), (2, "b", "en", "y")]))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact():
    for count, total, kept in ((10**12, 5 * 10**12, 10**6), (0, 0, 1), (9 * 10**14, 9 * 10**14, 7), (2, 3, 4)):
        assert dv.shares(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 1) // (total + kept)


def test_vectors_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        ids = np.sort(rng.choice(100_000, n, replace=False)).astype(np.int64)
        counts = rng.integers(1, 10**11, n)
        got_ids, got_counts = dv.unpacked(dv.packed(ids, counts))
        assert got_ids.tolist() == ids.tolist() and got_counts.tolist() == counts.tolist()


def test_each_two_seats_meet_once(spark):
    from pyspark.sql import functions as F

    for seats in (2, 3, 6, 7):
        m = seats + seats % 2
        df = spark.range(seats).crossJoin(spark.range(m - 1).withColumnRenamed("id", "r")).select("r", "id", dv.partner(F.col("r"), F.col("id"), F.lit(m)).alias("to"))
        met = Counter((r["id"], r["to"]) for r in df.collect() if r["to"] < seats)
        assert met == Counter((a, b) for a in range(seats) for b in range(seats) if a != b)
