"""Operators over whole collections: against brute force on small ones with hot groups, nulls, ties and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditarium.llm import components, decontamination, near_duplicates, packing, substring_dedup

SPACE = lambda t: (t or "").encode().split()
ALNUM = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def collection(seed=1, n=120):
    """Texts with a passage in most of them, exact and near copies, repeats within a text, short, empty and long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(45))
    rows = []
    for k in range(n):
        w = [word() for _ in range(rng.choice((3, 25, 60, 150)))]
        if k % 3:
            at = rng.randint(0, len(w))
            w[at:at] = passage.split()[rng.randint(0, 9) :]
        if k % 10 == 0:
            w += w[:30]
        rows.append((k, rng.choice((" ", "\n", " \t")).join(w)))
    rows += [(n + k, rows[3][1]) for k in range(6)] + [(n + 10 + k, rows[4][1] + f" end{k}") for k in range(5)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (None, rows[5][1]), (504, " ".join(word() for _ in range(6000))), rows[7], rows[7]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, [1]) for d, t in rows], "doc_id long, text string, n_words int, spans array<int>").repartition(3)


def brute_dedup(rows, window):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = SPACE(t)
        covered = bytearray(len(w))
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                covered[i : i + window] = b"\1" * window
            seen.add(key)
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out[d] = (len(w), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest(), kept)
    return out


@pytest.mark.parametrize(("hot", "shard"), [(2000, 8 << 20), (3, 8 << 20), (3, 5000), (2000, 2000)])
def test_substring_dedup(spark, hot, shard):
    rows = collection()
    want = brute_dedup(rows, 20)
    got = substring_dedup.dedup(frame(spark, rows), hot=hot, shard_bytes=shard).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3], r["doc_id"]
    assert substring_dedup.dedup(frame(spark, rows).limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, "other " + text), (1, text), (2, "x " * 50), (2, text + " end")]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(frame(spark, rows)).collect())
    assert sum(got.values()) == 5 and got[2, 61, 60] == 1 and got[2, 50, 49] == 1  # of x only the first word begins no later window
    assert sum((n - r) * c for (d, n, r), c in got.items() if d == 1) in (60 * 2 + 1, 61)  # which of the id's texts is first, its hash tells


def test_automaton_finds_whole_words_everywhere():
    rng = random.Random(3)
    for n_words in (5, 200, 9000):
        vocabulary = [f"{k:x}".encode() for k in range(n_words)]
        text = [rng.choice(vocabulary) for _ in range(3000)]
        passages = {b" ".join(text[a : a + rng.randint(2, 30)]): (k, k, k) for k, a in enumerate(rng.sample(range(2900), 400))}
        automaton = substring_dedup.Automaton(passages)
        text += [b"unknown", *text[:500]]
        want = {(i, i + len(p), place) for q, place in passages.items() for p in [q.split()] for i in range(len(text)) if text[i] == p[0] and text[i : i + len(p)] == p}
        assert set(automaton.found(text)) == want and len(want) >= 400
    assert list(substring_dedup.Automaton({}).found([b"a"])) == []


def test_substring_dedup_rewrites_texts(spark):
    rows = collection(2)
    want = brute_dedup(rows, 20)
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = substring_dedup.rewritten(docs).collect()
    assert got[0].asDict().keys() == set(docs.columns)
    for r in got:
        assert SPACE(r["text"]) == want[r["doc_id"]][3] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    left = Counter(r["doc_id"] for r in got)
    assert left == Counter(d for d, _ in rows if want[d][3] or not want[d][0])


@pytest.mark.parametrize(("window", "phrase"), [(20, 4), (5, 2)])
def test_phrases_name_equal_windows_alike(window, phrase):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 6, 4000).astype(np.uint64)
    at = np.array([0, 700, 700, 703, 4000])
    name, owner, lo, hi = substring_dedup.names(h, at, window, phrase)
    by = defaultdict(set)
    n = 0
    for a, o, i, j in zip(name, owner, lo, hi, strict=True):
        for k in range(i, j + 1):
            by[h[at[o] + k : at[o] + k + window].tobytes()].add(a)
            n += 1
    assert n == sum(max(0, x - window + 1) for x in np.diff(at)) and all(len(x) == 1 for x in by.values())


def brute_hits(rows, items, window):
    wanted = defaultdict(set)
    for item, t in items:
        w = ALNUM(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[i : i + window])].add("null" if item is None else str(item))
    out = {}
    for d, t in set(rows):
        w = ALNUM(t)
        covered, hit = bytearray(len(w)), set()
        for key, names in wanted.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    covered[i : i + len(key)] = b"\1" * len(key)
                    hit |= names
        out[d] = (len(w), sum(covered), len(hit), hashlib.sha256(",".join(sorted(hit)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [None, 200])
def test_decontamination(spark, monkeypatch, block):
    rows = collection(4, 60)
    items = [(1, " ".join((rows[9][1] or "x").split()[:14]).upper()), (2, "one"), (3, None), (4, ""), (5, "never anywhere " * 6), (10, rows[20][1]), (11, rows[20][1]), (None, "one")]
    if block:
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(spark, rows), table).collect()
    want = brute_hits(rows, items, 10)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]]
    assert {r["contaminated"] for r in decontamination.contamination(frame(spark, rows), table.limit(0)).collect()} == {False}
    assert decontamination.contamination(frame(spark, rows).limit(0), table).count() == 0


def test_an_index_serves_any_benchmark(spark):
    rows = collection(4, 40)
    index = decontamination.build_index(frame(spark, rows))
    total = sum(len(ALNUM(t)) for _, t in rows)
    assert sum(int(np.frombuffer(r["counts"], np.int32).sum()) for r in index.collect()) == total  # postings of every word
    for items in ([(1, rows[9][1])], [(2, "one"), (3, rows[11][1])]):
        found = decontamination.find(None, spark.createDataFrame(items, "item_id long, text string"), index=index)
        want = brute_hits(rows, items, 10)
        assert sorted((r["doc_id"] or -1, len(r["items"])) for r in found.collect()) == sorted((d or -1, want[d][2]) for d, _ in rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a quick and brown little fox"), (2, "fox brown quick"), (3, "quick brown " + "x " * 9 + "fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    hits = lambda slop: {r["doc_id"] for r in decontamination.find(docs, items, 10, slop).collect() if r["items"]}
    assert hits(0) == set() and hits(1) == {2} and hits(3) == {1, 2}


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity_is_one_run_of_one_document(spark, slop):
    rng = random.Random(slop)
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 14)))) for k in range(200)] + [(200, "q"), (201, "r s"), (202, "q x x x r x x x s"), (203, "s q r")]
    items = [("1", "a b a"), ("2", "q r s"), ("3", "c d e f")]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id string, text string")
    want = {}
    for d, text in rows:
        w, found = text.split(), []
        for name, item in items:
            need = Counter(item.split())
            holds = lambda i, j: not need - Counter(w[i:j])  # noqa: B023, E731
            found += [(i, j, name) for i in range(len(w)) for j in range(i + 1, min(len(w), i + need.total() + slop) + 1) if holds(i, j) and not holds(i + 1, j) and not holds(i, j - 1)]
        want[d] = (sorted(x[:2] for x in found), sorted({x[2] for x in found}))
    got = {r["doc_id"]: (sorted(zip(r["begins"], r["ends"], strict=True)), r["items"]) for r in decontamination.find(docs, wanted, 10, slop).collect()}
    assert got == want and not want[200][1] and want[203][1] == ["2"]


def test_rows_of_high_partitions_have_numbers(spark, monkeypatch):
    class High:
        @staticmethod
        def get():
            return High()

        def partitionId(self):  # noqa: N802
            return 5000

    monkeypatch.setattr(decontamination, "TaskContext", High)
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 8)
    docs = spark.createDataFrame([(k, "one two three") for k in range(50)], "doc_id long, text string").coalesce(1)
    rows = [r["row"] for r in decontamination.find(docs, spark.createDataFrame([("1", "two three")], "item_id string, text string")).collect()]
    assert sorted(rows) == [(5000 << 40) + k for k in range(50)]


def brute_links(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = ALNUM(t)
        sets[(d, t)] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    named = [k for k in sets if k[0] is not None]
    links, head = defaultdict(set), {k: k for k in named}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(named):
        for b in named[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    least = {}
    for k in named:
        least[find(k)] = min(least.get(find(k), k[0]), k[0])
    return {k[0]: (least[find(k)], len(links[k])) for k in named} | ({None: (None, 0)} if len(named) < len(sets) else {})


@pytest.mark.parametrize("block", [None, 8])
def test_near_duplicates(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        monkeypatch.setattr(near_duplicates, "VERIFY_BLOCK", block)
    rows = collection(5)
    base = rows[0][1] if rows[0][1] and len(rows[0][1].split()) > 100 else " ".join(f"w{k}" for k in range(120))
    for k in range(30):
        w = base.split()
        w[k * 3 % len(w)] = f"new{k}"
        rows.append((700 + k, " ".join(w)))
    got = near_duplicates.join(frame(spark, rows)).collect()
    want = brute_links(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    assert len(got) == len(set(rows))
    assert near_duplicates.join(frame(spark, rows).limit(0)).count() == 0


def test_bands():
    bands, rows = near_duplicates.bands_for(0.8, 0.9995, 64)
    assert bands * rows <= 64 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (64 // (rows + 1)) < 0.9995


@pytest.mark.parametrize(("threshold", "recall", "hashes"), [(0.8, 0.9995, 64), (0.5, 0.99, 128), (0.9, 0.999, 32)])
def test_shapes_reach_the_recall(threshold, recall, hashes):
    bands, rows, least = near_duplicates.shape_for(threshold, recall, hashes)
    agree = np.random.default_rng(1).random((200_000, hashes)) < threshold
    found = agree[:, : bands * rows].reshape(len(agree), bands, rows).all(2).any(1) & (agree.sum(1) >= least)
    assert found.mean() > recall - 3 * (recall * (1 - recall) / len(agree)) ** 0.5 - 1e-4


def test_one_id_with_several_texts_has_a_row_for_each(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (1, a)]
    got = sorted(map(tuple, near_duplicates.join(frame(spark, rows)).collect()))
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    head = {x: x for e in edges for x in e}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_packed(rows, got, length):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in set(rows):
        ids = np.append(packing.ids_of(t or ""), np.uint32(1)).astype("<u4")
        copies = sum(r == (d, t) for r in rows)
        want = [(at, min(length, len(ids) - at), zlib.crc32(ids[at : at + length].tobytes()), len(ids)) for at in range(0, len(ids), length)]
        assert sorted(docs[d]) == sorted(want * copies)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return sum(r["length"] for r in got) / len(sequences) / length


def test_packing(spark):
    rows = collection(7)
    assert check_packed(rows, packing.pack(frame(spark, rows), 256).collect(), 256) > 0.97
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", "Hello  wörld\n\n\t 12345 it's", "<|endoftext|> a <|endoftext|>", "é" * 300, "x" * 5000, " \U0001f600 á"):
        assert packing.ids_of(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_plan_places_every_piece(n):
    rng = np.random.default_rng(n)
    counts = dict(Counter(rng.integers(1, 129, n).tolist()))
    patterns = packing.plan(counts, 128)
    used = Counter()
    for pattern, times in patterns:
        assert sum(k * m for k, m in pattern.items()) <= 128
        for k, m in pattern.items():
            used[k] += m * times
    assert used == counts
    assert sum(t for _, t in patterns) <= 1.01 * sum(k * m for k, m in counts.items()) / 128 + 2


def test_knapsack():
    sizes, prices = np.array([1, 2, 3, 4]), np.array([0.1, 0.25, 0.3, 0.9])
    worth, pattern = packing.knapsack(sizes, prices, 7)
    assert abs(worth - (0.9 + 0.25 + 0.1)) < 1e-9 and sum(k * n for k, n in pattern.items()) <= 7
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 40), 8, replace=False))
        prices = rng.random(8)
        best = [0.0] * 61
        for room in range(1, 61):
            best[room] = max([best[room - 1], *(best[room - k] + p for k, p in zip(sizes, prices, strict=True) if k <= room)])
        worth, pattern = packing.knapsack(sizes, prices, 60)
        assert abs(worth - best[60]) < 1e-9 and sum(k * n for k, n in pattern.items()) <= 60
        assert abs(sum(prices[sizes.searchsorted(k)] * n for k, n in pattern.items()) - worth) < 1e-9


@pytest.mark.parametrize(("length", "lo", "hi", "n"), [(128, 32, 64, 20_000), (256, 60, 130, 5_000), (2048, 300, 1100, 50_000)])
def test_columns_beat_first_fit(length, lo, hi, n):
    counts = dict(Counter(np.random.default_rng(1).integers(lo, hi, n).tolist()))
    used = sum(times for _, times in packing.plan(counts, length))
    assert used < 0.98 * sum(times for _, times in packing.first_fit(counts, length))
    if len(counts) <= packing.CLASSES:  # each length is a class: most sequences have a pattern of the basis
        program, bound = packing.solved(counts, length)
        assert bound <= program.needs() + 1e-6 and used <= 1.01 * program.needs() + len(counts) / 4
        basis = [dict(sorted(p.items())) for p in program.basis]
        assert all(sum(k * m for k, m in p.items()) <= length for p in basis)
        assert np.allclose([sum(p.get(k, 0) * x for p, x in zip(basis, program.value, strict=True)) for k in program.sizes.tolist()], program.demand, rtol=1e-4)


def test_hot_lengths_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 16)
    rows = [(k, "one two three") for k in range(400)] + [(1000 + k, "w " * (k % 90)) for k in range(300)] + [(5000, "x " * 3000)]
    got = packing.pack(frame(spark, rows), 64).collect()
    assert check_packed(rows, got, 64) > 0.9
    assert len({r["sequence_id"] for r in got if r["sequence_id"] >= packing.WHOLE}) == sum(r["length"] == 64 for r in got)


def test_pipeline(spark):
    rng = random.Random(8)
    def text(lang, n):
        return " ".join("".join(rng.choice({"en": ["th", "er", "on", "ing"], "de": ["sch", "ü", "keit", "ung"]}[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows = [(k, text(("en", "de")[k % 2], rng.choice((90, 120, 200))), ("en", "de")[k % 2], "s", 0) for k in range(80)]
    passage = text("en", 60)
    rows = [(d, t + (" " + passage if d % 5 == 0 else ""), lang, s, n) for d, t, lang, s, n in rows]
    rows += [(100, rows[1][1], "de", "s", 0), (101, rows[1][1], None, None, None), (102, "123", "en", "s", 0), (103, None, "en", "s", 0), (None, text("en", 40), "en", "s", 0)]
    near = rows[3][1].split()
    near[5] = "other"
    rows.append((104, " ".join(near), "de", "s", 0))
    rows.append(rows[2])
    item = " ".join(rows[8][1].split()[5:20])
    docs = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(folder, name)
        stage(spark, kept, folder).write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "packing":
            assert kept.schema == docs.schema
        seen[name] = {r["doc_id"] for r in kept.select("doc_id").collect()}
    every = {r[0] for r in rows}
    assert every - seen["language"] == {102, 103}
    assert seen["language"] - seen["near_duplicates"] == {100, 101, 104}
    want = brute_dedup([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/near_duplicates").collect()], 20)
    after = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/repeated_passages").collect()}
    assert {d: SPACE(t) for d, t in after.items()} == {d: w[3] for d, w in want.items() if w[3] or not w[0]}
    assert seen["repeated_passages"] - seen["benchmark"] == {8}
    packed = spark.read.parquet(f"{folder}/packing").collect()
    check_packed([(d, t) for d, t in after.items() if d != 8], packed, 2048)
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)


def staged(spark, docs, items, folder, names=None):
    """What each stage keeps, by name."""
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        if names is None or name in names:
            stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
            docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_pipeline_keeps_columns_whatever_their_names(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(("the", "of", "and", "water", "stone", "river")) + str(rng.randint(0, 999)) for _ in range(60))
    rows = [(k, text(), "en", 123.0, "mine", k, "r", f"k{k}") for k in range(40)]
    schema = "doc_id long, text string, lang string, score double, lang_pred string, __key long, row string, key string"
    docs = spark.createDataFrame(rows, schema).repartition(2)
    kept = staged(spark, docs, [(1, "none of these words at all, not one of them here")], str(tmp_path), {"language", "near_duplicates", "repeated_passages", "benchmark"})
    for df in kept.values():
        assert df.columns == docs.columns and sorted(map(tuple, df.collect())) == sorted(rows)


def test_pipeline_with_one_id_of_two_texts_and_null_ids(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in ("river", "stone", "water"))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, c), (4, c + " end"), (1, a), (None, a), (None, None)]
    docs = spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id long, text string, lang string")
    kept = staged(spark, docs, [], str(tmp_path), {"language", "near_duplicates"})
    assert kept["language"].count() == len(rows)  # nothing to learn a language from
    got = Counter((r["doc_id"], r["text"]) for r in kept["near_duplicates"].collect())
    assert got == Counter([(1, a), (1, b), (4, c + " end"), (None, None)])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    kept = staged(spark, docs, [(1, "an item")], str(tmp_path))
    assert {n: df.count() for n, df in kept.items()} == dict.fromkeys(kept, 0) and set(kept) == {n for n, _ in corpus_pipeline.STAGES}
    assert kept["packing"].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
