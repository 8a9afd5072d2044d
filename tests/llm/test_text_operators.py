"""Operators that score or extract single texts: against plain rules, round trips and held-out accuracy."""

import hashlib
import math
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditarium.llm import html_extraction, language_id, lattice, media, shared, sharding, toxicity

DOCS = "doc_id long, text string, lang string, score double, n_words int"


def documents(spark, rows):
    """rows (doc_id, text, lang), with columns whose names clash with results."""
    return spark.createDataFrame([(*r, 9.0, 1) for r in rows], DOCS)


def test_words_are_split_at_rows_and_hashed_by_content():
    column = pa.array(["a b", None, "", "b\tabc", "x" * 70])
    rows = []
    for first, data, offsets in shared.slices(column, 4):
        starts, ends, at = shared.words(data, offsets, shared.SPACE_WORDS)
        h = shared.word_hashes(data, starts, ends)
        rows += [(first + k, h[at[k] : at[k + 1]].tolist()) for k in range(len(offsets) - 1)]
    want = [[b"a", b"b"], [], [], [b"b", b"abc"], [b"x" * 70]]
    assert rows == [(k, [shared.hash_of(w) for w in ws]) for k, ws in enumerate(want)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain words &amp; more", "plain words & more"),
        ("<body><nav><a href='/'>Home</a></nav><article><h1>T&eacute;st</h1><p>One  <b>two</b>,\n three.<p>Four<br>five.</article><div class='comments'><p>No.</p></div><footer>x</footer>", "Tést One two , three. Four five.".replace(" ,", ",")),
        ("<div id=sidebar><p>Side text, long, long, long.</p></div><div class=main><p>Body text, with marks. More of it.</p><form><p>Mail</p></form><script>if (a<b) {}</script></div>", "Body text, with marks. More of it."),
        ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
    ],
)
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


LONG = "Many long words, and some marks; here they are. " * 40


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>lead</p><div class=body><p>{0}</p><p>{0}</p></div><p>The end.</p></article>", "T lead {0} {0} The end."),
        ("<main><section><h2>One</h2><p>{0}</p><p>{0}</p></section><section><h2>Two</h2><p>Short, but text.</p></section></main>", "One {0} {0} Two Short, but text."),
        ("<body><div><a href=/>Home</a></div><div><h1>T</h1><div><p>{0}</p></div></div><div><a href=/>Terms</a></div></body>", "T {0}"),
    ],
)
def test_main_text_has_all_blocks_of_content_paths(page, text):
    assert html_extraction.main_text(page.format(LONG)) == text.format(LONG.strip())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class=x><div class='content no-sidebar'><p>{0}</p><p>{0}</p></div></body>", "{0} {0}"),
        ("<div class='has-sidebar'><div class=main><p>{0}</p></div><div class=sidebar><p>Side text, some of it.</p></div></div>", "{0}"),
        ("<article><p>{0}</p><section id='related-work'><h2>Related work</h2><p>Others did, too.</p></section><div id=discussion><h2>Discussion</h2><p>We talk.</p></div></article>", "{0} Related work Others did, too. Discussion We talk."),
        ("<article><h2 id='side-effects'>Side effects</h2><p>{0}</p><h2><span id=Tags>Tags</span></h2><p>{0}</p></article>", "Side effects {0} Tags {0}"),
        ("<div><div class=reply><p>{0}</p></div><div class=reply><p>{0}</p></div><div class=reply><p>{0}</p></div></div>", "{0} {0} {0}"),
        ("<p><span class=share>{0}</span></p>", "{0}"),
        ("<div><p>{0}</p><div class='my-related-work'><h2>More</h2><p>{0}</p></div></div>", "{0} More {0}"),
        ("<div class=ad><p>{0}</p></div><article><p>Short text.</p></article>", "Short text."),
        ("<div class=comments><p>One.</p></div><div class=related><p>Two.</p></div>", "One. Two."),
        ("<div><p>{0}</p></div><div class='site-footer'><p>All rights reserved.</p></div><div class=ads><p>Buy this, now.</p></div>", "{0}"),
    ],
)
def test_names_of_furniture_do_not_outweigh_the_text(page, text):
    assert html_extraction.main_text(page.format(LONG)) == text.format(LONG.strip())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Text. <span class='ad'><span>Buy</span> now cheap</span> End.</p></article>", "Text. End."),
        ("<article><p>Some <span class='tags'>important words</span> and a <b class='search'>hit</b>.</p></article>", "Some important words and a hit."),
        ("<article><p>One <span hidden>two <span>three</span></span>four.</p><p>Five <i class=ad>six.</p><p>Seven.</p></article>", "One four. Five Seven."),
        ("<p><span class=ad>{0}</span></p>", "{0}"),
    ],
)
def test_only_adverts_leave_running_text(page, text):
    assert html_extraction.main_text(page.format(LONG)) == text.format(LONG.strip())


@pytest.mark.parametrize("part", ["<div>", "<div>x", "<div class='ad nav'>x", "<span class=ad>x ", "<p class=ad>x", "<title>", "<ul><li>a", "<p><dl>", "<div></section>", "<div id=a><h2>A</h2>", "<!--", "<a '", '<a ">'])
def test_hostile_pages_take_linear_time(part):
    import time

    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        html_extraction.main_text(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5  # eight times the page; the square would be 64 times


class Articles(HTMLParser):
    """The text blocks of article elements by a plain walk over events: what the pages' makers call content."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks[-1] += " " if tag == "br" else ""
        if tag in ("article", "p", "h1", "h2"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("article", "p", "h1", "h2"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_give_their_articles(sf):
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist() if p]
    assert len(pages) > 20
    for page in pages:
        assert html_extraction.main_text(page) == " ".join(filter(None, (" ".join(b.split()) for b in Articles(page).blocks)))
    assert sum(html_extraction.main_text(p) != html_extraction.main_text(p, 0.0) for p in pages) > len(pages) / 2  # ratios decide


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, html_extraction.extract(pages).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_lookup_table_shares_slots_evenly_and_moves_few():
    names = [f"s{k}" for k in range(10)]
    owner = sharding.fill_table(names, 1009)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True)) < 0.25 * 1009
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 1000)
    with pytest.raises(ValueError, match="fit"):
        sharding.fill_table(names, 7)


def test_placement(spark):
    rows = documents(spark, [(1, "a", "en"), (1, "a", "en"), (None, None, None)]).withColumnRenamed("score", "shard")
    owner = sharding.fill_table([f"shard-{k:03d}" for k in range(sharding.SHARDS)], sharding.SIZE)
    for r in sharding.place(rows, "doc_id").collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % sharding.SIZE
        assert r["shard"] == owner[r["slot"]]
    assert sharding.place(rows.limit(0), "doc_id").count() == 0


def test_media_round_trip(spark):
    texts = [(1, "abc"), (2, ""), (3, None), (None, "ä" * 500), (1, "abc"), (5, "x " * 50_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", __import__("pyspark").sql.functions.lit(1))
    path = shared.shared_dir(spark, "media-test")
    media.write_archives(docs, path, archiveBytes=300)
    back = media.read_archives(spark, path, rangeBytes=200, batchBytes=100)
    got = sorted((tuple(r) for r in media.digests(back).collect()), key=str)
    want = []
    for key, text in texts:
        raw = (text or "").encode()
        payload = media.padded(raw)
        image = media.encode(raw)
        assert len(payload) % 192 == 0 and payload and media.decode(image) == (payload, len(raw))
        want.append((key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.features(payload)))
    assert got == sorted(want, key=str)
    empty = shared.shared_dir(spark, "media-empty")
    media.write_archives(docs.limit(0), empty)
    assert media.read_archives(spark, empty).count() == 0


def test_appended_archives_are_all_read(spark):
    path = shared.shared_dir(spark, "media-append")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "doc_id long, text string")
    for _ in range(2):
        media.write_archives(docs, path)
    assert sorted(r["doc_id"] for r in media.read_archives(spark, path).collect()) == [k for k in range(5) for _ in range(2)]
    media.write_archives(docs.where("doc_id < 2"), path, "overwrite")
    assert sorted(r["doc_id"] for r in media.read_archives(spark, path).collect()) == [0, 1]


def test_damaged_member_is_reported_alone(spark):
    path = shared.shared_dir(spark, "media-damaged")
    media.write_archives(spark.createDataFrame([(k, f"text {k}" * 20) for k in range(5)], "doc_id long, text string").coalesce(1), path)
    local = path.removeprefix("file://")
    import os

    (name,) = [f for f in os.listdir(local) if f.endswith(".zip")]
    data = bytearray(open(f"{local}/{name}", "rb").read())
    row = media.read_archives(spark, path).where("doc_id = 2").first()
    data[row["offset"] + 60] ^= 255
    open(f"{local}/{name}", "wb").write(data)
    rows = {r["doc_id"]: r for r in media.read_archives(spark, path).collect()}
    assert rows[2]["media"] is None and rows[2]["error"]
    assert all(rows[k]["error"] is None and rows[k]["media"] for k in (0, 1, 3, 4))


def test_language_gradients():
    rng = np.random.default_rng(1)
    layer = language_id.Layer(rng.standard_normal((256, 9)).astype(np.float64), rng.standard_normal((3, 9)))
    x, mask = rng.integers(0, 4, (5, 2)).astype(np.uint8), np.ones((5, 2))
    mask[3:, 1] = 0
    toward = rng.standard_normal((5, 2, 3)) * mask[..., None]

    def loss():
        return float((layer.forward(x, mask).astype(np.float64) * toward).sum())

    _, held = layer.forward(x, mask, keep=True)
    for part, grad in zip((layer.table, layer.recurrent), layer.backward(x, mask, held, toward), strict=True):
        for at in [(0, 0), (1, 4), (2, 8), (1, 2)]:
            old = part[at]
            part[at] = old + 1e-3
            up = loss()
            part[at] = old - 1e-3
            down = loss()
            part[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_language_probabilities_by_a_plain_recurrence():
    rng = np.random.default_rng(5)
    h, n = 4, 3
    value = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], language_id.Layer(value(256, 3 * h), value(h, 3 * h)), language_id.Layer(value(256, 3 * h), value(h, 3 * h)), value(2 * h, n), value(n))
    texts = ["", "x", "Some Text, ünd mehr", "long " * 30, None]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def run(layer, data):
        state, out = np.zeros(h), []
        for byte in data:
            a, r = layer.table[byte].astype(float), state @ layer.recurrent
            update, reset = sigmoid(a[:h] + r[:h]), sigmoid(a[h : 2 * h] + r[h : 2 * h])
            state = update * state + (1 - update) * np.tanh(a[2 * h :] + reset * r[2 * h :])
            out.append(state)
        return out

    def pooled(data):
        z = [np.concatenate(pair) @ model.out + model.bias for pair in zip(run(model.ahead, data), run(model.back, data[::-1])[::-1], strict=True)]
        p = [np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in z]
        return np.mean(p, 0) if p else np.zeros(n)

    data = [bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()) for t in texts]
    whole = language_id.scores(model, pa.array(texts), 1 << 10, 0)
    assert np.allclose(whole, [pooled(d) for d in data], atol=1e-5)
    for columns in (1, 1000):  # with as much context as there is text, windows change nothing
        assert np.allclose(language_id.scores(model, pa.array(texts), 16, 200, columns), whole, atol=1e-5)
    for context in (0, 16):  # with less, windows that don't begin as the one before ends are run again
        assert np.abs(language_id.scores(model, pa.array(texts), 16, context) - whole).max() < 0.005


def test_language_windows_of_all_lengths_are_run_again_together(monkeypatch):
    rng = np.random.default_rng(6)
    h, n = 4, 3
    value = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], *(language_id.Layer(value(256, 3 * h), value(h, 3 * h)) for _ in range(2)), value(2 * h, n), value(n))
    texts = ["".join(map(chr, rng.integers(97, 123, 32 + k))) for k in range(60)] + ["", "x", None]
    whole = language_id.scores(model, pa.array(texts), 1 << 10, 0)
    runs, plain = [], language_id.Model.probabilities
    monkeypatch.setattr(language_id.Model, "probabilities", lambda self, *args: runs.append(args) or plain(self, *args))
    assert np.abs(language_id.scores(model, pa.array(texts), 32, 0) - whole).max() < 0.05
    again = [x.shape[1] for x, _, _, _, start in runs if start is not None]
    assert sum(again) > 60 and len(again) <= 6  # 32 before, by length


def test_language_states_of_columns_in_any_order(monkeypatch):
    """Columns run only from where they begin to where they end, whatever their order; states are those of a plain run."""
    rng = np.random.default_rng(7)
    layer = language_id.Layer(rng.standard_normal((256, 9)).astype(np.float32), rng.standard_normal((3, 9)).astype(np.float32))
    x, steps, start = rng.integers(0, 256, (40, 7)).astype(np.uint8), np.arange(40)[:, None], rng.standard_normal((7, 3)).astype(np.float32)
    for begin, end in (([0] * 7, [40, 31, 30, 9, 8, 2, 0]), ([0, 2, 9, 0, 38, 39, 0], [40, 3, 30, 0, 40, 40, 1]), ([5] * 7, [7] * 7)):
        inside = (steps >= begin) & (steps < end)
        states = layer.forward(x, inside.astype(np.float32))
        out, before = layer.states(x, inside, 4)
        assert np.allclose(out, states[4:], atol=1e-5) and np.allclose(before, states[3], atol=1e-5)
    inside = steps < [40, 31, 30, 9, 8, 2, 1]
    ahead, _ = layer.states(x, inside, 0, start)
    for k, n in enumerate(inside.sum(0)):
        alone, _ = layer.states(x[:n, k : k + 1], np.ones((n, 1), bool), 0, start[k : k + 1])
        assert np.allclose(ahead[:n, k], alone[:, 0], atol=1e-5) and not ahead[n:, k].any()
    taken, take = [], np.take
    monkeypatch.setattr(language_id.np, "take", lambda rows, at, **how: taken.append(len(at)) or take(rows, at, **how))
    layer.states(x, inside, 0)
    assert sum(taken) == inside.sum()  # 280 before


def test_language_sample_draws_a_hot_text_once(spark):
    """A text of a third of all rows is one text of the sample, and no task or driver gets its copies."""
    own = language_id.Settings(per_language=40, windows_per_document=2, train_window=16)
    rows = [(f"text number {k} of many words that differ {k * k}", "en") for k in range(4000)] + [("the hot text of so many rows", "en")] * 2000 + [(f"ein Satz {k}", "de") for k in range(30)] + [("", "de"), (None, "de"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    samples, languages = language_id.sample(df, own)
    assert languages == ["de", "en"] and len([1 for _, k in samples if k == 1]) == 40 and sum(t.startswith(b"the hot") for t, _ in samples) <= 1
    assert samples == language_id.sample(df.repartition(3), own)[0]


def test_toxicity_sample_is_bounded_by_rows(spark):
    own = toxicity.Settings(per_class=100)
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5000)] + [(2, "same")] * 3000 + [(k, "other") for k in range(3, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 40)], "doc_id long, toxic int")
    rows, _ = toxicity.sample(docs, labels, own)
    found = [r["text"] for r in rows.collect()]
    assert len(found) < 250 and found.count("same") <= 1


def test_language_id(spark):
    rows = [(k, " ".join(("the water and other", "das wasser und andere")[k % 2] for _ in range(1 + k % 7)), ("en", "de")[k % 2]) for k in range(200)]
    docs = documents(spark, [*rows, (None, None, None), (900, "", "en"), (901, "123 !!", "en"), (902, "das wasser " * 30_000, None), (903, "the water", None)])
    own = language_id.Settings(hidden=6, steps=60, batch=64, per_language=200)
    model = language_id.fit(docs, own)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows) >= 195
    assert [got[k]["lang_pred"] for k in (None, 900, 901, 902, 903)] == ["und", "und", "und", "de", "en"]
    assert got[900]["score"] == 0 and 0 < got[902]["score"] <= 1
    assert language_id.fit(docs.limit(0), own) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    plain = ["some quiet words", "rain on the hill", "a note on trains"]
    rows = [(k, f"{plain[k % 3]} {k} " + ("you utter fool" if k % 4 == 0 else "you there"), "en") for k in range(400)]
    docs = documents(spark, [*rows, (1000, None, None), (1001, "", "en"), (None, "fool", "en"), (1002, "quiet " * 50_000 + "utter fool", "en")])
    labels = spark.createDataFrame([(k, k % 2, int(k % 4 == 0)) for k, _, _ in rows if k % 5] + [(None, 1, 1), (1, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    own = toxicity.Settings(bits=16, l1=0.5)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, own), own).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k, _, _ in rows)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] and got[1002] >= 0.5
    assert toxicity.fit(docs, labels.limit(0), own) is None
    assert {r["score"] for r in toxicity.score(docs, None, own).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None, own).count() == 0


def test_ftrl_by_a_plain_loop(spark):
    """Weights by the published update, one coordinate after another, over features made of words as text."""
    import random

    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(("sun", "Rain", "hill", "fool", "idiot", "tree")) for _ in range(rng.randint(0, 9)))) for k in range(60)]
    labels = [(k, int("fool" in t or "idiot" in t)) for k, t in rows if k % 3]
    own = toxicity.Settings(bits=18, l1=0.3, l2=0.2, alpha=0.7, beta=0.9, passes=2, per_class=1000)
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    places, weights = toxicity.fit(docs, marked, own)
    order = [(r["key"], r["toxic"], r["text"]) for r in toxicity.sample(docs, marked, own)[0].collect()]
    z, n = {}, {}
    sets = {}
    for _, found, owner, count in toxicity.features(pa.array([t for *_, t in order]), own):
        sets |= {i: set(found[owner == i].tolist()) | {1 << own.bits} for i in range(count)}
    for i, (*_, text) in enumerate(order):  # as many features as there are different words, beginnings, pairs and skip-grams
        w = text.lower().split()
        kinds = {("w", x) for x in w} | {("w", x[:4]) for x in w} | {(0, *p) for p in zip(w, w[1:], strict=False)} | {(s, a, b) for s in (1, 2) for a, b in zip(w, w[s + 1 :], strict=False)}
        assert len(sets[i]) == len(kinds) + 1
    value = lambda k: 0.0 if abs(z.get(k, 0.0)) <= own.l1 else -(z[k] - math.copysign(own.l1, z[k])) / ((own.beta + math.sqrt(n[k])) / own.alpha + own.l2)
    for _ in range(own.passes):
        for i in sorted(range(len(order)), key=lambda i: (order[i][0], order[i][1], len(sets[i]))):
            w = {k: value(k) for k in sets[i]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - order[i][1]
            for k in w:
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / own.alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {k: value(k) for k in z if value(k) or k == 1 << own.bits}
    assert dict(zip(places.tolist(), weights.tolist(), strict=True)).keys() == want.keys()
    assert np.allclose(weights, [want[k] for k in places.tolist()])


def test_toxicity_with_labels_of_one_kind(spark):
    docs = documents(spark, [(k, f"some words {k}", "en") for k in range(30)])
    own = toxicity.Settings(bits=12)
    for kind in (0, 1):
        labels = spark.createDataFrame([(k, kind) for k in range(20)], "doc_id long, toxic int")
        scores = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, own), own).collect()]
        assert len(scores) == 30 and all(0 <= s <= 1 and (s >= 0.5) == bool(kind) for s in scores)


def brute_forward(word, pieces, weights):
    index = {p: k for k, p in enumerate(pieces.pieces)}
    text = b" " + word
    total = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        arcs = [total[j - 1] + weights.byte[text[j - 1]]]
        arcs += [total[i] + weights.piece[index[text[i:j]]] for i in range(max(0, j - pieces.longest), j) if text[i:j] in index]
        top = max(arcs)
        total[j] = top + math.log(sum(math.exp(x - top) for x in arcs))
    return total[-1]


def segmentations(text, pieces):
    """Every way to cut text into pieces and single bytes, one by one."""
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        for kind in (["byte"] if n == 1 else []) + (["piece"] if text[:n] in pieces else []):
            for rest in segmentations(text[n:], pieces):
                yield ((kind, text[:n]), *rest)


def test_lattice_is_the_sum_over_all_segmentations():
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    index = {p: k for k, p in enumerate(pieces.pieces)}
    rng = np.random.default_rng(4)
    weights = [lattice.Weights(rng.random(len(pieces.pieces) + 256) ** 4) for _ in range(2)]
    for word in (b"the", b"inner", "für".encode(), b"?"):
        x = np.frombuffer(b" " + word, np.uint8)[None]
        into = np.zeros((2, len(pieces.pieces) + 256))
        lattice.expected(x, np.array([[2.0, 0.0]]), pieces, weights, into)
        got = lattice.forward(x, pieces, weights)[0]
        for k, own in enumerate(weights):
            price = lambda step, own=own: own.byte[step[1][0]] if step[0] == "byte" else own.piece[index[step[1]]]
            paths = {path: math.exp(sum(map(price, path))) for path in segmentations(b" " + word, index)}
            assert abs(got[k] - math.log(sum(paths.values()))) < 1e-9 and len(paths) > 1
            if not k:
                counts = np.zeros(len(into[0]))
                for path, p in paths.items():
                    for kind, part in path:
                        counts[index[part] if kind == "piece" else len(pieces.pieces) + part[0]] += 2 * p / sum(paths.values())
                assert np.allclose(counts, into[0]) and not into[1].any()


def test_probabilities_of_words_sum_to_one_at_most():
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    counts = np.full(len(pieces.pieces) + 256, 1e-9)
    letters = [x for x in range(256) if x not in b" \t\n\v\f\r"]
    counts[len(pieces.pieces) + np.array([*letters[:60], 0x20])] = 1.0  # mass on few short pieces, so that words of two letters are much of it
    index = {p: k for k, p in enumerate(pieces.pieces)}
    for p in (b" ", b"th", b"in", b" a", b" i"):
        if p in index:
            counts[index[p]] = 20.0
    weights = [lattice.Weights(counts)]
    one = np.array([[0x20, a] for a in letters], np.uint8)
    two = np.array([[0x20, a, b] for a in letters for b in letters], np.uint8)
    total = sum(np.exp(lattice.forward(x, pieces, weights)).sum() for x in (one, *np.array_split(two, 20)))
    assert 0.2 < total < 1


def test_long_words_are_one_lattice(monkeypatch):
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    weights = [lattice.Weights.first(pieces)]
    x = np.frombuffer(b" " + b"thereforeandinternational" * 9, np.uint8)[None]
    results = []
    for part in (512, 40):
        monkeypatch.setattr(lattice, "PART", part)
        into = np.zeros((1, len(pieces.pieces) + 256))
        lattice.expected(x, np.array([[3.0]]), pieces, weights, into)
        results.append((lattice.forward(x, pieces, weights), into))
    assert np.allclose(results[0][0], results[1][0]) and np.allclose(results[0][1], results[1][1])


def test_lattice_recursions():
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    weights = lattice.Weights.first(pieces)
    found = [b"the", b"internationalization", "éèê".encode(), b"%", b"ab" * 700]
    for rows, x in lattice._by_size(pa.array(found, pa.binary())):
        for k, p in zip(rows, lattice.forward(x, pieces, [weights])[:, 0], strict=True):
            assert abs(p - brute_forward(found[k], pieces, weights)) < 1e-6 * abs(p)
    into = np.zeros((1, len(pieces.pieces) + 256))
    x = np.frombuffer(b" internationalization", np.uint8)[None]
    lattice.expected(x, np.ones((1, 1)), pieces, [weights], into)
    assert abs(sum(into[0, k] * len(p) for k, p in enumerate(pieces.pieces)) + into[0, -256:].sum() - x.size) < 1e-6  # every byte is covered once


def test_lattice_scores(spark):
    rows = [(k, ("the cat and the dog " * (1 + k % 3) + f"w{k % 10}").strip(), "en") for k in range(60)] + [(70, None, None), (71, "", "en"), (72, "THE unheard-of zebra", "en"), (None, "the cat", "en"), (73, "y" * 3000 + " the " * 2000, "en")]
    docs = documents(spark, rows + [rows[0]])
    docs = docs.select("doc_id", "text", (shared.split_of("doc_id", 7) == 2).alias("held_out"))
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    tokens = lambda t: [w.encode() for w in (t or "").lower().split()] + [None]
    count = {}
    for k, t, _ in [*rows, rows[0]]:
        if not held(k):
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for head in (1, 1000):
        got = sorted((tuple(r) for r in lattice.scores(docs, public_tokenizers.path(lattice.VOCABULARY), head, 1).collect()), key=str)
        assert len(got) == len(rows) + 1
        for k, t, _ in rows:
            (r,) = {g[:6] + (round(g[6], 6),) for g in got if g[0] == k}
            ws = tokens(t)
            assert r[1:5] == (held(k), len(ws), sum(w in count for w in ws), n)
            assert abs(r[5] - sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws)) < 1e-6
            assert -math.inf < r[6] < 0
    assert lattice.scores(docs.limit(0), public_tokenizers.path(lattice.VOCABULARY), 10, 1).count() == 0
    unlearnt = lattice.scores(docs.withColumn("held_out", docs.held_out | True), public_tokenizers.path(lattice.VOCABULARY), 10, 1).first()
    assert unlearnt["n_known"] == 0 and unlearnt["train_tokens"] == 0 and unlearnt["base_score"] == 0


def test_scores_are_the_mixture_of_lattices(spark):
    """The score by a plain walk over words with the fitted weights."""
    path = public_tokenizers.path(lattice.VOCABULARY)
    pieces = lattice.vocabulary(path)
    rows = [(k, f"the cat and dog {k % 3}", "en") for k in range(12)] + [(20 + k, "der hund und die katze", "de") for k in range(6)] + [(40, "le chat", "fr"), (41, "the hund", None), (42, "unseen zebra", "en")]
    docs = documents(spark, rows).withColumn("held_out", F.col("doc_id") >= 41)
    got = {r["doc_id"]: r["score"] for r in lattice.scores(docs, path, 5, 2, 2).collect()}
    learnt = [r for r in rows if r[0] < 41]
    classes = {"en": 1, "de": 2, "fr": 3}
    words = sorted({w.encode() for _, t, _ in rows for w in t.split()})
    times = {k: [sum(t.split().count(w.decode()) for _, t, lang in learnt if classes[lang] == k) for w in words] for k in (1, 2, 3)}
    weights = [lattice.Weights.first(pieces)] * 4
    for _ in range(2):
        into = np.zeros((3, len(pieces.pieces) + 256))
        for j, w in enumerate(words):
            lattice.expected(np.frombuffer(b" " + w, np.uint8)[None], np.array([[times[k][j] for k in (1, 2, 3)]], float), pieces, weights[1:], into)
        every = into.sum(0) + lattice.PRIOR
        weights = [lattice.Weights(every), *(lattice.Weights(x + lattice.DRAWN * every / every.sum()) for x in into)]
    end = (len(learnt) + 1) / (sum(len(t.split()) + 1 for _, t, _ in learnt) + 2)
    share = np.array([12.5, 6.5, 1.5])
    share = np.append(0.05, 0.95 * share / share.sum())
    for d, t, _ in rows:
        parts = [math.log(share[k]) + math.log(end) + sum(brute_forward(w.encode(), pieces, weights[k]) + math.log(1 - end) for w in t.split()) for k in range(4)]
        assert abs(got[d] - math.log10(sum(math.exp(p - max(parts)) for p in parts)) - max(parts) / math.log(10)) < 1e-6


def test_lattice_sums_all_classes_whatever_words_are_frequent(spark):
    rare = [f"selten{k}" for k in range(40)]
    rows = [(k, "usual words of the first class " * 20, "en") for k in range(30)] + [(100 + k, " ".join(rare), "de") for k in range(10)]
    rows += [(200, "usual words " * 10 + " ".join(rare), None)]
    docs = documents(spark, rows).withColumn("held_out", F.col("doc_id") == 200)
    scores = lambda head: {r["doc_id"]: r["score"] for r in lattice.scores(docs, public_tokenizers.path(lattice.VOCABULARY), head, 1).collect()}
    some, every = scores(20), scores(1_000_000)
    assert all(abs(some[k] - every[k]) < 1e-6 for k in every)
