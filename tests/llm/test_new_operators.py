"""Operators 11 to 13 against brute force, on planted cases and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from veilspark.llm import _base, crc_resample, exact_dedup, order_minhash, page_template, simhash, toxicity_mil, whiten

# 11 importance resampling


def features(text, n):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[k : k + m]) for m in range(1, n + 1) for k in range(len(words) - m + 1)]


def resampled(docs, target, n=1, size=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, t = Counter(bucket(f) for _, x in docs for f in features(x, n)[1]), Counter(bucket(f) for x in target for f in features(x, n)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size)))) for b in range(size)]
    rows = []
    for i, x in docs:
        words, found = features(x, n)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted(map(str, (r[:5] for r in rows)))


def shown(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_resample_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    assert shown(crc_resample.op11_crc_resample(spark, TINY)) == resampled(docs, target)


@pytest.mark.parametrize("n", [2, 3])
def test_runs_of_words(spark, odd, n):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.text is None or len(r.text) < 1000]
    target = ["same row of words", None, "Über ÄÖ"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = crc_resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n, 97, 60, 2)
    assert shown(got) == resampled(rows, target, n, 97, 60, 2)


def test_pieces_of_a_long_text_join(monkeypatch):
    text = "Alpha beta, gamma\x00delta " * 50 + "ÄÖ ß9"
    whole = [x.tolist() for _, x in crc_resample.ring(text, 3)]
    monkeypatch.setattr(crc_resample, "_BYTES", 7)
    assert Counter(sum((x.tolist() for _, x in crc_resample.ring(text, 3)), [])) == Counter(sum(whole, []))
    assert Counter(sum(whole, [])) == Counter(zlib.crc32(f.encode()) for f in features(text, 3)[1])


def test_resample_of_odd_and_empty_tables(odd, none, spark):
    target = spark.createDataFrame([("word same",)], "text string")
    got = crc_resample.resample(odd, target, percent=100, least_words=1)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert got.count() == odd.count() and ranks == list(range(1, len(ranks) + 1))
    assert crc_resample.resample(none, target).count() == 0
    assert {r.weight for r in crc_resample.resample(odd, none).where("n_features = 0").collect()} == {0}
    kept = crc_resample.scored(odd, [0] * 5)  # clashing columns stay
    assert set(odd.columns) < set(kept.columns) and "_score" in kept.columns


# 12 main text of pages


def extracted(spark, rows):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in page_template.extract(df).orderBy("page_id").collect()]


def plain(source):
    import html

    a = source[source.find("<article>") + 9 : source.find("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", a)]
    return "\n".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{TINY}/pages.parquet").collect()}
    got = page_template.op12_page_template(spark, TINY).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_parts_that_are_not_the_article(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies</p></div><form id="whole"><main><p>outside</p>
<article class="post"><header><h1>Title &amp; more</h1><p>By Ann</p></header><p>First&nbsp;one<br>goes
 <b>on</b> &lt;here&gt;</p><div class="ad-box"><p>Buy</p></div><script>var a = "<p>no</p>";</script><ul><li>one<li>two</ul>
<section class="comments"><article class="comment"><p>me too</p></article></section></article></main></form><aside>side</aside><div class="siteFooter">foot</div></body></html>"""
    assert extracted(spark, [("http://a/1", page)]) == ["Title & more\nFirst one goes on <here>\none\ntwo"]


def test_malformed_and_empty(spark):
    pages = [
        None, "", "just text", "<article><p>a < b <b>bold<p>next</article>tail", '<article><p title="open>lost</p><p>kept</p></article>', "<article><p>end <a href='x", "<article><!-- never closed <p>x</p>",
        "<article><p>" + "<b>" * 20_000 + "deep", "</p></div><article><p>x</p></article></nope>", "<p>" * 5_000 + "y",
    ]
    got = extracted(spark, [(None, p) for p in pages])
    assert got == ["", "", "just text", "a < b bold\nnext", "lost\nkept", "end", "", "deep", "x", "y"]


def layout(k, body):
    return f'<html><body><div class="k1"><span>Home</span> <span>Shop {k % 3}</span></div><div class="k2"><p>Sign here for weekly mail.</p>{body}<p>All rights are ours.</p></div><div class="k3"><p>Read page {k}</p></div></body></html>'


def test_template_without_names(spark):
    bodies = ["".join(f"<p>Sentence {j} of page {k}, with words of its own.</p>" for j in range(1 + k % 4)) for k in range(30)]
    got = extracted(spark, [("http://plain.example/p", layout(k, b)) for k, b in enumerate(bodies)])
    assert got == ["\n".join(re.findall(r"<p>(.*?)</p>", b)) for b in bodies]  # constant paragraphs are template, the rest in the largest container is text


def test_template_needs_most_pages_and_copies_stay(spark):
    often = [f"<article><p>own text {k}</p>{'<p>a passage that many share</p>' if k % 3 else ''}</article>" for k in range(30)]
    assert extracted(spark, [("http://b/", p) for p in often]) == [plain(p) for p in often]
    same = "<html><body><article><h1>One</h1><p>text</p><p>more</p></article></body></html>"
    assert extracted(spark, [("http://c/", same)] * 20) == ["One\ntext\nmore"] * 20


def test_order_and_gaps_are_checked():
    one, two = page_template.parse("<div>a</div><p>b</p>"), page_template.parse("<p>b</p><div>a</div>")
    members = {t: 1 for t in page_template.counted(one)}
    assert page_template.shape(one, members) != page_template.shape(two, members)
    twice = page_template.parse("<div>a</div><p>b</p><p>b</p><div>a</div>")
    assert page_template.shape(twice, members) == [(1, 0)]
    outer = page_template.parse("<i>x</i><div>a</div><i>y</i><u>z</u>")
    apart = {t: 1 for t in outer.tags[:2] + outer.tags[-1:]} | {t: 2 for t in outer.tags[2:4]}
    assert {c for c, h in page_template.shape(outer, apart) if h} <= {1, 2}


def test_vectors_don_t_depend_on_tasks(spark, monkeypatch):
    pages = spark.createDataFrame([(f"h{k % 3}", k, layout(k, "")) for k in range(60)], "host string, key long, html string")
    want = sorted(map(str, page_template.vectors(pages.coalesce(1)).collect()))
    monkeypatch.setattr(page_template, "HELD", 10)
    assert sorted(map(str, page_template.vectors(pages.repartition(7)).collect())) == want


def test_pages_without_broadcast(spark, monkeypatch):
    want = {r.page_id: r.text for r in page_template.op12_page_template(spark, TINY).collect()}
    monkeypatch.setattr(_base, "if_small", lambda df: df)
    assert {r.page_id: r.text for r in page_template.op12_page_template(spark, TINY).collect()} == want


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "t", 5, "h")], "page_id long, url string, html string, Text string, n_chars int, _host string")
    got = page_template.extract(df)
    assert got.columns == ["page_id", "url", "Text", "n_chars", "_host", "_text", "_n_chars"] and got.collect()[0][2:] == ("t", 5, "h", "x", 1)
    assert page_template.extract(df.limit(0)).count() == 0


# 13 whitening


def whitened(vectors, components=8):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[(n * r[k] - s[k]) / n for k in range(d)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x], y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def compare(got, ids, vectors, components=8):
    deviation, white, share = whitened(vectors, components)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert sorted(by) == sorted(ids)
    for c in range(1, white.shape[1] + 1):
        mine = np.array([by[i][c].whitened for i in ids])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.abs(mine - sign * white[:, c - 1]).max() < 1e-8
        assert all(by[i][c].deviation == d and by[i][c].n == len(ids) and abs(by[i][c].explained / share[c - 1] - 1) < 1e-9 for i, d in zip(ids, deviation))
    assert all(r.identity_error < 1e-9 for r in got)


def test_whitening_equals_numpy(spark):
    rows = spark.read.parquet(f"{TINY}/embeddings.parquet").collect()
    compare(whiten.op13_whiten(spark, TINY).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_range_finder_stops_early_on_a_clear_gap(spark):
    rng = np.random.default_rng(5)
    core = rng.standard_normal((400, 3)) * [900, 300, 100] @ np.linalg.qr(rng.standard_normal((40, 3)))[0].T
    vectors = np.float32(core)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows, dim = whiten.usable(df, "embedding")
    model = whiten.fit(rows, dim, "embedding", components=3)
    assert (model.basis, dim) == (11, 40) and model.passes <= whiten.PASSES
    compare(whiten.whiten(df, components=3).collect(), list(range(400)), vectors, 3)
    noise = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((60, 40)))], "vec_id long, embedding array<float>")
    model = whiten.fit(*whiten.usable(noise, "embedding"), "embedding")
    assert model.basis == 40  # residuals fail: the whole dimension


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [3.0, -1.0]), (9, [0.5, 0.25]), (9, [0.5, 0.25]), (None, [4.0, 4.0]), (10, [3e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, 8: 2, 9: 4, None: 2} and {r.n for r in got} == {5}
    assert whiten.whiten(df.limit(0)).count() == 0 == whiten.whiten(df.where("vec_id = 9")).count() == whiten.whiten(df.where("vec_id = 2")).count()
    wide = df.withColumn("N", F.lit("x"))
    assert whiten.whiten(wide).columns == ["vec_id", "N", "component", "_n", "deviation", "whitened", "explained", "identity_error"]


def test_large_deviations_stay_exact(spark):
    vectors = [[1e8, 0.0], [-1e8, 1.0], [0.5, 3.0]]
    got = whiten.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>"), components=2).where("component = 1").collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    want = [sum((3 * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    assert {r.vec_id: r.deviation for r in got} == {k: v if v < 2**63 else None for k, v in enumerate(want)}


# 10 long texts and the fit


def test_plain_sentences_never_add_up():
    rng = np.random.default_rng(2)
    plain = [" ".join(rng.choice(["sun", "house", "river", "stone", "over", "under"], 6)) + "." for _ in range(400)]
    rows = [(" ".join(plain[k : k + 5]), 0) for k in range(300)] + [(" ".join(plain[k : k + 4]) + " You vile wretch.", 1) for k in range(60)]
    model = toxicity_mil.fit_texts(rows)
    long = "The sun is over the house. " * 100_000
    assert model.score(model.sentences(long)) < 0.5 <= model.score(model.sentences(long + "You vile wretch."))
    assert [round(p, 3) >= 0.5 for *_, p in model.sentences("The river. You vile wretch.")] == [False, True]


def test_score_is_noisy_or_of_what_is_above_plain():
    model = toxicity_mil.Model({"bad": 6.0, "odd": 4.5, "good": -3.0}, -5.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    found = model.sentences("bad. odd day. good bad. nothing here")
    assert [round(x, 9) for *_, x in found] == [round(p(z), 9) for z in (1.0, -0.5, -2.0, -5.0)]
    calm = (1 - toxicity_mil.LEAK) * math.prod(min(1, (1 - p(z)) / (1 - toxicity_mil.PLAIN)) for z in (1.0, -0.5, -2.0, -5.0))
    assert abs(model.score(found) - (1 - calm)) < 1e-12


def test_the_descent_lowers_the_penalised_loss_like_a_search():
    """One word in three of four toxic documents and one of six others: the fit's loss is as low as the best of a grid over weight and bias."""
    word, sentence, doc = np.zeros(4, int), np.arange(4), np.array([0, 1, 2, 5])
    y, plain = np.array([1, 1, 1, 1, 0, 0, 0, 0, 0, 0], float), np.array([1, 2, 1, 2, 1, 1, 2, 1, 1, 1], float)
    weight = np.full(10, 0.1)

    def loss(w, b):
        a = np.bincount(doc, np.logaddexp(0, b + np.full(4, w)), 10) + plain * np.logaddexp(0, b) + toxicity_mil.FIT_LEAK
        return float((weight * np.where(y > 0, -np.log(-np.expm1(-a)), a)).sum()) + 0.01 * abs(w)

    w, b = toxicity_mil._descend(word, sentence, doc, plain, y, weight, 1, 0.01, 3000)
    best = min(loss(u, v) for u in np.linspace(-2, 16, 181) for v in np.linspace(2 * toxicity_mil.BIAS, toxicity_mil.BIAS, 71))
    assert loss(w[0], b) <= best + 0.02


# 1, 2 and 4: bounds that are gone


def test_order_minhash_of_more_words_than_positions(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "_POS", 4)
    monkeypatch.setattr(order_minhash, "_HASH", 59)
    texts = [" ".join(f"w{k % m}" for k in range(n)) for n, m in ((15, 99), (16, 99), (17, 99), (200, 99), (200, 7))]
    df = spark.createDataFrame([(t,) for t in texts + texts], "text string")
    got = [r[0] for r in df.select(order_minhash.fingerprint(F.col("text"))).collect()]
    assert got[:5] == got[5:] and len(set(got)) == 5 and all(len(x) == 64 * 8 for x in got)


def test_hot_blocks_and_hubs_are_dealt_out(spark, monkeypatch):
    text = "a frequent line "
    rows = [(k, text * 3 + (f"tail {k % 50}" if k % 3 else "")) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(df, block=8).collect()}
    first = {}
    want = {k: first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), k) for k, t in rows}
    assert got == want
    edges = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, k + 1000) for k in range(1, 300)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert set(roots.values()) == {0} and len(roots) == 599
