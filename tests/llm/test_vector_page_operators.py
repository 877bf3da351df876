import random

import numpy as np
import pytest

from curatrix.llm import embedding_dedup as D
from curatrix.llm import html_text, quality


def brute(ids, x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T) >= threshold
    np.fill_diagonal(links, False)
    label = ids.copy()
    while True:
        lower = np.minimum(label, np.where(links, label[None, :], 1 << 60).min(1))
        if (lower == label).all():
            return links.sum(1), label
        label = lower


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 2
    point = D.nearest_e8(x)
    whole, half = np.isclose(point, np.rint(point)).all(1), np.isclose(point * 2 % 2, 1).all(1)
    assert (whole | half).all() and (np.rint(point.sum(1)) % 2 == 0).all()
    own = ((x - point) ** 2).sum(1)
    others = ((x[:, None, :] - point[:, None, :] - D.ROOTS[None]) ** 2).sum(2)
    assert (own[:, None] <= others + 1e-9).all()


@pytest.mark.parametrize("shipped", [False, True])
def test_links_against_brute_force(spark, monkeypatch, shipped):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        centre = rng.normal(size=64)
        unit = centre / np.linalg.norm(centre)
        rows.append(centre)
        for cosine in rng.uniform(0.905, 0.99, 3):
            o = rng.normal(size=64)
            o -= o @ unit * unit
            rows.append(cosine * unit + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o))
    rows += [rows[0]] * 150 + [rows[1] * 3] * 4
    hub = rows[4] / np.linalg.norm(rows[4])
    rows += [hub + 0.12 * o / np.linalg.norm(o) for o in rng.normal(size=(200, 64))]
    x = np.array(rows, dtype=np.float32).astype(np.float64)
    ids = np.arange(len(x)) * 3 + 1
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64, [1.0] * 3, []]
    table = [(int(i), [float(z) for z in v], 1) for i, v in zip(ids, x)] + [(100000 + k, v, 1) for k, v in enumerate(bad)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, n_links int")
    if shipped:
        monkeypatch.setattr(D, "BROADCAST_BYTES", 1000)
    got = D.embedding_links(frame, block=64).toPandas().set_index("vec_id")
    n, label = brute(ids, x)
    own = got.loc[ids]
    assert own.n_links.sum() / n.sum() >= 0.98 and (own.n_links.values <= n).all() and (own.component_id.values == label).mean() > 0.95
    assert (own.kept.values == (own.component_id.values == ids)).all()
    alone = got.loc[[100000 + k for k in range(len(bad))]]
    assert (alone.n_links == 0).all() and alone.kept.all()
    assert D.embedding_links(frame.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies</p></div>
<nav><ul><li><a>Home</a></ul></nav><main><article class="post"><header><h1>Real &eacute; title {k}</h1><p>by Bob</p></header><p>First   para<br>line two &lt;b&gt;</p><div class="ad">Buy</div><p class="promo">pad<p>kept <span class="sponsored">sp</span> end<ul><li>one<li>two</ul>
<table><tr><td>a</td><td>b</td></tr></table><form><input><label>Mail</label></form><aside>side</aside><section class="comments"><article class="comment"><p>nice</p></article></section></article></main><footer>f</footer><script>var x="<p>no</p>";</script></body></html>"""


def test_article_is_cut_out():
    text = html_text.Page(PAGE.format(k=1)).text(None, set())
    assert text == "Real é title 1\nFirst para line two <b>\nkept end\none\ntwo\na b"
    assert html_text.Page('<div class="ad">x<article><p>Main<p>two</article>').text(None, set()) == "Main\ntwo"
    assert html_text.Page("<p>a &lt 5 < 6 <3 x").text(None, set()) == "a < 5 < 6 <3 x"
    assert html_text.Page("").text(None, set()) == "" == html_text.Page("<script>never closed <p>x").text(None, set())


def test_long_odd_pages_end():
    for source in ("<" * 50000, "<div>" * 5000 + "x", '<a b="' * 10000, "<!--" * 10000, "<article>" * 2000 + "x", '<div class="ad">' * 500 + "<article>" * 500 + "x"):
        html_text.Page(source).text(None, set())


def test_templates_find_constants_and_main(spark):
    page = '<html><body><div id="wrap"><p>Welcome to X</p><div class="txt"><p>unique text {k} alpha {q}</p><p>more {k}</p></div><p>All rights reserved</p></div></body></html>'
    rows = [(k, f"http://X.example/{k}", page.format(k=k, q=k * k), 1) for k in range(12)] + [(99, None, None, 1), (100, "odd", "", 1), (5, "http://x.example/5", page.format(k=5, q=25), 1)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["page_id"]
        assert r["text"] == (f"unique text {k} alpha {k * k}\nmore {k}" if k < 50 else "") and r["n_chars"] == len(r["text"])
    single = html_text.extract_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string, n_chars int")).first()
    assert single["text"] == "Welcome to X\nunique text 0 alpha 0\nmore 0\nAll rights reserved"  # one page is no template
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_tells_junk(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))

    def text(good):
        return ". ".join(" ".join(word() for _ in range(9)) for _ in range(6)) if good else " ".join([word() + "###"] * 50)

    rows = [(i, text(i % 5 > 0), "en", f"s{i % 3}", i % 5 > 0) for i in range(500)]
    docs = spark.createDataFrame([r[:4] for r in rows] + [(900, None, None, None), (901, "", "en", None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[4])) for r in rows if r[0] < 300], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    unseen = [r for r in rows if r[0] >= 300]
    assert sum(got[r[0]]["keep"] == r[4] for r in unseen) / len(unseen) > 0.97 and len(got) == 502
    assert {r["score"] for r in quality.score_quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_template_rules_inside_articles_too(spark):
    page = '<html><body><nav>n</nav><article class="teaser"><p>Read {k}</p></article><article id="post-{k}"><p>Follow us for more</p><p>story {k} {q} is told at some length here</p><p>Sign the list</p></article></body></html>'
    moved = '<html><body><article id="post-77"><p>Sign the list</p><p>a story that has its own order of words, at length</p><p>Follow us for more</p></article></body></html>'
    rows = [(k, f"http://y.example/{k}", page.format(k=k, q=k * k)) for k in range(12)] + [(77, "http://y.example/77", moved)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k} {k * k} is told at some length here" for k in range(12))
    assert len(got[77].split("\n")) == 2  # one of the two stands out of the template's order
    copies = [(k, f"http://z.example/{k}", page.format(k=1, q=1)) for k in range(8)]
    got = html_text.extract_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert all("story 1 1 is told" in r["text"] for r in got)  # copies of a page are no template


def test_names_are_votes(spark):
    read = lambda source: html_text.read_page(source).text(None, ())
    assert read('<body><article class="post has-sidebar"><p>text</p><div class="ad">Buy</div></article></body>') == "text"
    assert read('<article class="comments-open"><p>text</p></article>') == "text"
    assert read('<div class="layout with-sidebar"><div class="sidebar">x</div><article><p>text</p></article></div>') == "text"
    assert read('<article><h2 id="legal-basis">Basis</h2><section id="discussion"><p>text</p></section></article>') == "Basis\ntext"
    assert read('<div><p>A post that is long enough</p></div><section class="comments"><article class="comment">nice</article></section>') == "A post that is long enough"
    page = '<body><article><h2 id="how-to-register">Way {k}</h2><p>words of story {k}</p><div id="comments"><p>nice {k}</p></div>{own}</article></body>'
    rows = [(k, f"http://v.example/{k}", page.format(k=k, own='<section id="discussion"><p>own part</p></section>' if k == 3 else "")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Way {k}\nwords of story {k}" + ("\nown part" if k == 3 else "") for k in range(12))


def linked_pairs(dim, pairs, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for cosine in rng.uniform(0.905, 0.99, pairs):
        unit, o = (v / np.linalg.norm(v) for v in rng.normal(size=(2, dim)))
        o -= o @ unit * unit
        rows += [unit, cosine * unit + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o)]
    return np.array(rows)


def test_every_dimension_links(spark):
    parts = [linked_pairs(dim, 40, dim) for dim in (64, 24)] + [np.ones((2, 3)), np.array([[2.0]])]
    vectors = [v for p in parts for v in p]
    got = D.embedding_links(spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    at = 0
    for p in parts:
        ids = np.arange(at, at + len(p))
        n, label = brute(ids, p)
        own = got.loc[ids]
        assert own.n_links.sum() >= 0.97 * n.sum() and (own.n_links.values <= n).all() and (own.component_id.values == label).mean() > 0.95
        at += len(p)
    assert got.loc[160].n_links == got.loc[161].n_links == 1 and got.loc[161].component_id == 160


@pytest.mark.parametrize("n", [1000, 1 << 21, 1 << 23])
def test_recall_of_every_setting(spark, monkeypatch, n):
    chosen = D.settings(n, 64)
    monkeypatch.setattr(D, "settings", lambda *_: chosen)
    x = linked_pairs(64, 300, 8)
    got = D.embedding_links(spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    share = got.where("n_links > 0").count() / len(x)
    print(chosen, share)
    assert share >= 0.96


def test_links_do_not_depend_on_the_number_of_vectors():
    """One setting for every size, and nearly all pairs at the threshold meet under it."""
    chosen = [D.settings(n, 64) for n in (1, 1 << 18, 1 << 19, 1 << 22, 1 << 23, 1 << 30)]
    assert all(x == chosen[0] for x in chosen)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 2000, 64))
    one = x[0] / np.linalg.norm(x[0], axis=1, keepdims=True)
    other = x[1] - (x[1] * one).sum(axis=1, keepdims=True) * one
    two = 0.9 * one + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    lattice = D.Lattice(64, **chosen[0])
    a, b = lattice.cells(one), lattice.cells(two)
    assert ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1).mean() >= 0.98
