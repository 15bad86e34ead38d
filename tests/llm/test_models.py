"""The classifiers on held-out rows, the vector search, urls, pages and the pipeline."""

from __future__ import annotations

import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silt.llm import html, labelled, neighbours, quality, queries, simhash, toxicity, urls
from silt.llm import decontaminate as D

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@tables
@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where(f"held_out and {label} is not null").select("predicted", label, "score").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0


def small(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for n in range(300):
        good = n % 3 > 0
        words = [rng.choice(["the", "of", "lamp", "river", "stone", "walks"]) for _ in range(rng.randint(5, 60))]
        rows.append((n, " ".join(w if good else f"{w}### | $$$" for w in words) + (" gremlok" if n % 5 == 0 else ""), None))
        labels.append((n, int(good), int(n % 5 == 0)))
    odd = [(None, "text", None), (1000, None, None), (1001, "", None), (1002, " ", None), (1003, "### " * 5000, None), (7, "again", None)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, y string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_odd_rows(spark, module, label):
    docs, labels = small(spark)
    model = module.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    want = {r["doc_id"]: r[label] for r in labels.where(f"{label} is not null and doc_id < 300").collect()}
    assert np.mean([(rows[i] >= 0.3) == bool(y) for i, y in want.items() if i not in (4, 7)]) > 0.95
    assert all(0 <= s <= 1 for s in rows.values()) and module.score(docs, model).count() == docs.count()
    again = {r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, labels)).collect()}
    assert all(math.isclose(rows[i], again[i], abs_tol=1e-6) for i in rows)
    assert module.score(docs.limit(0), model).count() == 0
    none = module.train(docs, labels.limit(0))
    assert none is None and {r["score"] for r in module.score(docs, None).collect()} == {0.5}


def test_giant_text_leaves_the_rest(spark):
    """A text over the bound is passed over; the rows after it stay in the sample."""
    rows = [(n, "x" * (500 if n in (3, 8) else 10)) for n in range(20)]
    docs, chosen = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n, n % 2) for n in range(20)], "id long, y int")
    kept = {r["id"] for r in labelled.within(docs, chosen, "doc_id", "text", 200).collect()}
    assert kept == set(range(20)) - {3, 8}
    alone = chosen.where("id = 3 or id in (0, 2)")
    assert {r["id"] for r in labelled.within(docs, alone, "doc_id", "text", 200).collect()} == {0, 2, 3}


def test_labels_and_columns_are_no_inputs(spark):
    docs, labels = small(spark)
    model = quality.train(docs, labels)
    other = docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("y", F.lit("x"))
    a = sorted(r["score"] for r in quality.score(docs, model).collect())
    assert a == sorted(r["score"] for r in quality.score(other, model).collect())


def test_keep_good(spark):
    docs, labels = small(spark)
    model = quality.train(docs, labels)
    kept = quality.keep_good(docs, model)
    good = sum(r["score"] >= quality.CUT for r in quality.score(docs, model).collect())
    assert kept.columns == docs.columns and kept.count() == good


def all_pairs(x, y):
    """Mean, scale and weights over all pairs, by plain Newton steps."""
    z = quality.expand(x)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (z - mean) / scale
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
        w += step * min(1, 1 / np.abs(step).max())
    return mean, scale, w


def ranked_rows(spark, n):
    """Short texts of n rows, a third of label 0, neither told apart wholly nor all alike."""
    rng = random.Random(n)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(["the", "of", "Lamp,", "river", "stone.", "walks", "x9", "a#b"]) + "s" * rng.randrange(4) for _ in range(rng.randint(3, 30))]
        rows.append((k, " ".join(words)))
        labels.append((k, int(rng.random() < (0.35 if any("#" in w for w in words) else 0.9))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used = [zlib.crc32(str(k).encode()) % 5 != 0 for k in range(n)]
    texts = pa.array([t for (_, t), u in zip(rows, used, strict=True) if u])
    y = np.array([v for (_, v), u in zip(labels, used, strict=True) if u])
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), quality.features(texts, 0, len(texts)), y


def test_ranking_fits_all_pairs(spark):
    docs, labels, x, y = ranked_rows(spark, 400)
    model = quality.train(docs, labels)
    for got, want in zip(model[:3], all_pairs(x, y), strict=True):
        assert np.allclose(got, want, rtol=0, atol=1e-6)


def test_ranking_of_copies_fits_all_pairs():
    """Few texts, each often copied, and few rows of label 0: the steps end at the minimum all the same."""
    for seed in (4, 9, 15, 19, 39, 40):
        rng = random.Random(seed)
        texts = [" ".join(rng.choice(["the", "Lamp,", "river", "stone.", "x9", "a#b"]) + "s" * rng.randrange(4) for _ in range(rng.randint(3, 30))) for _ in range(5)]
        x = np.repeat(quality.features(pa.array(texts), 0, len(texts)), 40, axis=0)
        for few in (1, 2, 3):
            y = np.ones(len(x), int)
            y[rng.sample(range(len(x)), few)] = 0
            model = quality.fit(quality.blocks((y[:100], x[:100]), (y[100:], x[100:])))
            for got, want in zip(model[:3], all_pairs(x, y), strict=True):
                assert np.allclose(got, want, rtol=0, atol=1e-6)


def test_ranking_takes_every_labelled_row(spark):
    """Means and threshold are those of all rows, of any number."""
    docs, labels, x, y = ranked_rows(spark, 18_000)
    assert (y == 1).sum() > 6000
    model = quality.train(docs, labels)
    assert np.allclose(model.mean, quality.expand(x).mean(axis=0), rtol=0, atol=1e-9)
    s, bad = np.sort(model.strength(x)), int((y == 0).sum())
    assert math.isclose(model.threshold, (s[bad - 1] + s[bad]) / 2, abs_tol=1e-9)


# -- vectors ---------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int, list int")


def exact(rows, k=5):
    fine = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = []
    for n, (i, v) in enumerate(fine):
        if i % 50 == 0:
            others = sorted((-float(neighbours.cosine(v, x[None])[0]), j) for m, (j, x) in enumerate(fine) if m != n)
            out.append((i, [(j, -s) for s, j in others[:k]]))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    base = [np.float32(centres[k % 12] + 0.3 * rng.normal(size=8)).tolist() for k in range(1500)]
    rows = [(k, v, 0, 0) for k, v in enumerate(base)]
    rows += [(2000 + k, base[50], 0, 0) for k in range(40)]
    rows += [(3000, None, 0, 0), (3050, [0.0] * 8, 0, 0), (3100, [float("nan")] * 8, 0, 0), (3150, [float("inf"), *[1.0] * 7], 0, 0), (3200, [None, *[1.0] * 7], 0, 0), (3250, [1.0] * 3, 0, 0), (None, base[0], 0, 0), (100, base[101], 0, 0)]
    got = {}
    result = neighbours.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rid int, list int"), F.col("vec_id") % 50 == 0)
    for r in result.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows)
    # both rows of id 100 are queries of their own, and candidates for each other
    assert set(got) == {i for i, _ in want} and all(len(v) == (10 if i == 100 else 5) for i, v in got.items())
    once = [(i, v) for i, v in want if i != 100]
    assert np.mean([len({j for _, j, _ in got[i]} & {j for j, _ in v}) / 5 for i, v in once]) >= 0.9
    assert [j for _, j, _ in sorted(got[50])] == [2000, 2001, 2002, 2003, 2004]
    by_id = {i: np.array(v, float) for i, v, *_ in rows[:-1] if v is not None and i is not None}
    assert all(math.isclose(s, neighbours.cosine(by_id[i], by_id[j][None])[0], rel_tol=1e-12) for i, v in got.items() if i != 100 for _, j, s in v if j != 100)


def test_lists_and_codes_select(spark):
    """On clusters few lists are looked into, and few of their members reranked; lists are fuller than any rerank."""
    rng = np.random.default_rng(7)
    x = np.float32(rng.normal(size=(40, 32))[rng.integers(0, 40, 24_000)] + 0.8 * rng.normal(size=(24_000, 32)))
    counts = {}
    got = neighbours.search(vectors(spark, [(k, v, 0, 0) for k, v in enumerate(x.tolist())]), F.col("vec_id") % 200 == 0, counts=counts).collect()
    wide = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, len(x), 200) for j in np.argsort(-np.where(np.arange(len(x)) == i, -2, wide @ wide[i]), kind="stable")[:5]}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)
    assert counts["probes"] < 0.3 * counts["lists"] and counts["reranked"] < 0.15 * counts["scored"]


def test_few_vectors(spark):
    rows = [(0, [1.0] * 8, 0, 0), (1, [2.0] * 8, 0, 0), (50, [-1.0] * 8, 0, 0)]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert neighbours.search(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.search(vectors(spark, [(50, [1.0] * 8, 0, 0)]), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.search(vectors(spark, [(50, None, 0, 0)]), F.col("vec_id") % 50 == 0).count() == 0


def test_crowded_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 20)
    monkeypatch.setattr(neighbours, "TOGETHER", 3)
    rng = np.random.default_rng(3)
    rows = [(k, np.float32(np.ones(8) + 0.01 * rng.normal(size=8)).tolist(), 0, 0) for k in range(900)]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    pairs = {(r["query_id"], r["vec_id"]) for r in got.collect()}
    want = {(i, j) for i, v in exact(rows) for j, _ in v}
    assert len(pairs & want) >= 0.9 * len(want)


def test_near_copies_in_full_chunks(spark):
    """Thousands of near copies in one list: their codes coincide, their vectors do not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 8))
    x[:4000] = x[0] + 1e-3 * rng.normal(size=(4000, 8))
    x = np.float32(x)
    rows = [(k, v, 0, 0) for k, v in enumerate(x.tolist())]
    got = neighbours.search(vectors(spark, rows), (F.col("vec_id") % 100 == 0) & (F.col("vec_id") < 4000)).select("query_id", "vec_id").collect()
    wide = x.astype(float)
    wide /= np.sqrt((wide * wide).sum(axis=1))[:, None]
    want = {(i, int(j)) for i in range(0, 4000, 100) for j in np.argsort(-np.where(np.arange(len(x)) == i, -2, wide @ wide[i]), kind="stable")[:5]}
    recall = len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want)
    assert recall >= 0.99


# -- urls ------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "https://A.Example.COM/en/7?x#y"), (2, "http://x.net/de/1"), (3, "http://example.net/de/8"), (4, "http://a.example.net/de/81"), (5, "x://com/en/"), (6, "x://xcom/en/"), (7, "no scheme"), (8, None), (9, ""),
        (10, "http://cheap-pills.org/"), (11, "http://cheapskate.org/pillstore"), (12, "http://org?spam=1"), (13, "a://b://c/en/"), (14, "http://É.com/en/x"), (15, "http://org/es/casino"), (16, "http://net/de/porn"), (17, "http://host#frag/x"), (18, "http://free.org/free"), (19, "://"),
        (None, "http://xxx.org"), (2, "http://x.net/de/1"), (20, "http://" + "a" * 50_000 + ".com/en/"),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = urls.judge_urls(pages, queries.URL_RULES)
    by = {r["page_id"]: r for r in got.collect()}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert by[3]["rule"] == by[4]["rule"] == "example.net/de/8" and by[2]["rule"] == "net/de/"
    assert by[5]["rule"] == "com/en/" and by[6]["rule"] is None and by[14]["host"] == "É.com"
    assert [by[k]["verdict"] for k in (7, 8, 10, 11, 12, 16, 18)] == ["allow", "allow", "block", "allow", "block", "allow", "allow"]
    c = duckdb.connect()
    c.register("rows", pages.toPandas())
    c.sql("create view pages as select * from rows")
    result = c.sql(urls.oracle_sql(queries.URL_RULES))
    names = sorted(got.columns)
    at = [result.columns.index(n) for n in names]
    plain = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v)
    assert sorted([plain(r[n]) for n in names] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in result.fetchall())
    assert urls.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


# -- pages -----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><h2>Site {n}</h2></header><nav><ul><li><a href="/a">Home {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title {n}</h1></header>{body}<div class="ad">Buy {n}</div><script>var x = "<p>no</p>";</script></article>
<section id="comments"><article class="comment"><p>I disagree {n}</p></article></section><aside>Side {n}</aside><form><label>Mail</label><input></form>
<footer>&copy; {n}</footer></body></html>"""


def main(spark, rows):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    return {r["page_id"]: r for r in html.main_text(pages).collect()}


def test_html(spark):
    bodies = ["<p>One &amp; two</p><p>three<br>four\n\t five</p>", "<p><b>Unclosed<p>next <i>in</i>line&nbsp;&#x41;&#66;", "<ul><li>x<li>y</ul><p></p><table><tr><td>a</td><td>b</td></tr></table>", "<p>1 < 2 && 3 > 2</p><!-- gone <p>x</p> --><blockquote>q</blockquote>", "plain"]
    want = ["One & two\nthree four five", "Unclosed\nnext inline AB", "x\ny\na\nb", "1 < 2 && 3 > 2\nq", "plain"]
    rows = [(n, f"http://h{n % 2}.org/{n}", PAGE.format(n=n, body=b)) for n, b in enumerate(bodies)]
    rows += [(100, "http://h0.org/x", None), (101, None, ""), (102, None, "<p>free</p>"), (103, "http://h0.org/y", "<"), (104, "http://h1.org", "<article><p>" + "long text " * 30_000)]
    got = main(spark, rows)
    for n, text in enumerate(want):
        assert got[n]["text"] == f"Title {n}\n{text}" and got[n]["n_chars"] == len(got[n]["text"])
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == "free" and got[103]["n_chars"] == 0 or got[103]["text"] == "<"
    assert got[104]["text"] == ("long text " * 30_000).strip()
    assert main(spark, []) == {}


def test_host_without_article(spark):
    page = '<html><body><div class="top-menu"><a href="/">Home</a> <a href="/b">B</a></div><div id="wrap"><div class="text"><p>{t}</p></div><div class="links"><a href="/1">see also {t}</a></div></div><div class="footer">f</div></body></html>'
    got = main(spark, [(n, "http://plain.org/", page.format(t=f"words of page {n} " * (n + 3))) for n in range(6)])
    assert all(got[n]["text"] == (f"words of page {n} " * (n + 3)).strip() for n in got)


def test_mixed_host(spark):
    """Pages without an article keep their text on a host where others have one."""
    rows = [(1, "http://m.org/a", "<article><p>in article</p></article><div>tail</div>"), (2, "http://m.org/b", "<div id=x><p>no article here, but text</p><button>unclosed</div><div class=cookiebar>no</div>")]
    got = main(spark, rows)
    assert got[1]["text"] == "in article" and got[2]["text"] == "no article here, but text\nunclosed"


def test_host_of_two_templates(spark):
    """Each template keeps its own region, whatever other pages or other sites are like."""
    body = '<html><body><div class="{c}"><p>words {n}</p></div><div class="x"><a href="/">more {n}</a></div></body></html>'
    rows = [(n, f"http://two.org/{n}", body.format(c="content" if n % 5 < 3 else "post", n=n)) for n in range(20)]
    rows += [(50, "http://two.org/long", '<html><body><div class="giant"><p>' + "long " * 50_000 + "</p></div></body></html>")]
    rows += [(60 + n, None, body.format(c=f"site{'abc'[n]}", n=60 + n)) for n in range(3)]
    rows += [(70, "http://two.org/list", '<html><body><div class="list"><p><a href="/a">only</a></p><p><a href="/b">links</a></p></div></body></html>')]
    got = main(spark, rows)
    assert all(got[n]["text"] == f"words {n}" for n in (*range(20), 60, 61, 62))
    assert got[50]["n_chars"] == 5 * 50_000 - 1 and got[70]["text"] == "only\nlinks"


def one(page, *others):
    """The main text of a page on a host that has the others too."""
    w = html.Wrapper()
    for p in (page, *others):
        w.add(html.read(p)[0])
    return html.extract(*html.read(page), w)


def test_marks_are_hints():
    """Marks on what holds the main text are void; marked elements inside it go."""
    wrapped = [
        '<div class="layout has-sidebar"><article><h1>T</h1><p>words here</p></article><div class="sidebar">side</div></div>',
        '<div id="no-comments"><article><h1>T</h1><p>words here</p></article></div><footer>end</footer>',
        '<body><form id="aspnetForm"><div><nav>menu</nav><article><h1>T</h1><p>words here</p></article><label>Mail</label></div></form></body>',
        '<article><h1>T</h1><p>words here</p><p class="advert">buy <b>this</b></p><ul><li class="comment">I disagree<li class="comment">me too</ul></article>',
        '<article><h1>T</h1><p>words <span class="ad">buy</span>here</p><section class="comments"><article><p>' + "nonsense " * 90 + "</p></article></section></article>",
        '<main><h1>T</h1><div class="with-sidebar"><p>words here</p></div></main>',
    ]
    for page in wrapped:
        assert one(page) == "T\nwords here", page
    assert one("<nav><ul><li>only<li>menu</ul></nav><footer>f</footer>") == "" == one("")
    assert one("<div>" * 5000 + "deep" + "<p>x</div>" * 5000).startswith("deep")


def test_wrapper_decides():
    """No marks, no article: positions tell a long constant notice from the pages' own words."""
    page = "<body><div><p>{n} Home</p></div><div><p>" + "Terms and conditions of this long notice. " * 9 + "</p></div><div><h2>Story {n}</h2><p>own words {t}</p></div><div><a href=x>more {n}</a></div></body>"
    pages = [page.format(n=n, t="abc"[n % 3] * 80) for n in range(6)]
    lacking = [p.replace("<div><p>" + str(n) + " Home</p></div>", "") for n, p in enumerate(pages[:2])]
    for n, p in enumerate(lacking + pages[2:]):
        assert one(p, *pages) == f"Story {n}\nown words " + "abc"[n % 3] * 80
        assert html.extract(*html.read(p), html.Wrapper()).startswith("Terms")  # what the page alone would give
    copies = one(pages[0], *[pages[0]] * 5)
    assert copies and copies == html.extract(*html.read(pages[0]), html.Wrapper())


def test_long_pages_do_not_outvote():
    """A comment thread without marks that is long on one page weighs as it does on the host."""
    page = "<div><div><h1>t{n}</h1><p>story {n} " + "words " * 60 + "</p></div><ul><li>reply {r}</li></ul></div>"
    pages = [page.format(n=n, r=n) for n in range(8)]
    long = page.format(n=9, r="</li><li>".join(f"reply {k} of many readers" for k in range(200)))
    assert one(long, *pages).startswith("t9\nstory 9 words") and "many readers" not in one(long, *pages)
    assert "many readers" in html.extract(*html.read(long), html.Wrapper())


def test_wrapper_alignment():
    tree = lambda page: html.read(page)[0]
    w = html.Wrapper()
    w.add(tree("<div><h1>a</h1><p>b</p><p>c</p></div>"))
    assert w.root.expression() == "(div(h1(#) p(#)+))"
    w.add(tree("<div><h1>a</h1><img><h3>new</h3><p>b</p></div>"))
    assert w.root.expression() == "(div(h1(#) h3(#)? p(#)+))"
    w.add(tree("<div><p>b</p></div><div class='c 12'>x</div>"))
    assert w.root.expression() == "(div(h1(#)? h3(#)? p(#)+) div|class=c 0(#)?)"
    assert tree("<dl><dt>a<dd>b<dt>c<dd>d</dl>").kids[0].kids[0].key == "(dt dd)" and html.Wrapper(tree("<dl><dt>a<dd>b<dt>c<dd>d</dl>")).root.expression() == "(dl((dt(#) dd(#))+))"
    again = html.Wrapper.load(w.dump())
    assert again.dump() == w.dump() and again.root.expression() == w.root.expression()
    other = html.Wrapper()
    other.add(tree("<div><p>z</p></div>"))
    again.join(other)
    assert again.root.pages == 4 and again.root.expression() == w.root.expression()


def test_alignment_against_plain_one():
    """Both alignments hold as many pairs as a longest common subsequence, in order and of equal keys."""
    rng = random.Random(5)
    for n in range(200):
        a, b = ([rng.choice("pqr"[: 1 + n % 3] + "xyz") for _ in range(rng.randint(0, 14))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = html.align([html.Node(k) for k in a], [html.Node(k) for k in b])
        long = html._common(np.array([ord(k) for k in a]), np.array([ord(k) for k in b]))
        for found in (pairs, long):
            assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_many_siblings():
    rng = random.Random(6)
    body = lambda: "".join(f"<{t}>{t} {k}</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "pre", "blockquote"], k=3000)))
    pages = [f"<article>{body()}</article><div>tail</div>" for _ in range(3)]
    assert all(one(p, *pages).count("\n") == 2999 for p in pages)


@tables
def test_pages_keep_every_paragraph(spark):
    import html as entities
    import re

    got = {r["page_id"]: r["text"] for r in queries.op10_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


# -- pipeline --------------------------------------------------------------------------


def test_good_quality_by_every_labelled_row(spark, tmp_path):
    """What the first stage lets go of the rows learned from is as many as have label 0, of any number."""
    import corpus_pipeline as C

    docs, labels, _, y = ranked_rows(spark, 18_000)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    used = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    assert C.good_quality(spark, docs, str(tmp_path)).where(used).count() == (y == 1).sum() > 6000


@tables
def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(C.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert np.mean([(i in ids) == bool(y) for i, y in labels.items()]) > 0.98
    single = stages["near_duplicates"](spark, good, SF).cache()
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = {r["doc_id"] for r in single.collect()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(rows)
    sets = {i: shingled(t) for i, t in rows.items()}
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert kept == {i for i in order if find(i) == i}
    clean = stages["decontamination"](spark, single, SF).cache()
    items = [D.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    assert not any(x in D.normalise(rows[i]) for i in left for x in items) and all(any(D.best(x, D.normalise(rows[i]), int(len(x) * D.ERROR_RATE)) for x in items) for i in kept - left)
    redacted = stages["secrets"](spark, clean, SF).cache()
    assert redacted.columns == docs.columns and redacted.count() == clean.count()
    assert redacted.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    changed = redacted.alias("a").join(clean.alias("b"), "doc_id").where("a.text <> b.text")
    assert changed.where("not contains(a.text, '[secret]') or a.n_chars <> length(a.text)").count() == 0
    total = C.run(spark, SF).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    packed = stages["packing"](spark, redacted, SF).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tuple(total) == tuple(packed) and total[1] == redacted.count()
