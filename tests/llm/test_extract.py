"""Main text of pages against a plain cut of the marked article, on pages the network has not learnt from."""

import html
import os
import re

import numpy as np
import pytest
from cases import clashing
from wireloom.llm import extract as X
from wireloom.llm import queries as Q


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def weights(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 0")
    return X.train(pages)


def texts(spark, weights, pages):
    df = clashing(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "cast(null as string) as url", "html"))
    return [r["text"] for r in X.extracted(df, weights).orderBy("page_id").collect()]


def test_held_out_pages(spark, weights):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 2 = 1").collect()
    got = texts(spark, weights, [r["html"] for r in rows])
    assert got == [plain(r["html"]) for r in rows]


A = "The committee met on Tuesday, and after a long debate it agreed to publish the findings of its inquiry."
B = "Several members said that they would have preferred more time; others, including the chair, disagreed."
C = "I really liked this one, thank you for writing it, and please do go on with the series."


@pytest.mark.parametrize("page", [
    f"<html><body><header><h2>Daily Site</h2></header><main><h1>Findings</h1><p>{A}</p><p>{B}</p></main><aside><p>{C}</p></aside></body></html>",
    f"<html><body><nav><a href=/>Home</a></nav><article><h1>Findings</h1><p>{A}<aside><p>{C}</p></aside><p>{B}</p></article><div class='comments'><p>{C}</p></div></body></html>",
    f"<html><body><div class='cookie-notice'>We use cookies to improve this site. <button>Accept</button></div><article><h1>Findings</h1><p>{A}<p>{B}<div class='ad'>{C}</div></article></body></html>",
    f"<html><body><article><h1>Findings</h1><p>{A}</p><form action=x><label>Your mail</label><select><option>One<option>Two</select></form><p>{B}</p><section id=comments><p>{C}</p></section></article><footer>{C}</footer>",
])
def test_furniture(spark, weights, page):
    assert texts(spark, weights, [page]) == [f"Findings\n{A}\n{B}"]


def test_blocks_of_markup():
    page = """<!DOCTYPE html><title>T</title><script>var a = "<p>x</p>";</script><style>p{}</style><!-- <p>no</p> --><body class="Home page"><p>one <b>two</b>\n three<p>fo<i>ur</i> &amp;&lt;p&gt; &nbsp;five
    <ul><li><a href="?a>b">l1</a><li>l2 <a>x</ul>tail<table><tr><td>c1<td>c2</table><img alt="<p>"> a < b <unclosed"""
    got = [(t, p.steps()[-1][0], round(s, 2)) for p, t, s in X.blocks(page)]
    assert got == [("T", "title", 0), ("one two three", "p", 0), ("four &<p> five", "p", 0), ("l1", "li", 1), ("l2 x", "li", 0.25), ("tail", "body", 0), ("c1", "td", 0), ("c2", "td", 0), ("a < b <unclosed", "body", 0)]
    assert X.blocks(page)[1][0].steps()[0] == ("body", ".home", ".page")


def test_awkward(spark, weights):
    deep = "<div>" * 20_000 + A + "</div>" * 20_000
    got = texts(spark, weights, [None, "", "   ", "<p>", "<", "</p></div>", "<article><p>" + "word " * 20_000 + "</p></article>", "<article>" + f"<p>{A}</p>" * 5_000 + "</article>", deep, "<a <a <a \"" * 2000])
    assert got[:6] == ["", "", "", "", "<" if got[4] else "", ""]
    assert got[6] == ("word " * 20_000).strip() and got[7] == "\n".join([A] * 5_000)
    assert X.extracted(spark.createDataFrame([], "page_id long, url string, html string"), weights).count() == 0


def test_no_page_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert all(not w.any() for w in X.train(none))
    assert texts(spark, X.train(none), [f"<p>{A}</p>"]) == [A]


def test_pieces_of_a_long_page(weights, monkeypatch):
    page = X.blocks("<article>" + "".join(f"<p>{A[k % 60 :]}</p>" for k in range(50)) + "</article><footer>x</footer>")
    whole = X.margins(weights, [page, page[:7]])
    monkeypatch.setattr(X, "STEPS", 8)
    for a, b in zip(whole, X.margins(weights, [page, page[:7]]), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    weights = [w.astype(np.float64) for w in X._start()]
    x, y = rng.normal(size=(5, 3, X.INPUT)), (rng.random((5, 3)) < 0.5).astype(float)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)

    def loss():
        out = []
        for way in range(2):
            w, u, b = weights[3 * way : 3 * way + 3]
            h = c = np.zeros((3, X.HIDDEN))
            hs = np.zeros((5, 3, X.HIDDEN))
            for t in range(5) if way == 0 else range(4, -1, -1):
                *_, nc, nh = X._step(x[t] @ w + b + h @ u, c)
                c, h = np.where(mask[t][:, None] > 0, nc, c), np.where(mask[t][:, None] > 0, nh, h)
                hs[t] = h
            out.append(hs)
        z = out[0] @ weights[6][: X.HIDDEN] + out[1] @ weights[6][X.HIDDEN :] + weights[7]
        return (mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum()

    grads = X._learn(weights, x, y, mask)
    for w, g in zip(weights, grads, strict=True):
        for at in [tuple(rng.integers(n) for n in w.shape) for _ in range(4)]:
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4
            w[at] = keep


def test_labelled_blocks(spark, weights, sf):
    rows = X.labelled(clashing(spark.read.parquet(os.path.join(sf, "pages.parquet"))), weights)
    row = rows.first()
    assert "blocks" in rows.columns and row["blocks"][0]["path"] == "html/head/title" and row["blocks"][0]["margin"] < 0


def test_query(spark, sf):
    rows = Q.QUERIES["op12_extraction"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(os.path.join(sf, "pages.parquet")).collect()}
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in rows} == {k: (plain(v), len(plain(v))) for k, v in pages.items()}
