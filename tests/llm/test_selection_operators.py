"""op11 to op13: whitening, importance resampling and site templates."""

import html as markup
import math
import re

import numpy as np
import pandas as pd
import pytest

import plain
from rows import SF, none, odd  # noqa: F401
from tidewatch.llm import importance, queries, site_templates, whitening

VECTORS = "vec_id long, embedding array<float>"


# --- whitening

def test_inertia_and_leading_pairs():
    r = np.random.default_rng(5)
    for d in (1, 2, 7, 33):
        for turn in range(12):
            a = r.standard_normal((d, d))
            a = a + a.T
            if turn % 3 == 0:
                np.fill_diagonal(a, 0)  # pivots of two rows
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-9:
                assert whitening.negative_pivots(a) == (e < 0).sum()
            x = r.standard_normal((d * 3, d)) * 500
            v = x.T @ x / len(x)
            values, vectors, counts = whitening.leading(v, 8)
            assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-12)
            assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
            assert list(counts) == [(d - 1 - j, d - j) for j in range(len(values))]


def test_equal_eigenvalues():
    values, vectors, _ = whitening.leading(np.diag([4.0, 4.0, 4.0, 1.0, 0.0, 0.0]), 6)
    assert np.allclose(values, [4, 4, 4, 1, 0, 0], atol=1e-12) and np.abs(vectors @ vectors.T - np.eye(6)).max() < 1e-12
    values, vectors, _ = whitening.leading(np.zeros((3, 3)), 8)
    assert not values.any() and len(vectors) == 3


def test_whitening_equals_eigh(spark):
    data = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows, share = plain.whitened([(i, [None if c is None else float(c) for c in v] if v is not None else None) for i, v in zip(data.vec_id, data.embedding)])
    got = queries.op11_spectrum_whitening(spark, SF).toPandas()
    assert len(got) == 8 * len(rows) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    got = got.set_index(["vec_id", "component"]).sort_index()
    for i, off, w in rows:
        mine = got.loc[i]
        assert list(mine.index) == list(range(1, 9)) and set(mine.deviation) == {off} and set(mine.n) == {len(rows)}
        assert np.abs(np.abs(mine.whitened.to_numpy()) - w).max() < 1e-8 and np.allclose(mine.explained, share, rtol=1e-10)


def test_whitening_of_odd_vectors(spark):
    r = np.random.default_rng(2)
    data = [(i, [float(c) for c in r.standard_normal(5)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, math.nan, 1.0, 1.0, 1.0]), (103, [1.0, math.inf, 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0])]
    rows = [*data, data[3], (None, data[4][1]), *bad]  # a repeated row and a null id
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"{VECTORS}, n long, whitened double")
    got = whitening.whiten(frame, whitening.fit(frame)).toPandas()
    assert len(got) == 42 * 5 and set(got.n) == {42} and got.vec_id.isna().sum() == 5 and (got.vec_id == 3).sum() == 10
    want, _ = plain.whitened([x for x in rows if x not in bad])
    assert sorted(map(int, got[got.component == 1].deviation)) == sorted(o for _, o, _ in want)
    # the fit does not depend on how rows are dealt
    again = whitening.fit(frame.repartition(7))
    assert np.array_equal(again.vectors, whitening.fit(frame).vectors)


def test_whitening_without_variance(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], VECTORS)
    got = whitening.whiten(frame, whitening.fit(frame)).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(4)], VECTORS)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    wide = spark.createDataFrame([(1, [1e9, 5.0]), (2, [-2e9, 6.0]), (3, [3e12, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(wide, whitening.fit(wide)).collect()  # the enormous entry does not take part
    assert {r["vec_id"] for r in got} == {1, 2} and int(got[0]["deviation"]) == (3 * 10 ** 9 * 1024) ** 2 + 1024 ** 2
    for empty in (frame.limit(0), spark.createDataFrame([(1, []), (2, None)], VECTORS)):
        assert whitening.whiten(empty, whitening.fit(empty)).collect() == []


# --- importance resampling

def test_resampling_equals_plain(spark):
    docs, items = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    want = plain.importance(list(zip(docs.doc_id.tolist(), docs.text)), list(items.text))
    got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in queries.op12_importance_resampling(spark, SF).collect()]
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[4] for r in got)


LINES = ["", "  ", "one", "A-b c", "the same line of words that many texts share", "x y z w v u t s r q", "ß 😀 Ünï x", "a\tb\r", "one", "9 10\x0b11\x1c12"]


def test_resampling_of_lines(spark):
    r = np.random.default_rng(3)
    docs = [(i, "\n".join(LINES[j] for j in r.integers(0, len(LINES), r.integers(0, 9)))) for i in range(300)]
    docs += [docs[5], docs[5], (7, "another text of a repeated id " * 9), (None, "words without an id " * 20), (None, "words without an id " * 20), (1000, None), (1001, "")]
    docs.append((1002, "\n".join(f"long {i} text\n\nof many lines" for i in range(20_000))))
    goal = ["x y z\nw", None, "", "the same line"]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, names int, uid long").repartition(5)
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], r[4] or 0)
    for percent in (0, 30, 100):
        got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resample(frame, target, percent, 3).collect()]
        want = plain.importance(docs, goal, percent, 3)
        assert sorted(got, key=key) == sorted(want, key=key)
    assert importance.resample(frame.limit(0), target).collect() == []
    assert importance.resample(frame, target.limit(0)).count() == len(docs)


def test_resampling_of_odd_rows(spark, odd, none):  # noqa: F811
    goal = spark.createDataFrame([("mail and words",)], "text string")
    assert importance.resample(odd, goal).count() == odd.count() and importance.resample(none, goal).count() == 0


def test_features_cross_lines():
    one_line = importance.features(importance.words("a b c d"), 10_000)
    apart, found = importance.crossing("a\nb\n\nc d", 10_000)
    assert apart == 4 and sorted(found) == sorted([one_line[1][0], one_line[1][1], *one_line[2]])
    assert sorted(importance.unpacked(importance.packed([7, 3, 7])).tolist()) == [3, 7, 7]


# --- site templates

def test_main_text_of_given_pages(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op13_site_templates(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, h in zip(pages.page_id, pages.html):
        body = re.search("<article>(.*?)</article>", h or "", re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>", "", body).replace("<br>", " "))
        assert got[i]["text"] == "\n".join(x for x in (" ".join(markup.unescape(b).split()) for b in blocks) if x)
        assert got[i]["n_chars"] == len(got[i]["text"])


SITE = """<html><head><title>T</title></head><body><div><a href=/>Home of the daily tide</a></div>
<div id=page><p>Story %d begins here.<p>It goes&nbsp;on &lt;%d&gt; and on, and on, and on.</div>
<div><div>Follow us everywhere</div><span>Printed on paper</span></div><div>Only %d</div></body></html>"""


def test_recurring_subtrees_go(spark):
    pages = spark.createDataFrame([(i, f"http://News.example.org/{i}", SITE % (i, i, i)) for i in range(9)] + [(50, "http://other.example.org/", SITE % (50, 50, 50)), (51, None, SITE % (51, 51, 51))],
                                  "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_templates.extract(pages).collect()}
    assert got[3] == "Story 3 begins here.\nIt goes on <3> and on, and on, and on.\nOnly 3"
    # one page of a host, or no host: nothing recurs
    assert got[50].startswith("Home of the daily tide\nStory 50") and got[51].endswith("Printed on paper\nOnly 51")
    counted = {}
    for i in range(9):
        for x in site_templates.candidates(site_templates.parse(SITE % (i, i, i))):
            counted[x] = counted.get(x, 0) + 1
    found = site_templates.templates(pages).collect()
    assert [(r["host"], r["pages"]) for r in found] == [("news.example.org", 9)] and set(found[0]["hashes"]) == {x for x, n in counted.items() if n >= 5}


def test_large_and_small_hosts_agree(spark, monkeypatch):
    rows = [(100 * h + i, f"http://host{h}.example.org/{i}", SITE % (i, i, i)) for h in range(4) for i in range(3 + 3 * h)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, site_templates.extract(pages).collect()))
    for parts in (1, 3):  # no host, then some hosts, are large
        monkeypatch.setattr(site_templates, "LARGE_HOSTS", parts)
        assert sorted(map(tuple, site_templates.extract(pages).collect())) == want
    assert sum("Printed" in r[2] for r in want) == 3


def test_copied_articles_stay(spark):
    page = "<body><nav>a <b>b</b></nav><article><div><h2>Head</h2><p>One passage.</p></div><div class=share>Share it</div><div>Read more</div></article></body>"
    pages = spark.createDataFrame([(i, "https://h.example.com/x", page) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in site_templates.extract(pages).collect()} == {"Head\nOne passage."}


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain & text", "plain & text"), ("<p>a<p>b<br>c</p>d", "a\nb c\nd"), ("<p>x < y and 3 <4", "x < y and 3 <4"),
    ("<article>ü&#x1F600;&amp;amp;&nbsp; z</article>", "ü😀&amp; z"), ("<script>var a='</p>';</script><p>t", "t"), ("<style>p{}</style>a<!-- b --><![CDATA[c]]>d", "ad"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<div>a</p>b</div>", "a\nb"), ("<p><b>a<p>c</b>d", "a\ncd"),
    ("<div class='siteHeader'>x</div><main><header><h1>T</h1></header><p>t</p><section id=comments><p>hm</p></section><aside>s</aside></main>", "T\nt"),
    ("<div role=navigation>m</div><div class='cookie-notice'>c</div><form>f<input></form><div hidden>h</div><div>kept</div><footer>f</footer>", "kept"),
    ("<textarea><p>x</textarea><select><option>1<option>2</select>y", "y"), ("<article>short</article><article>the longer one</article>", "the longer one"),
    ("<article>one</article><article>two</article>", "one"), ("<a href='x>y'>q</a> <i title=\"a>b\">r</i>", "q r"), ("<p title=\"open>z</p>", "z"), ("<article></article>after", "after"), ("x<", "x<"), ("<b", "<b"),
])
def test_broken_pages(page, text):
    assert site_templates.main_text(site_templates.parse(page), set()) == text


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "x" + "<p>" * 3000
    wide = "<p>w</p>" * 50_000
    rows = [(1, "http://a.org/", None, 1), (1, "http://a.org/", None, 1), (2, None, "", 2), (None, "not a url", "<p>a", 3), (3, "http://a.org/", deep, 4), (4, "http://a.org/", wide, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in site_templates.extract(pages).collect()), key=str)
    assert got == sorted([(1, "http://a.org/", 0), (1, "http://a.org/", 0), (2, None, 0), (None, "not a url", 1), (3, "http://a.org/", 1), (4, "http://a.org/", 99_999)], key=str)
    assert site_templates.extract(pages.limit(0)).collect() == []
