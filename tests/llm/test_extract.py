"""HTML extraction: the article of the given pages, other layouts, broken markup, hard rows."""

import os

import duckdb
import numpy as np
import pytest

from aeropanel.llm import extract

SF = "/root/testdata/sf0.001"
PROSE = ["The council met on Monday, and after two hours it agreed to repair the old bridge; work starts in May.", "Traders near the river fear losses, but most of them welcome the plan: the bridge has been shut since 2019.", "A first estimate, made public last week, names a cost of two million. Nobody knows who pays."]


def page(body, head="<title>Bridge - The Daily</title><style>p{color:red}</style><script>if (1<2) document.write('<p>no</p>')</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def paragraphs():
    return "".join(f"<p>{t}</p>" for t in PROSE)


MENU = "<div class='main-menu'><ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(9)) + "</ul></div>"
LAYOUTS = [
    f"{MENU}<div id='content'><h1>Bridge</h1>{paragraphs()}</div><div class='comments'><p>What a waste, really. They should ask us first, as always.</p></div><div id=footer>Imprint. Terms, and conditions.</div>",
    f"<header><h1>The Daily</h1></header><main><h1>Bridge</h1>{paragraphs()}</main><aside><p>Also read: ten tips, all good.</p></aside><form><p>Subscribe, now, to our letter.</p></form>",
    f"<div class='cookie-notice'>We use cookies, and so do our partners. Agree?</div><table><tr><td>{MENU}<td><div class=story><h1>Bridge</h1>{paragraphs()}</div></table>",
    f"<article><header><h1>Bridge</h1></header>{paragraphs()}<footer>Share this. Now!</footer></article><article class=comment><p>I disagree, strongly, with all of it; it is a shame.</p></article>",
]


@pytest.mark.parametrize("body", LAYOUTS)
def test_layouts(body):
    assert extract.main_text(page(body)) == "\n".join(["Bridge", *PROSE])


def test_blocks_of_an_article():
    body = f"<article><h2>A &amp; B&nbsp;&#67;</h2>{paragraphs()}<ul><li>one <b>two</b><li>three<br>four</ul><p>x \n\t y</p><blockquote>Quoted.</blockquote><p hidden>no</p><p>Sh<i>or</i>t</p></article>"
    assert extract.main_text(page(body)) == "\n".join(["A & B C", *PROSE, "one two", "three four", "x y", "Quoted.", "Short"])


def test_broken_markup():
    assert extract.main_text("") == extract.main_text("<p") == extract.main_text("<script>never closed <p>x") == extract.main_text("<!-- <p>x</p>") == ""
    assert extract.main_text("<") == "<"
    assert extract.main_text("only text, no markup.") == "only text, no markup."
    assert extract.main_text("<article><p title='a>b' class=x>1 < 2</p></div></article") == "1 < 2"
    assert extract.main_text("<head><title>t</title><body><p>Head without an end.") == "Head without an end."
    assert extract.main_text("<SCRIPT>x</SCRIPT ><P>Upper case.</P>") == "Upper case."
    deep = "<div>" * 5000 + "<p>Deep down, here.</p>" + "</div>" * 5000
    assert extract.main_text(deep) == "Deep down, here."


def test_ratios_against_brute_force():
    found = extract.leaves(page(LAYOUTS[0]))
    of, fused = extract.path_scores(found, 1.0)
    n = len(found.texts)
    mean = lambda x, p: sum(v for v, q in zip(x, found.path) if q == p) / found.path.count(p)
    chars = [mean([len(t) - l for t, l in zip(found.texts, found.links)], p) for p in found.path]
    marks = [mean([sum(c in ".,;:!?" for c in t) for t in found.texts], p) for p in found.path]
    k = lambda d: np.exp(-d * d / 2) if abs(d) <= 3 else 0.0
    smooth = lambda x: [sum(k(i - j) * x[j] for j in range(n)) / sum(k(i - j) for j in range(n)) for i in range(n)]
    want = [mean(smooth(chars), p) * (1 + mean(smooth(marks), p)) for p in found.path]
    assert np.allclose(fused[of], want)


def test_long_page_is_read_whole():
    many = [f"Paragraph {i}, which is one of many; it stays." for i in range(40_000)]
    assert extract.main_text(page("<nav>menu</nav><article>" + "".join(f"<p>{t}" for t in many) + "</article>")) == "\n".join(many)


def test_hard_rows(spark):
    html = page(LAYOUTS[1])
    rows = [(1, "u", html, "a", 5, 1.0), (1, "u", html, "a", 5, 1.0), (None, None, html, None, None, None), (2, "u", None, "b", 1, 2.0), (3, None, "", "c", 1, 2.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, `meta.len` double")
    out = extract.op11(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    text = "\n".join(["Bridge", *PROSE])
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "u", "", 0), (3, None, "", 0)], key=str)
    kept = extract.extract(pages)
    assert kept.columns == [*pages.columns, "_text", "_n_chars"] and kept.where("`meta.len` = 1.0").count() == 2
    assert extract.op11(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_given_pages_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.sql(extract.ORACLE).fetchall())
    assert sorted(map(tuple, extract.op11(spark.read.parquet(f"{SF}/pages.parquet")).collect())) == want
