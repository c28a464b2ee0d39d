import html
import re

import numpy as np
import pytest

from assayer.llm import block_labeller as B


def simple(page):
    """The article of a generated page by its markup."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))
    return " ".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@pytest.fixture(scope="module")
def model(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    return B.fit(pages[:120])


def test_blocks():
    found = B.blocks_of("<p>One <b>t</b>wo&amp;&nbsp;three<p>four<script>var a='</p>x<p>';</script> five<br>six<!-- <p>no</p> --><ul><li>a<li>b</ul>tail <x y='a>b'>end")
    assert [p.text for p in found] == ["One two& three", "four five", "six", "a", "b", "tail", "end"]
    assert [t for t, _ in found[3].path] == ["ul", "li"] and B.blocks_of("<div class='Side-bar x' id=top>t")[0].path == (("div", ("side", "bar", "x", "top")),)
    assert B.blocks_of(None) == B.blocks_of("") == B.blocks_of("<script>only") == B.blocks_of("<!-- never closed <p>x</p>") == []
    assert [p.text for p in B.blocks_of("a < b <c")] == ["a < b"]
    deep = B.blocks_of("<div>" * 20_000 + "x" + "</div>" * 20_000 + "<p " * 30_000)
    assert [p.text for p in deep] == ["x"]
    assert B.blocks_of("<a href=x>link</a> text")[0].links == 4


def test_all_text_reaches_the_labeller():
    text = lambda page: [p.text for p in B.blocks_of(page)]
    assert text("<article><p>The area is <math><mi>a</mi><mo>*</mo><mi>b</mi></math> square metres</p></article>") == ["The area is a*b square metres"]
    assert text("<p>See <object data=x>the fallback</object>, <svg><text>a label</text></svg> and <video>no video</video> end.") == ["See the fallback, a label and no video end."]
    assert text("<div>a</div><button>Share</button><div>b<noscript>c</noscript></div><select><option>1</select><textarea>t</textarea><title>x</title>") == ["a", "Share", "bc"]
    far = B.blocks_of("<article class=story>" + "<div>" * 40 + "<p>far below</p>" + "<p>and again</p>")
    assert far[1].path[0] == ("article", ("story",)) and B.marked(far) == [1, 1]
    assert (B.features(far)[1][:B.PATH_SLOTS] == B.features([B.Piece(far[1].text, 0, far[1].path)] * 2)[1][:B.PATH_SLOTS]).all()
    wide = B.blocks_of("".join(f"<div class=c{chr(97 + k % 26)}>word " for k in range(20_000)))
    assert len(wide) == 20_000  # open elements are shared, not copied


def test_gradients():
    rng = np.random.default_rng(0)
    m = B.Labeller({k: v.astype(np.float64) for k, v in B.Labeller.fresh(5, 3).w.items()})
    x, sizes, y = rng.normal(size=(4, 2, 5)), np.array([4, 2]), rng.integers(0, 2, (4, 2)).astype(float)
    x[2:, 1] = 0
    _, grads = m.gradients(x, sizes, y)
    for k, g in grads.items():
        flat = m.w[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[i]
            flat[i] = old + 1e-3
            up = m.gradients(x, sizes, y)[0]
            flat[i] = old - 1e-3
            down = m.gradients(x, sizes, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - np.asarray(g).reshape(-1)[i]) < 2e-3


def test_held_out_pages(spark, model):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()][120:]
    parsed = [B.blocks_of(p) for p in pages]
    assert [B.main_text(p, k) for p, k in zip(parsed, model.label(parsed))] == [simple(p) for p in pages]
    rng, wrong, total = np.random.default_rng(5), 0, 0
    for p in parsed:
        y = B.marked(p)
        made, labels = B.rearranged([a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b], [a.text for a in p], rng)
        wrong += int((model.label([made])[0] != np.array(labels, bool)).sum())
        total += len(labels)
    assert wrong / total < 0.02


def test_other_layouts(model):
    page = ("<html><head><title>T</title></head><body><div id='cookie-banner'><p>We use cookies to improve your experience. Accept all cookies.</p></div><header><a href=/>Site</a></header>"
            "<main><h1>Title here</h1><p>First paragraph of the story with enough words to be text.</p><aside><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside>"
            "<p>Second paragraph &amp; more of it, going on for a while.</p></main><section id='comments'><h2>Comments</h2><div class='comment'><p>Great article, I enjoyed reading it.</p></div></section>"
            "<form><label>Email</label><input></form><footer><p>Copyright 2024. All rights reserved.</p></footer></body></html>")
    blocks = B.blocks_of(page)
    assert B.main_text(blocks, model.label([blocks])[0]) == "Title here First paragraph of the story with enough words to be text. Second paragraph & more of it, going on for a while."


def test_extract(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<article><p>Only text of an article, long enough to stay.</p></article>"), (3, "v", "<article><p>Only text of an article, long enough to stay.</p></article>"),
            (None, "w", "<nav><a href=1>x</a></nav>"), (4, "z", "<article>" + "<p>Some words of text that go on and on here.</p>" * 3000 + "</article>"), (5, "q", "😀 &#xD800; <p>")]
    rows[-1] = (5, "q", "<article><p>x &#128512; y</p></article>")
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = B.extract(pages, model=model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[3].text.startswith("Only text") and by[None].n_kept == 0
    assert by[4].text.count("Some words") == 3000
    assert B.extract(pages.limit(0)).count() == 0
    assert B.extract(pages.filter("html IS NULL")).collect()[0].text == ""


def test_query_is_whole(spark):
    import __spark_entry__ as entry
    got = entry.queries()["op4_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(got) == len(pages) and sum(r.text == simple(pages[r.page_id]) for r in got) >= 0.99 * len(got)
