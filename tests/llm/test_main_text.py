import html
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import catalog, main_text

SF = "/root/testdata/sf0.01"


def plain(page):
    """The article of these pages by their fixed template."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))).split())


def test_query_on_all_pages(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = catalog.QUERIES["op2_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id][0], plain(pages[r.page_id][1]), len(r.text))


@pytest.fixture(scope="module")
def labeller(spark):
    return main_text.train(main_text.sample_of(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")))


def test_other_templates(labeller):
    pages = [
        "<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><h1>Title here</h1><p>One two <b>th</b>ree &amp; four five six, seven.</p><p>More\n text is here for you.</main>"
        "<aside><p>Side stuff</p></aside><section class='comments'><p>I liked it a lot, thanks.</p></section><form><label>Name</label></form><footer>c 2020</footer></body></html>",
        "<body><div id=header>Logo</div><div class='cookie-notice'>We use cookies</div><article class='post-content'><h1>T</h1><p>One two three four five six, seven.<p>More text is here for you.</article>"
        "<div class=sidebar><p>Side stuff</p></div><div id=comments><p>I liked it a lot, thanks.</p></div><div id=footer>c 2020</div>",
    ]
    assert main_text.texts(labeller, pages) == ["Title here One two three & four five six, seven. More text is here for you.", "T One two three four five six, seven. More text is here for you."]


def test_hard_pages(spark, labeller):
    long_page = "<article>" + "<p>Some words of a long page.</p>" * 5000 + "</article><footer>end</footer>"
    odd = ["<", "<p", "a < b > c", "<!-- open", "<script>var a='</p>'", "</p></article>", "<article><p title='>'>x", "&#x41;&bogus;&#0;", "<a\x00b>"]
    pages = [None, "", "   ", long_page, *odd, '<p a="' + '"\'' * 2000]
    got = main_text.texts(labeller, pages)
    assert got[:3] == ["", "", ""] and got[3].startswith("Some words") and len(got) == len(pages)
    df = spark.createDataFrame([(i, p, "mine") for i, p in enumerate(pages)] + [(None, None, None)] * 2, "page_id long, html string, text string")
    assert main_text.extract(df).count() == len(pages) + 2
    assert main_text.extract(df.limit(0)).count() == 0
    assert main_text.extract(df.where(F.col("html").isNull())).select("text").distinct().collect()[0].text == ""


@pytest.mark.parametrize(
    "tag",
    ['<svg-icon name="x"></svg-icon>', '<svg class="i"/>', "<svg class='a > b' />", "<svg/>", "<template-x>", "<template-x/>", "<script-loader src=x></script-loader>"]
    + ["<svg><path d='M0 0'/><text>no</text></svg >", "<svg><foreignObject><p>no</p></foreignObject></svg>", "<svg><title>no<title/></svg>", "<iframe src=x>no</iframe\n>"],
)
def test_raw_tags_end_where_they_end(tag):
    page = f"<article><p>One {tag} two.</p><p>Three.</p></article>"
    assert [b.text for b in main_text.blocks_of(page)] == ["One two.", "Three."]
    page += "<p>Four <svg><text>no</text></svg> five.</p>"
    assert [b.text for b in main_text.blocks_of(page)] == ["One two.", "Three.", "Four five."]


def test_unclosed_svg_loses_no_page():
    blocks = lambda page: [b.text for b in main_text.blocks_of(page)]
    assert blocks("<p>One <svg class=i></p><p>Two <svg><text>no</text></svg> three.</p>") == ["One", "Two three."]
    assert blocks("<p>One <svg> two.") == ["One two."]
    assert len(blocks("<p>a <svg><title>" * 50_000)) > 0  # in linear time


def test_gradients():
    """Back-propagation against differences."""
    import numpy as np

    rng = np.random.default_rng(0)
    lab = main_text.Labeller()
    x, mask, y = rng.normal(size=(2, 4, main_text.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float), rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = lab.scores(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = lab.gradients(x, mask, y)
    for key, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)]:
            old = lab.p[key][at]
            lab.p[key][at] = old + 1e-5
            up = loss()
            lab.p[key][at] = old - 1e-5
            down = loss()
            lab.p[key][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, key
