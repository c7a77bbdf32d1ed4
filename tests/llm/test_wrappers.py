import html
import re

import pytest

from pageloom.llm import queries, wrappers


def expected(page):
    """For the given pages: the blocks of the only article."""
    parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", part))).strip() for part in parts)
    return "\n".join(text for text in texts if text)


def test_given_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.QUERIES["op7_wrappers"](spark, sf).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: expected(page) for i, page in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


CASES = [
    ("<body><nav><a>x</a></nav><article><h1>A &amp; B</h1><p>one<p>two <b>bold</b>ly</article><footer>f</footer>", "A & B\none\ntwo boldly"),
    ("<main><div class='sidebar'>s</div><ul><li>a<li>b</ul><form>f<input></form></main>", "a\nb"),
    ("<article><p>a<br>b</p><aside>no</aside><script>if (a<b) '</p>'</script><!-- <p>c --><p>&#233;&hellip;&nbsp;x</p></article>", "a b\né… x"),
    ("<article>outer<article>inner</article>tail</article><div id=comments><article>me too</article></div>", "outer\ninner\ntail"),
    ("<div class='cookie-notice'>n</div><p>only text</p><p><a href=x>link</a></p>", "only text"),
    ("<article><table><tr><td>1<td>2</table></article>", "1\n2"),
    ("plain", "plain"), ("", ""), ("<", "<"), ("<p", "<p"), ("<article><p>a > b < c</article>", "a > b < c"),
    ("<article><p>unclosed <b>x", "unclosed x"), ("<script>no end", ""), ("<article><textarea>t</textarea><pre>a\n b</pre></article>", "a b"),
]


NAMES = [
    ("<article><h2 id='social-history'>h</h2><section id='related-work'>r</section><div class='share-price'>s</div><p class='ad-hoc'>p</p></article>", "h\nr\ns\np"),
    ("<main><h3 id=comments>c</h3><p id=notice>n</p><div id=comments>x</div><div class='ad-banner'>x</div><div role=navigation>x</div></main>", "c\nn"),
    ("<h2 id='social-history'>h</h2><p id=related>r</p><div class='share-buttons'>s</div>", "h\nr"),
    ("<div class='menu-bar'>m</div><div itemprop=articleBody><div class='social-contract'>a</div></div>", "a"),
    ("<article><div class='social'>x</div><div class='old relatedWork'>w</div></article>", "w"),
    ("<section class='related-posts' itemprop=articleBody>s</section>", "s"),
]


@pytest.mark.parametrize(("page", "text"), NAMES)
def test_parts_of_names_inside_articles(page, text):
    whole = wrappers._dump(wrappers.as_wrapper(wrappers.read_page(page)[0]))
    assert wrappers.main_text(page, whole) == text


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    whole = wrappers._dump(wrappers.as_wrapper(wrappers.read_page(page)[0]))
    assert wrappers.main_text(page, whole) == text


def test_alignment():
    one = wrappers.as_wrapper(wrappers.read_page("<article><h1>t</h1><p>a</p><p>b</p></article>")[0])
    two = wrappers.as_wrapper(wrappers.read_page("<article><h1>t</h1><blockquote>q</blockquote><p>a</p></article><footer>f</footer>")[0])
    assert wrappers.expression(wrappers._merged(one, two)) == "<article><h1>#</>(<blockquote>#</>)?(<p>#</>)+</>(<footer>#</>)?"
    pairs = wrappers.as_wrapper(wrappers.read_page("<dl><dt>a<dd>b<dt>c<dd>d</dl>")[0])
    assert wrappers.expression(pairs) == "<dl>(<dt>#</><dd>#</>)+</>"


def test_hosts_parts_and_hard_pages(spark, monkeypatch):
    shapes = ["<article><p>x</p>{}</article>".format("".join(f"<{t}>y</{t}>" for t in c)) for c in ("", "h2", "ul", "ol", "pre", "dl")]
    shapes = [s.replace("<h>", "<h2>").replace("</h>", "</h2>") for s in shapes]
    rows = [(i, f"http://H.example/{i}", shapes[i % 6]) for i in range(30)] + [(30, None, None), (31, "http://[", "<p>z"), (31, "http://[", "<p>z"), (None, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((str(i), wrappers.main_text(p, wrappers._dump(wrappers.as_wrapper(wrappers.read_page(p or "")[0])))) for i, _, p in rows)
    for part, size in ((64, 1 << 20), (2, 0)):
        monkeypatch.setattr(wrappers, "PART", part)
        got = wrappers.extract(pages, broadcast_bytes=size)
        assert sorted((str(r["page_id"]), r["text"]) for r in got.collect()) == want
        assert wrappers.extract(pages.limit(0), broadcast_bytes=size).count() == 0
