import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import StringEndsWith, StringStartsWith

from helpers import plan, rows, values
from pageloom.config import ScanRules
from pageloom.functions import extract
from pageloom.plans.build import BuildSettings, extract_pages
from pageloom.sources import listing
from pageloom.sources.files import list_files, scan_files
from pageloom.sources.pages import first_segment, mirror_path


def test_decode(spark):
    cases = [b"a\r\nb\rc\n", b"\xffa\xc3", b"caf\xc3\xa9", b"\xe2\x82", b""]
    got = values(spark, [(c,) for c in cases], "content binary", extract.decode_text(F.col("content")))
    assert got == [c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in cases]


@pytest.mark.parametrize(
    "path, raw, kind, by_name",
    [
        ("/d/a.md", "<html>", "markdown", "markdown"),
        ("/d/a.MD", "", "markdown", "markdown"),
        ("/d/a.html", "", "html", "html"),
        ("/d/a.HTM", None, "html", "html"),
        ("/d/a", "  <!DOCTYPE html>", "html", "html"),
        ("/d/a", "x" * 2043 + "<html", "html", "html"),
        ("/d/a", "x" * 2044 + "<html", "none", "none"),
        ("/d/a", None, "none", "none"),
        ("/d/b.org/a", "<HTML>", "none", "html"),
        ("/d/a.txt", "<html>", "none", "none"),
    ],
)
def test_kind(spark, path, raw, kind, by_name):
    for name, expected in ((False, kind), (True, by_name)):
        column = extract.doc_kind(F.col("path"), F.col("raw"), sniff_by_name=name)
        assert values(spark, [(path, raw)], "path string, raw string", column) == [expected]


def html(spark, *pages):
    return values(spark, [(p,) for p in pages], "raw string", extract.html_main_text(F.col("raw")))


def test_html(spark):
    article = "<body>out<article class='a'>one<br>two<table><tr><td>no</td></tr></table>&lt;b&gt; &amp;lt;</article></body>"
    body = "<html><BODY id=x><nav>no</nav><p>a <b>b</b></p><!-- no\n --><script>no('</p>')</script></BODY>"
    assert html(spark, article, body) == ["one\ntwo<b> &lt;", "\na b\n"]
    assert html(spark, "plain", "<p> </p>", "", None) == ["plain", "", "", ""]


def test_articles_beyond_one_line_and_nested_names(spark):
    assert html(spark, "<article>\na\n</article><article>b</article>") == ["\na\n\nb"]
    assert html(spark, "<navigation>kept</navigation>", "<article-card>x</article-card>") == ["kept", "x"]


NESTED = {
    "<body>o<article>a<article>b</article>c</article>x<article>d</article></body>": "a\nb\nc\nd",
    "<article>1<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>2<nav><ul><nav>n</nav>m</ul></nav>3</article>": "123",
    "<nav><article>menu</article></nav><body>main<footer>a<footer>b</footer>c</footer></body>": "main",
    "<article>a<article>b<article>c</article><article>d</article>e</article><article>f</article>g</article>": "a\nb\nc\n\nd\ne\n\nf\ng",
    "<body><table>unclosed<p>kept</p></body>": "unclosed\nkept\n",
    "<dl><dt>t<dd>d</dl><main>m<header>h</header></main>": "\n\nt\nd\n\nm\nh\n\n",
    "<ARTICLE class=x>up</ARTICLE >": "up",
    "<article></article><body>b</body>": "b",
    "<article>a\ufdd0b\ufdd1</article>": "ab",
    "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>": "\n" * 5000 + "deep" + "\n" * 5000,
    "<table>" * 200 + "in" + "</table>" * 200 + "after": "after",
    "<article>" * 200 + "in" + "</article>" * 200: "\n" * 199 + "in" + "\n" * 199,
    "<article>" + "<table><tr><td>x</td></tr></table>y" * 2000 + "</article>": "y" * 2000,
    "<article>" + "<i>z</i>" * 100_000 + "</article>": "z" * 100_000,
}


def test_elements_in_elements_of_their_kind(spark):
    assert html(spark, *NESTED) == list(NESTED.values())


def test_markdown(spark):
    given = (
        "---\ntitle: x\n---\n# Head *one*\n\n> quote [text](http://a.b) ![gone](c.png)\n"
        "- item `code`\n2. two <b>bold</b> a < b & c &copy;\n```py\nx > y\n```\n[ref]: http://d.e\nend\n"
    )
    got = values(spark, [(given,), (None,), ("",)], "raw string", extract.markdown_text(F.col("raw")))
    assert got == [
        "Head one quote text item code two bold a &lt; b &amp; c &copy; py x &gt; y end", "", "",
    ]


def test_extract_by_kind(spark):
    rows_ = [("a.md", "# x"), ("a.html", "<p>y</p>"), ("a.txt", "z"), ("a.html", None)]
    column = extract.extract_text(F.col("path"), F.col("raw"), F.trim)
    assert values(spark, rows_, "path string, raw string", column) == ["x", "\ny\n", "", ""]


def test_mirror_path(spark):
    urls = ["https://a.b.org/en/1/x.html?q=1#f", "http://a.org", "https://a.org:8080/fr/#x"]
    column = mirror_path(F.col("url"), "/d/", first_segment(F.col("url")))
    assert values(spark, [(u,) for u in urls], "url string", column) == [
        "/d/en/a.b.org/en/1/x.html", "/d//a.org", "/d/fr/a.org:8080/fr/",
    ]


def test_scan_of_files(spark, tmp_path):
    base = tmp_path / "docs"
    files = {
        "vue/vuejs.org/README": (b"c\xff", "c"),
        "vue/vuejs.org/_g.html": (b"g", "g"),
        "vue/vuejs.org/_modules/e.html": (b"e", "e"),
        "vue/vuejs.org/_modules/sub/_deep/f.html": (b"f", "f"),
        "vue/vuejs.org/.well-known/_index.md": (b"h", "h"),
        "vue/vuejs.org/a b%20 #1.html": (b"<p>a</p>\r\n", "<p>a</p>\n"),
        "vue/vuejs.org/deep/er/b.MD": (b"", ""),
        "vue/vuejs.org/search.html": (b"no", None),
        "vue/vuejs.org/pic.png": (b"no", None),
        "vue/segment.com/d.html": (b"no", None),
    }
    for name, (content, _) in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (base / "empty").mkdir()
    rules = ScanRules(base=f"{base}/")
    wanted = sorted((f"{base}/{name}", raw, 0, None) for name, (_, raw) in files.items() if raw is not None)
    assert rows(scan_files(spark, [base], rules)) == wanted
    # A directory inside another one adds nothing.
    assert rows(scan_files(spark, [f"file://{base}", base / "vue"], rules)) == wanted
    assert rows(scan_files(spark, [base / "empty"], rules)) == []


def test_unreadable_files_are_counted(spark, tmp_path):
    base = tmp_path / "docs"
    (base / "vue/vuejs.org").mkdir(parents=True)
    (base / "vue/vuejs.org/good.html").write_bytes(b"<p>text</p>")
    (base / "vue/vuejs.org/gone.html").write_bytes(b"<p>text</p>")
    seen = scan_files(spark, [base], ScanRules(base=f"{base}/"))
    (base / "vue/vuejs.org/gone.html").unlink()  # after it was listed
    got = {row["path"].rsplit("/", 1)[1]: (row["raw"], row["read_error"] is not None) for row in seen.collect()}
    assert got == {"good.html": ("<p>text</p>", False), "gone.html": (None, True)}
    settings = BuildSettings(scan=ScanRules(base=f"{base}/"))
    reasons = {row["path"].rsplit("/", 1)[1]: row["skip_reason"] for row in extract_pages(seen, settings).collect()}
    assert reasons == {"good.html": "not_meaningful", "gone.html": "extract_failed"}


def tree(tmp_path):
    """A mirror with links to its parent, to a file and to nothing, and a directory that cannot be listed."""
    base = tmp_path / "docs"
    for name in ("vue/v.org/a.html", "vue/v.org/deep/b.html", "cdk/c.org/c.html", "cdk/c.org/pic.png"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"<p>x</p>")
    (base / "vue/v.org/up").symlink_to(tmp_path)
    (base / "vue/v.org/again").symlink_to(base / "cdk")
    (base / "vue/v.org/linked.html").symlink_to(base / "cdk/c.org/c.html")
    (base / "vue/v.org/broken.html").symlink_to(base / "nowhere")
    return base


def test_links_to_directories_are_not_followed(spark, tmp_path):
    base = tree(tmp_path)
    got = rows(scan_files(spark, [tmp_path], ScanRules(base=f"{base}/")).select("path", "raw", F.col("read_error").isNotNull()))
    names = [(path.removeprefix(f"{base}/"), raw, failed) for path, raw, failed in got]
    assert names == [
        ("cdk/c.org/c.html", "<p>x</p>", False), ("vue/v.org/a.html", "<p>x</p>", False), ("vue/v.org/broken.html", None, True),
        ("vue/v.org/deep/b.html", "<p>x</p>", False), ("vue/v.org/linked.html", "<p>x</p>", False),
    ]


@pytest.mark.parametrize("wanted", [1, 3, 100])
def test_a_listing_does_not_depend_on_its_partitions(tmp_path, wanted):
    base = tree(tmp_path)
    reader = listing.ListingReader([str(base)], wanted)
    parts = reader.partitions()
    assert (len(parts) > 1) == (wanted > 1)
    found = [path for part in parts for batch in reader.read(part) for path in batch["path"].to_pylist()]
    assert sorted(found) == sorted(str(base / name) for name in (
        "cdk/c.org/c.html", "cdk/c.org/pic.png", "vue/v.org/a.html", "vue/v.org/broken.html", "vue/v.org/deep/b.html", "vue/v.org/linked.html",
    ))


def test_filters_reach_the_listing(spark, tmp_path, monkeypatch):
    base = tree(tmp_path)
    listed = list_files(spark, [base])
    for kept, names in (
        (F.col("path").startswith(f"{base}/vue/v.org/deep"), ["b.html"]),
        (F.col("path") == f"{base}/cdk/c.org/c.html", ["c.html"]),
        (F.col("path").isin(f"{base}/cdk/c.org/c.html", f"{base}/vue/v.org/a.html", "x"), ["a.html", "c.html"]),
        (F.col("path").endswith(".png") & F.col("path").contains("c.org") & (F.col("size") > 1), ["pic.png"]),
    ):
        found = listed.where(kept)
        assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == names
    assert "Filter" not in plan(listed.where(F.col("path").startswith("x"))).replace("PushedFilters", "")
    opened = []
    monkeypatch.setattr(listing, "entries", lambda system, inner, own=listing.entries: opened.append(inner) or own(system, inner))
    reader = listing.ListingReader([str(base)], 1)
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{base}/cdk/"), StringEndsWith(("size",), "x")])) == [StringEndsWith(("size",), "x")]
    assert sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part)) == 2
    assert set(opened) == {str(base), str(base / "cdk"), str(base / "cdk/c.org")}


def test_directories_that_cannot_be_listed_are_errors(spark, tmp_path, monkeypatch):
    got = scan_files(spark, [tmp_path / "missing"], ScanRules(base=f"{tmp_path}/")).collect()
    assert [(r["path"], r["raw"], bool(r["read_error"])) for r in got] == [(f"{tmp_path}/missing", None, True)]


def test_decoding_keeps_replacement_characters_of_valid_files(spark):
    rows = [(bytearray("a\ufffdb\r\nc".encode()),), (bytearray(b"a\xffb\rc"),)]
    assert values(spark, rows, "content binary", extract.decode_text(F.col("content"))) == ["a\ufffdb\nc", "ab\nc"]


def test_markdown_keeps_code(spark):
    given = {
        "Call `List<String>` and `__init__` with `a**b` or **bold**": "Call List&lt;String&gt; and __init__ with a**b or bold",
        "a\n\n    Map<K,V> m; // *x*\n    - y & z\n\n- *b*": "a Map&lt;K,V&gt; m; // *x* - y &amp; z b",
        "```py\n# no *head*\n\n- x_1 > [y](z)\n```\n# head": "py # no *head* - x_1 &gt; [y](z) head",
        "``a`b*c*`` and [`f<T>`](http://a.b)": "a`b*c* and f&lt;T&gt;",
        "one ` tick\n\n*two* ` tick": "one tick two tick",
        "`&copy;` &copy;": "&amp;copy; &copy;",
        "`" + "a*b " * 50_000 + "`": ("a*b " * 50_000).strip(),
    }
    got = values(spark, [(g,) for g in given], "raw string", extract.markdown_text(F.col("raw")))
    assert got == list(given.values())


BLOCKS = {
    "~~~\n*a* `b`\n```\n~~\n~~~ \n*c*": "*a* `b` ``` ~~ c",
    "````\n```\n*x*\n`````\n*y*": "``` *x* y",
    "> ~~~\n> *q*\n> ~~~\n*t*": "*q* t",
    "> ```\n> # *q*\n\n*open to the end*": "# *q* open to the end",
    "```\n> *kept* mark\n```": "&gt; *kept* mark",
    "- a\n  ~~~\n  *b*\n  ~~~\n- *c*": "a *b* c",
    "- ```\n  *b*\n  ```\n*c*": "*b* c",
    "- a\n\n    *still text*\n\n      *code*\n\nend\n\n    *code*": "a still text *code* end *code*",
    "1. a\n\n   *text*\n\n       *code*": "a text *code*",
    "*a*\n    *no code within a paragraph*": "a no code within a paragraph",
    "    *code*\n\n    *more*\n*text*": "*code* *more* text",
    "\t*tab*\n\n- *b*": "*tab* b",
    "```x``` and *y*": "x and y",
    "~~~\nopen *to the end*": "open *to the end*",
    "~~~\n" + "*line*\n" * 3000 + "~~~\n*end*": "*line* " * 3000 + "end",
}


def test_markdown_blocks(spark):
    got = values(spark, [(g,) for g in BLOCKS], "raw string", extract.markdown_text(F.col("raw")))
    assert got == list(BLOCKS.values())


def test_references(spark):
    given = "&eacute; &#8212; &#x27; &copy;&hellip; &#128512; &amp;lt; &amp;#39; &unknown; &#55296; &#0; & &#x110000; &;"
    page = f"<article><p>{given}</p></article>"
    assert html(spark, page) == ["\n\u00e9 \u2014 ' \u00a9\u2026 \U0001f600 &lt; &#39; &unknown; &#55296; &#0; & &#x110000; &;\n"]
