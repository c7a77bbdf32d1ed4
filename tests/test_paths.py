import pytest
from pyspark.sql import functions as F

from helpers import values
from pageloom.config import ScanRules
from pageloom.functions import paths
from pageloom.sources.pages import select_category, select_sources

BASE = "/base/docs/"


def of_paths(spark, column, *given):
    return values(spark, [(path,) for path in given], "path string", column)


def test_path_to_url(spark):
    cases = {
        f"{BASE}python/docs.python.org/3/tutorial/index.html": "https://docs.python.org/3/tutorial/index",
        f"{BASE}aws_design/aws.amazon.com/well-architected/intro.md": "https://aws.amazon.com/well-architected/intro",
        "/other/location/page.html": "/other/location/page.html",
        f"{BASE}python/docs.python.org/a.htm": "https://docs.python.org/a.htm",
        f"{BASE}python/docs.python.org/a.HTML": "https://docs.python.org/a.HTML",
        f"{BASE}python/docs.python.org/a.md.html": "https://docs.python.org/a.md",
        f"{BASE}python/docs.python.org": "https://docs.python.org/",
        f"{BASE}python/file.html": "https://file.html/",
        f"{BASE}file.html": f"{BASE}file.html",
        f"x{BASE}python/docs.python.org/a.html": f"x{BASE}python/docs.python.org/a.html",
    }
    assert of_paths(spark, paths.path_to_url(F.col("path"), BASE), *cases) == list(cases.values())


def test_url_from_docs_path_anywhere(spark):
    cases = {
        "/home/me/docs/vue/vuejs.org/guide/a.html": "https://vuejs.org/guide/a",
        "/home/me/docs/vue/vuejs.org/a.md": "https://vuejs.org/a",
        "/home/docs/docs/vue/vuejs.org/a": "https://vue/vuejs.org/a",
        "/home/me/docs/vue/vuejs.org": "/home/me/docs/vue/vuejs.org",
        "docs/vue/vuejs.org/a.html": "docs/vue/vuejs.org/a.html",
    }
    assert of_paths(spark, paths.url_from_docs_path(F.col("path")), *cases) == list(cases.values())


def test_effective_url_prefers_the_stored_one(spark):
    rows = [("https://stored/", "/docs/a/b.org/c"), ("", "/docs/a/b.org/c.html"), (None, "/docs/a/b.org/c")]
    column = paths.effective_url(F.col("url"), F.col("path"))
    assert values(spark, rows, "url string, path string", column) == [
        "https://stored/", "https://b.org/c", "https://b.org/c",
    ]


def test_detect_category(spark):
    cases = {
        "/any/vue/guide/index.html": "vue",
        "/any/unknown/guide/index.html": "unknown",
        "/any/python/typescript/a.html": "typescript",
        "/ANY/CDK/a.html": "cdk",
        "/any/pythonic/a.html": "unknown",
        "python": "python",
        "": "unknown",
    }
    assert of_paths(spark, paths.detect_category(F.col("path")), *cases) == list(cases.values())


def test_skipped_file(spark):
    cases = {
        "/tmp/genindex.html": True,
        "/tmp/docs/search.html": True,
        "/tmp/howto.html": False,
        "/tmp/research.html": True,
        "/tmp/GLOSSARY.md": True,
        "/tmp/search/howto.html": False,
        "/tmp/genindex-a/howto.html": True,
        "/tmp/genindexes/howto.html": False,
        "/tmp/modindexes/howto.html": True,
    }
    assert of_paths(spark, paths.skipped_file(F.col("path")), *cases) == list(cases.values())


def test_allowed_domain(spark):
    def allowed(*given, blocked=("google-analytics.com", "*.ads.net")):
        return of_paths(spark, paths.allowed_domain(F.col("path"), BASE, blocked), *given)

    assert allowed(f"{BASE}vue/google-analytics.com/page.html") == [False]
    assert allowed(f"{BASE}vue/vuejs.org/guide.html") == [True]
    assert allowed(f"{BASE}vue/www.google-analytics.com/p") == [False]
    assert allowed(f"{BASE}vue/notgoogle-analytics.com/p") == [False]  # no dot is required
    assert allowed(f"{BASE}vue/google-analytics.com.org/p") == [True]
    assert allowed(f"{BASE}vue/x.ads.net/p", f"{BASE}vue/ads.net/p") == [False, True]
    assert allowed("/elsewhere/vue/google-analytics.com/p") == [True]
    assert allowed(f"{BASE}file.html", f"{BASE}vue//p") == [True, True]
    assert allowed(f"{BASE}vue/google-analytics.com/p", blocked=()) == [True]


def test_extract_domain_after_the_first_base(spark):
    cases = {
        f"x{BASE}vue/a.org/b": "a.org",
        f"{BASE}vue{BASE}x/b.org/c": "base",
        f"{BASE}vue": "",
        "/vue/a.org": "",
    }
    assert of_paths(spark, paths.extract_domain(F.col("path"), BASE), *cases) == list(cases.values())


def test_scan_filter(spark):
    cases = {
        f"{BASE}vue/a.org/b.HTML": True,
        f"{BASE}vue/a.org/b.htm": True,
        f"{BASE}vue/a.org/README": True,
        f"{BASE}vue/a.org/b.txt": False,
        f"{BASE}vue/a.org/404.html": False,
        f"{BASE}vue/segment.com/b.html": False,
    }
    rules = ScanRules(base=BASE)
    assert of_paths(spark, paths.scan_filter(F.col("path"), rules), *cases) == list(cases.values())


def test_sources_of_a_category(spark):
    directories = ("/d/docs/vue", "/d/docs/python/")
    known = ("vue", "python", "cdk")
    assert select_sources(directories, None, known) == directories
    assert select_sources(directories, "VUE", known) == ("/d/docs/vue",)
    with pytest.raises(ValueError):
        select_sources(directories, "rust", known)
    with pytest.raises(ValueError):
        select_sources(directories, "cdk", known)
    pages = spark.createDataFrame([(f"{BASE}vue/a",), (f"{BASE}python/a",)], "path string")
    assert [r.path for r in select_category(pages, BASE, "python", known).collect()] == [f"{BASE}python/a"]
    assert select_category(pages, BASE, "", known).count() == 2
    with pytest.raises(ValueError):
        select_category(pages, BASE, "rust", known)
