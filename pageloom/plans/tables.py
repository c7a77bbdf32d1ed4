"""The given tables in the shape of the index.

The derivations are SQL text that Spark and other SQL engines read alike, so a
check in another engine can start from the same inputs.
"""

from __future__ import annotations

import os

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.config import ContentPolicy, ScanRules, Thresholds
from pageloom.operators.index import Index
from pageloom.session import new_dir, spread
from pageloom.sources.files import write_files
from pageloom.sources.listing import as_root
from pageloom.sources.pages import pages_from_table

BASE = "../docs/"
BLOCKED = ("spam-farm.example.org", "7.example.org", "*.example.net")
RULES = ScanRules(base=BASE, blocked_domains=BLOCKED)
POLICY = ContentPolicy("src3.example.org", "/fr/", Thresholds(900, 12, 30, 150), Thresholds(300, 2, 20, 40))
LANGS = ("en", "fr", "de")  # "es" is left out to have an unknown category

# Every fiftieth document has the name of a search page.
FILE_SQL = "CASE WHEN doc_id % 50 = 0 THEN 'search-' ELSE '' END || CAST(doc_id AS VARCHAR(20)) || '.html'"
PATH_SQL = f"'../docs/' || lang || '/' || source || '.example.org/' || {FILE_SQL}"
# Stored addresses: English documents have an empty one and French documents none.
URL_SQL = (
    "CASE WHEN lang = 'en' THEN '' WHEN lang = 'fr' THEN NULL "
    "ELSE 'https://' || source || '.example.org/' || CAST(doc_id AS VARCHAR(20)) END"
)
# The documents hold no page furniture, so each gets some, in ten variants.
NOISY_SQL = """CASE doc_id % 10
 WHEN 0 THEN text || chr(10) || 'Was this page helpful? Edit this page'
 WHEN 1 THEN text || chr(10) || 'Copy' || chr(10) || 'On this page'
 WHEN 2 THEN text || chr(10) || 'color: #ff0000; 12px Arial'
 WHEN 3 THEN text || chr(10) || 'Authors: A. Person' || chr(10) || 'Written by B. Person' || chr(10) || 'and others' || chr(10)
  || chr(10) || 'Contributors:' || chr(10) || chr(10) || 'C. Person' || chr(10)
 WHEN 4 THEN split_part(text, chr(10), 1) || chr(10) || split_part(text, chr(10), 1) || chr(10) || text
 WHEN 5 THEN text || chr(10) || chr(10) || chr(10) || 'Tail.   '
 WHEN 6 THEN text || chr(10) || '=====' || chr(10) || '-----'
 WHEN 7 THEN text || chr(10) || 'exampl' || chr(10) || 've next'
 WHEN 8 THEN text || chr(10) || 'one' || chr(9) || 'two ' || chr(9) || ' three.' || chr(13) || chr(10) || 'Four'
 ELSE text END"""
# Paths of all kinds for the path functions, from every document.
PATH_FORMS_SQL = (
    PATH_SQL,
    "'../docs/' || lang || '/' || source || '.example.net/' || CAST(doc_id AS VARCHAR(20)) || '.md'",
    "'../docs/' || lang || '/genindex-' || source || '/Page' || CAST(doc_id AS VARCHAR(20)) || '.HTM'",
    f"'/mirror/' || {PATH_SQL}",
    "'../docs/' || upper(lang) || '/' || source || '-' || CAST(doc_id AS VARCHAR(20))",
    "'../docs/' || lang || CAST(doc_id AS VARCHAR(20)) || '.html'",
    "'/other/docs/' || lang || '/' || source || '/research/' || CAST(doc_id AS VARCHAR(20)) || '.txt'",
)
# Files of the pages: with and without suffixes, with odd names, hidden, in further directories, an image.
PAGE_FILE_SQL = """regexp_replace(path, '/+$', '') || '-' || CAST(seq AS VARCHAR(20)) || CASE seq % 7
 WHEN 0 THEN '.html' WHEN 1 THEN ' a b%20 #é.HTML' WHEN 2 THEN '.png' WHEN 3 THEN '' WHEN 4 THEN '/index.html'
 WHEN 5 THEN '/.hidden/_x.html' ELSE '.htm' END"""
# Every page within articles, tables and menus that lie in each other.
NESTED_SQL = """'<p>before</p><nav><ul><nav>' || raw || '</nav>menu</ul></nav><article><section>' || raw || '</section><article>inner '
 || CAST(seq AS VARCHAR(20)) || '<table><tr><td><table><tr><td>cell</td></tr></table>rest</td></tr></table><article>innermost</article>'
 || '<dl><dt>term<dd>meaning</dl></article>after it</article><p>between</p><article>second<main>' || raw || '</main></article>'"""
# Waves of a stream of pages: which of them come, and what their html is then.
WAVES_SQL = (
    ("page_id % 5 <> 0", "html"),
    ("page_id % 2 = 0", "replace(html, '</p>', ' once more.</p>')"),
    ("page_id % 3 = 0", "replace(html, '</p>', ' and again.</p><p>End</p>')"),
)
DELETED_HOST = ".example.org/"
LINKED, BROKEN = "en/links.example.org/linked.html", "en/links.example.org/broken.html"
MARKDOWN_SQL = """'---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10)
 || '# Heading of **' || lang || '**' || chr(10) || chr(10) || '> quoted [link](https://example.org/a) & `code`' || chr(10)
 || chr(10) || '- item *one*' || chr(10) || '1. item <b>two</b> ![image](a.png)' || chr(10)
 || '```text' || chr(10) || 'a < b > c &copy;' || chr(10) || '```' || chr(10)
 || '~~~ py' || chr(10) || '# *not* a `head`' || chr(10) || '```' || chr(10) || 'still [code](x)' || chr(10) || '~~~' || chr(10)
 || '> ~~~' || chr(10) || '> quoted *code* > x' || chr(10) || '> ~~~' || chr(10)
 || '- list' || chr(10) || '  ````' || chr(10) || '  - in *list*' || chr(10) || '  ```' || chr(10) || '  ````' || chr(10) || chr(10)
 || '      deep_*code*' || chr(10) || chr(10) || '  more *text*' || chr(10) || chr(10) || '    still *text*' || chr(10) || chr(10)
 || 'after' || chr(10) || chr(10) || '    indented *code*' || chr(10) || chr(10) || text"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, in enough tasks for work on their texts."""
    documents = read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))
    return spread(documents, "doc_id")


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` with page furniture in every text."""
    documents = read_documents(spark, sf_dir)
    return documents.select("doc_id", F.expr(NOISY_SQL).alias("text"))


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the index."""
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr(PATH_SQL).alias("path"),
        F.expr(URL_SQL).alias("url"),
        "text",
        F.col("lang").alias("category"),
    )


def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the index."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )


def index_tables(spark: SparkSession, sf_dir: str) -> Index:
    return Index(index_documents(spark, sf_dir), index_vectors(spark, sf_dir))


def index_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all kinds, each once."""
    documents = read_documents(spark, sf_dir, "doc_id", "lang", "source")
    forms = F.array(*[F.expr(form) for form in PATH_FORMS_SQL])
    pages = read_table(spark, sf_dir, "pages")
    return documents.select(F.explode(forms).alias("path")).union(pages.select("url"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages as ``(path, raw, seq)``."""
    return pages_from_table(spread(read_table(spark, sf_dir, "pages"), "page_id"), BASE)


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per vector: for all documents, or for the category of its own document."""
    vectors = read_table(spark, sf_dir, "embeddings")
    languages = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    own = F.when(F.col("label") % 2 == 0, F.col("lang"))
    return vectors.join(languages, vectors["vec_id"] == languages["doc_id"], "left").select(
        F.col("vec_id").alias("query_id"), own.alias("category"), "embedding"
    )


def mirror_of_pages(spark: SparkSession, sf_dir: str) -> str:
    """The pages written as files, in a directory of their own.

    Where links can be made there are three: to the directory's own parent, to the file of the first page, and
    to nothing.
    """
    folder = as_root(new_dir(spark, "mirror")) + "/docs"
    files = web_pages(spark, sf_dir).select(
        "seq", F.substring(F.expr(PAGE_FILE_SQL), len(BASE) + 1, 10**6).alias("name"), F.encode("raw", "UTF-8").alias("content")
    )
    write_files(files, folder)
    system, inner = FileSystem.from_uri(folder)
    first = files.orderBy("seq").select("name").head()
    if isinstance(system, LocalFileSystem) and first:
        os.makedirs(os.path.dirname(f"{inner}/{LINKED}"), exist_ok=True)
        os.symlink(f"{inner}/{first['name']}", f"{inner}/{LINKED}")
        os.symlink(f"{inner}/nothing", f"{inner}/{BROKEN}")
        os.symlink(inner, f"{inner}/en/up")
    return folder
