import base64
import hashlib
import random
import zlib
from pathlib import Path

from pageloom.llm import queries, warc_merge
from pageloom.session import new_dir


def expected(pages, least=0):
    best = {}
    for page, _, html in pages:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            best[data] = max(best.get(data, page), page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        to = best.get(data)
        to = None if to == page else to
        out.append((page, len(data), digest, "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    got = queries.QUERIES["op1_warc_merge"](spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected([tuple(r) for r in pages.collect()])


def hard_pages(spark):
    rows = [(i, f"http://www.Host{i % 3}.example:80/p{i % 5}?q=é#x", "same") for i in range(40)]
    rows += [(40, None, None), (41, "", ""), (None, "http://[bad", "same"), (42, "not a url: x", "<p>é</p>")]
    rows += [(43, "http://a.example/" + "x" * 3000, "y" * 300_000), (43, "http://a.example/", "y" * 300_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_copies_nulls_and_order(spark):
    rows, pages = hard_pages(spark)
    got = warc_merge.capture_history(pages).orderBy("range", "position").collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == expected(rows)
    keys = [(r["url_key"], r["second"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert keys == sorted(keys)
    assert sorted(((r["page_id"], r["url"]) for r in got), key=str) == sorted(((p, u) for p, u, _ in rows), key=str)


def test_small_payloads_are_responses(spark):
    rows, pages = hard_pages(spark)
    got = warc_merge.capture_history(pages, least_bytes=5).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, 5)


def test_files_are_archives_of_gzip_members(spark):
    _, pages = hard_pages(spark)
    folder = new_dir(spark, "archives")
    files = warc_merge.write_archives(pages, folder).collect()
    records = [x for row in files for x in warc_merge.records_of(Path(row["file"]).read_bytes())]
    assert len(records) == sum(row["records"] for row in files) == pages.count()
    whole = Path(files[0]["file"]).read_bytes()
    first = zlib.decompressobj(31).decompress(whole)
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ") and first.endswith(b"\r\n\r\n")


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_merge.capture_history(pages).count() == 0


def test_loser_tree():
    choose = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(choose.randrange(50) for _ in range(choose.randrange(30))) for _ in range(k)]
        merged = [(runs[r][i], r, i) for r, i in warc_merge.loser_tree_merge(runs)]
        assert merged == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))
