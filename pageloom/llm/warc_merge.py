"""Operator 1: WARC archives, and a merged index of their captures.

``write_archives`` writes one gzip member per record into ``.warc.gz`` files.
``read_archives`` reads them back, checks every payload against its digest, and
gives the captures of each file as a run sorted by (URL key, time, page).
``merge_runs`` merges the runs: the keys are cut into ranges, and each range merges its
parts of all runs with a loser tree, so the ranges one after the other are
the globally ordered capture history.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest
page_id is a response and the others revisit it. Null html is an empty payload;
a null page_id is below all others; a null url has the empty key. Rows that
share the id of the response are all responses.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import add_columns, skew_join
from pageloom.session import materialize, new_dir

FILE_BYTES = 64 << 20  # a file is closed when it has reached this size
RANGE_ROWS = 200_000  # captures that one task merges
NEVER = 946_684_800  # 2000-01-01; pages without a time of capture get it plus their id in seconds


def url_key(url: str | None) -> str:
    """The URL with its host reversed and without scheme, port, ``www`` and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    path = parts.path + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){path.lower() or '/'}" if host else path.lower()


def _member(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode()
    gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gzip.compress(head + payload + b"\r\n\r\n") + gzip.flush()


def _headers(kind: str, page, url: str | None, second: int, digest: str, size: int) -> list[tuple[str, str]]:
    when = datetime.fromtimestamp(second, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    named = "" if page is None else str(page)
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{named} {when} {url}')}>"),
        ("WARC-Date", when),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", named),
        ("X-Payload-Length", str(size)),
        ("X-Has-URL", str(int(url is not None))),
        ("X-URL", quote(url or "")),
    ]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """Write ``(page_id, url, html)``; returns ``(file, records)`` of the files, stored.

    ``captured`` names a column of seconds since 1970. A task that runs again writes
    files of new names; only files in the returned table are part of the archive.
    """
    second = F.col(captured) if captured else F.lit(NEVER) + F.coalesce("page_id", F.lit(0))
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", second.cast("long").alias("second"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")
    )
    best = rows.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id"))

    def start_members():
        def one(page, url, second, payload, sha1, size):
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            return _member(_headers("response", page, url, second, digest, size), payload)

        return lambda *columns: ([one(*row) for row in zip(*columns, strict=True)],)

    # Payloads travel as the compressed records that most of them become.
    inputs = ["page_id", "url", "second", "payload", "sha1", "size"]
    members = add_columns(rows, inputs, "member binary", start_members).drop("payload")
    refers = F.when((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    decided = skew_join(members, best, ["sha1"]).withColumn("refers_to", refers)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        done, out, records, size, path = [], None, 0, 0, ""

        def close():
            nonlocal out, records, size
            if out is not None:
                out.close()
                done.append((path, records))
            out, records, size = None, 0, 0

        for batch in batches:
            for page, url, second, sha1, length, member, refers_to in zip(
                *(batch[c] for c in ("page_id", "url", "second", "sha1", "size", "member", "refers_to")), strict=True
            ):
                if not pd.isna(refers_to):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    page = None if pd.isna(page) else int(page)
                    headers = _headers("revisit", page, url, second, digest, length)
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    member = _member([*headers, ("WARC-Profile", profile), ("X-Refers-To", str(int(refers_to)))], b"")
                if out is None:
                    path = f"{base}/{name}-{len(done):04d}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= FILE_BYTES:
                    close()
        close()
        yield pd.DataFrame(done, columns=["file", "records"]).astype({"file": str, "records": "int64"})

    return materialize(decided.mapInPandas(write, "file string, records long"), "archive-files")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record of a file."""
    while data:
        gzip = zlib.decompressobj(31)
        record = gzip.decompress(data) + gzip.flush()
        data = gzip.unused_data
        head, _, rest = record.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


RUN = (
    "run string, place long, url_key string, second long, page_id long, url string, payload_bytes long,"
    " payload_digest string, record_type string, refers_to long"
)


def read_archives(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The captures of the files; those of one file are a sorted run, numbered by ``place``.

    A file is held by one task; its size is bounded by ``FILE_BYTES``.
    """
    names = RUN.replace(",", "").split()[::2]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, expected in zip(batch["file"], batch["records"], strict=True):
                with store.open_input_stream(file, compression=None) as stream:
                    data = stream.read()
                found = []
                for headers, payload in records_of(data):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    kind = headers["WARC-Type"]
                    if kind == "response":
                        digest = _sha1(payload)
                        if f"sha1:{digest}" != headers["WARC-Payload-Digest"] or size != len(payload):
                            raise ValueError(f"damaged record in {file}")
                    url = unquote(headers.get("X-URL", "")) if headers["X-Has-URL"] == "1" else None
                    second = int(datetime.fromisoformat(headers["WARC-Date"]).timestamp())
                    page = int(headers["X-Page-ID"]) if headers["X-Page-ID"].strip() else None
                    refers = int(headers["X-Refers-To"]) if "X-Refers-To" in headers else None
                    found.append((url_key(url), second, page, url, size, digest, kind, refers))
                if len(found) != expected:
                    raise ValueError(f"{file} has {len(found)} records, not {expected}")
                found.sort(key=_order)
                if found:
                    run = pd.DataFrame(found, columns=names[2:]).astype({"page_id": "Int64", "refers_to": "Int64"})
                    run.insert(0, "place", range(len(run)))
                    run.insert(0, "run", file.rpartition("/")[2])
                    yield run

    spread = files.repartition(max(1, min(files.count(), 1 << 15)), "file")
    return spread.mapInPandas(read, RUN)


def _sha1(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None or row[2] is pd.NA else row[2]


def loser_tree_merge(runs: list[list]) -> Iterator[tuple[int, int]]:
    """``(run, place)`` of all keys of sorted runs, in order; equal keys by run.

    Every inner node keeps the loser of the match below it, the winner goes up;
    after the winner has left, only the matches on its path are played again.
    """
    k = len(runs)
    heads = [0] * k
    key = lambda r: (heads[r] >= len(runs[r]), runs[r][heads[r]] if heads[r] < len(runs[r]) else (), r)
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if key(a) <= key(b) else (b, a)
    winner = winners[1] if k > 1 else 0
    for _ in range(sum(map(len, runs))):
        yield winner, heads[winner]
        heads[winner] += 1
        best, node = key(winner), (winner + k) // 2
        while node:
            if (other := key(losers[node])) < best:
                best, winner, losers[node] = other, losers[node], winner
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order, with ``range`` and the ``position`` in it.

    A hot URL is cut like any other key range, since time and page are part of the key.
    """
    runs = materialize(runs, "capture-runs")
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // RANGE_ROWS + 1)
    dealt = runs.repartitionByRange(parts, F.col("url_key"), F.col("second"), F.col("page_id").asc_nulls_first())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        pages = rows["page_id"].astype("Int64")
        rows["page_id"], rows["refers_to"] = pages, rows["refers_to"].astype("Int64")
        keys = list(zip(rows["url_key"], rows["second"], pages.fillna(-1), strict=True))
        starts = [0, *(rows.index[rows["run"] != rows["run"].shift()][1:]), len(rows)]
        lists = [keys[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        order = [starts[run] + place for run, place in loser_tree_merge(lists)]
        merged = rows.iloc[order].drop(columns=["run", "place"])
        merged.insert(0, "position", range(len(merged)))
        merged.insert(0, "range", TaskContext.get().partitionId())
        yield merged

    out = "range int, position long, " + RUN.partition("place long, ")[2]
    return dealt.sortWithinPartitions("run", "place").mapInPandas(merge, out)


def capture_history(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of the pages, read back and merged."""
    spark = pages.sparkSession
    folder = new_dir(spark, "archives")
    files = write_archives(pages, folder, least_bytes)
    return merge_runs(read_archives(spark, files, folder))
