"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A writer puts one record per page into archives of bounded size through Spark's text writer, so archives can
lie wherever Spark writes. A record's block is an HTTP message whose body, the payload, is the page in UTF-8.
Of pages with equal payloads of at least `least` bytes the one with the largest page_id is a response, the
others are revisits that carry the HTTP header only and refer to it.

The reader makes no use of how an archive was written. The magic can also stand inside a payload, so a scan for
it only gives candidates. Each candidate with a well-formed header points to its successor: the offset after
its block. Pointer jumping from the start of the file (each round doubles the steps of the pointers, and the
reached set grows by them) keeps the candidates that the chain reaches; the others are payload. A chain that
breaks before the end of the file is reported as `intact = false` on its records. Archives are gzip or plain;
offsets count uncompressed bytes. An archive is held by one task, so its bound (ARCHIVE_BYTES) is the writer's;
Spark's binaryFile source reads archives of up to 2 GB.

Null html is an empty payload; null url has no target header; line ends in a url become %0D and %0A. Rows that
repeat the largest page_id with its payload are all responses. Null page_id never wins; if a group has no
other, all its rows are responses. A page is written as a whole, however long. An empty table gives no archive, and no rows.
Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path

ARCHIVE_BYTES = 32 << 20
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\n[ \t]*content-length[ \t]*:(.*?)(?=\r\n)", re.I | re.S)
HEAD = b"\r\n\r\n"
RECORD = "file string, offset long, length long, intact boolean, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload another page's response has."""
    slim = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).filter(F.col("n") >= least)
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1 and refers_to is not null").drop("k")
    return slim.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Writes one WARC record per row of pages (page_id, url, html)."""
    total = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    per_file = max(1, int(archive_bytes / ((total.b or 0) / max(total.n, 1) + 600)))
    again = revisits(pages, least).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["digest"] == again["again_digest"]), "left")
    is_new = F.col("again_digest").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_new, F.concat(http, "html")).otherwise(http)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(is_new, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        F.when(is_new, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),  # the writer ends each row with the last \n
    )
    rows.select(record.alias("value")).write.option("compression", compression).option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def chain(candidates: np.ndarray, successors: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Which candidates (ascending offsets) the chain from offset 0 reaches, and whether it ends at `size`.

    successors: the offset after each candidate's record, -1 where it has none.
    """
    n = len(candidates)
    end, dead = n, n + 1
    at = np.searchsorted(candidates, successors)
    jump = np.where((at < n) & (candidates[np.minimum(at, max(n - 1, 0))] == successors), at, dead) if n else np.zeros(0, np.int64)
    jump = np.concatenate([np.where(successors == size, end, jump), [end, dead]]).astype(np.int64)
    reached = np.zeros(n + 2, bool)
    if n and candidates[0] == 0:
        reached[0] = True
        while True:
            more = reached.copy()
            more[jump[reached]] = True
            if (more == reached).all():
                break
            reached, jump = more, jump[jump]
    return reached[:n], bool(reached[end]) or size == 0


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    out: dict[bytes, bytes] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(content: bytes) -> Iterator[dict]:
    """Records of one archive that the boundary chain reaches."""
    starts, ends, heads, h, told = [], [], [], -1, []
    for m in MAGIC.finditer(content):
        if h < m.start():  # the end of a header, and the lengths told before it, hold for all candidates before it
            h = content.find(HEAD, m.start())
            h = len(content) if h < 0 else h
            told = [(x.start(), x[1].strip()) for x in LENGTH.finditer(content, m.start(), h + 2)] if h < len(content) else []
        at = bisect.bisect_left(told, (m.start(),))
        length = told[at][1] if at < len(told) else b""
        stop = h + 4 + int(length) if length.isdigit() and len(length) < 19 else -1
        starts.append(m.start())
        ends.append(stop + 4 if stop >= 0 and content[stop : stop + 4] == HEAD else -1)
        heads.append((h, stop))
    reached, intact = chain(np.array(starts, np.int64), np.array(ends, np.int64), len(content))
    for i in np.flatnonzero(reached).tolist():
        if ends[i] < 0:
            continue
        h, b = heads[i]
        fields, a = _fields(content[starts[i] : h]), h + 4
        body = content.find(HEAD, a, b)
        kind = fields.get(b"warc-type", b"")
        is_http = fields.get(b"content-type", b"").startswith(b"application/http") and body >= 0
        payload = content[body + 4 : b] if is_http else content[a:b]
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
        if kind == b"revisit":
            told = _fields(content[a:body]).get(b"content-length", b"") if is_http else b""
            digest, n = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace"), int(told) if told.isdigit() else None
            payload = None
        text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None  # noqa: B023, E731
        yield {"offset": starts[i], "length": ends[i] - starts[i], "intact": intact, "record_type": text(b"warc-type"), "record_id": text(b"warc-record-id"), "target_uri": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"), "payload_digest": digest, "payload_bytes": n, "payload": payload}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below path (see RECORD); payload is null for revisits or if not asked for."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if content[:2] == b"\x1f\x8b":
                    content = _gunzip(content)
                rows, held = [], 0
                for r in parse(content):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r | {"file": file})
                    held += len(r["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD).select(*names)


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def report(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    return read_archives(spark, path, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")


#: op5_warc in DuckDB's SQL
REPORT_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR top = page_id THEN NULL ELSE top END AS refers_to, TRUE AS intact
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
