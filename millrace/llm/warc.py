"""WARC archives with revisit resolution (operator 4).

Three passes over files in the shared folder. The crawl pass writes each partition of pages to one archive, a response
record per row, and returns slim headers (part, position, id, digest, length). Headers are shuffled by payload digest,
never payloads: of records with equal payloads of at least `LEAST` bytes the one with the largest id (then part, then
position) stays response and the others are joined to it. The last pass streams each archive beside its decisions and
writes a deduplicated archive with fresh headers, where a revisit keeps its HTTP header only and names the record that
it repeats. One digest may be that of a third of all rows: headers are aggregated by digest and salt first, and the
join is by digest and salt.

Archives are gzip files with a member per record; page ids stand in `X-Page-Id`. A file is written under a name of its
attempt and renamed, so that tasks can be repeated.

Defined results: a null html is an empty payload; null urls give no WARC-Target-URI; null ids are smaller than all
others and read back null; repeated rows are records of their own, all but one of which revisit; an empty table gives
no archives and no rows; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import filesystem, materialise, publish, salt, shared_dir, slices, texts_of

LEAST = 1000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, part: int, pos: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{part}:{pos}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[2]
    return int(page) if page else None


def compose(kind: str, page_id: int | None, part: int, pos: int, url: str | None, digest: bytes, length: int, payload: bytes, refers: tuple | None = None) -> bytes:
    """One gzip member that holds one WARC record. refers: (page id, part, position, url) of the record revisited."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, part, pos)}", f"WARC-Date: {DATE}"]
    # Line ends in a URL would break the header.
    clean = lambda u: u.replace("\r", "%0D").replace("\n", "%0A")
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers[:3])}"]
        if refers[3] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(refers[3])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC header, HTTP header, payload) of each record of a gzip archive, one at a time."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            head = _header(f)
            block = f.read(int(head["content-length"]))
            http, _, payload = block.partition(b"\r\n\r\n")
            fields = (x.split(":", 1) for x in http.decode("latin-1").split("\r\n")[1:])
            yield head, {k.strip().lower(): v.strip() for k, v in fields}, payload


def _header(f) -> dict[str, str]:
    head = {}
    while (line := f.readline()) and line.strip():
        k, _, v = line.decode().partition(":")
        head[k.strip().lower()] = v.strip()
    return head


_HEAD = T.StructType([T.StructField("part", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("bytes", T.LongType())])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[f.dataType.simpleString()]) for i, f in enumerate(schema)], names=[f.name for f in schema])


def crawl(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes raw archives, one per partition, and returns their headers."""

    def run(batches):
        from pyspark import TaskContext

        part, pos = TaskContext.get().partitionId(), 0
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        heads: list[tuple] = []

        def fill(out):
            nonlocal pos
            for whole in batches:
                for batch in slices(whole):
                    for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                        digest = hashlib.sha1(html).digest()
                        out.write(compose("response", page, part, pos, url, digest, len(html), html))
                        heads.append((part, pos, page, url, digest, len(html)))
                        pos += 1

        publish(fs, f"{root}/{part:06d}.warc.gz", fill)
        for at in range(0, len(heads), 8192):
            yield _batch(heads[at : at + 8192], _HEAD)

    work = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return materialise(work.mapInArrow(run, _HEAD))


def resolve(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """Headers with `original`, the header of the record that a revisit repeats, null for responses."""
    salted = heads.withColumn("salt", salt("page_id", "part", "pos"))
    large = salted.filter(F.col("bytes") >= least)
    first = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "part", "pos", "url")
    some = large.groupBy("digest", "bytes", "salt").agg(F.max(first).alias("first"), F.count("*").alias("n"))
    groups = some.groupBy("digest", "bytes").agg(F.max("first").alias("original"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1")
    spread = groups.select("digest", "bytes", "original", F.explode("salts").alias("salt"))
    joined = salted.join(spread, ["digest", "bytes", "salt"], "left")
    same = (F.col("part") == F.col("original.part")) & (F.col("pos") == F.col("original.pos"))
    return joined.withColumn("original", F.when(~same, F.col("original"))).drop("salt")


_DONE = T.StructType([T.StructField("part", T.LongType()), T.StructField("records", T.LongType())])


def rewrite(decided: DataFrame, raw: str, path: str) -> DataFrame:
    """Writes the deduplicated archives and returns (part, records)."""
    o = F.col("original")
    slim = decided.select("part", "pos", o.isNotNull().alias("revisits"), o["page_id"].alias("op"), o["part"].alias("opart"), o["pos"].alias("opos"), o["url"].alias("ourl"))
    parts = max(1, slim.select("part").distinct().count())
    slim = slim.repartition(parts, "part").sortWithinPartitions("part", "pos")

    def run(batches):
        fs, old = filesystem(raw)
        _, new = filesystem(path)
        fs.create_dir(new, recursive=True)
        decisions = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(decisions, None)
        while row:
            part, n = row[0], 0

            def fill(out, part=part):
                nonlocal row, n
                with fs.open_input_stream(f"{old}/{part:06d}.warc.gz", compression=None) as stream:
                    for head, http, payload in records(stream):
                        if row is None or row[:2] != (part, n):
                            raise ValueError(f"archive {part} and its decisions differ at {n}")
                        page = page_of(head["warc-record-id"])
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                        kind = "revisit" if row[2] else "response"
                        out.write(compose(kind, page, part, n, head.get("warc-target-uri"), digest, int(http["content-length"]), payload, row[3:] if row[2] else None))
                        n += 1
                        row = next(decisions, None)

            publish(fs, f"{new}/{part:06d}.warc.gz", fill)
            yield _batch([(part, n)], _DONE)

    return materialise(slim.mapInArrow(run, _DONE))


_READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_archives(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """What the archives hold: one row per response or revisit record, one task per archive; payloads are checked against their digests."""

    def run(batches):
        fs, root = filesystem(path)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{part:06d}.warc.gz", compression=None) as stream:
                    rows = []
                    for head, http, payload in records(stream):
                        kind = head["warc-type"]
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {head['warc-record-id']} fails its digest")
                        page, refers = head.get("x-page-id"), head.get("warc-refers-to")
                        rows.append((None if page is None else int(page), int(http["content-length"]), digest, kind, page_of(refers) if refers else None))
                        if len(rows) == 8192:
                            yield _batch(rows, _READ)
                            rows = []
                    yield _batch(rows, _READ)

    n = max(1, parts.count())
    return parts.select("part").repartitionByRange(n, "part").mapInArrow(run, _READ)


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, path: str | None = None) -> DataFrame:
    """Writes pages to deduplicated archives below `path` and reads them back."""
    raw, path = shared_dir(pages.sparkSession), path or shared_dir(pages.sparkSession)
    heads = crawl(pages, raw, id_col, url_col, html_col)
    done = rewrite(resolve(heads, least), raw, path)
    fs, root = filesystem(raw)
    if done.take(1):
        fs.delete_dir(root)
    return read_archives(pages.sparkSession, path, done)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
        max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM s
"""
