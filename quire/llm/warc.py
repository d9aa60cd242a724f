"""WARC archives (a gzip member for each record) with an index.

Writing: each task writes its pages to archives of its own and returns their index rows (path, offset,
length, url, digest, ...), so payloads are never shuffled; only digests are, to find equal payloads. The index is a
Parquet table. A task names its archives for its own attempt and Spark commits the index rows of one attempt: what a
lost executor left is never read.

Reading: the selected rows of the index are sorted by archive and offset, ranges that lie close
together are read at once, and records are cut out of them.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, shuffle_partitions, written

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 * 2**20
#: Ranges with at most this gap are read at once, up to this length (or one record).
GAP, MOST_READ = 64 * 2**10, 8 * 2**20
#: Fixed values of the format.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id string, url string, record_type string, refers_to string, payload_digest string, path string, offset long, length long"


def record_id(page_id: str | None, url: str, digest: str) -> str:
    """The same for rows of the same id and payload; rows of no id are told apart by url too."""
    own = f"{page_id} {digest}" if page_id is not None else f"null {url} {digest}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {own}'.encode()).digest())}>"


def make_record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, '', digest)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _write(batches: Iterator[pd.DataFrame], folder: str, archive_bytes: int) -> Iterator[pd.DataFrame]:
    """Index rows leave only when their archive is closed, so what the index names can be read."""
    file, offset, path = None, 0, ""
    rows: list[tuple] = []

    def closed() -> pd.DataFrame:
        file.close()
        done = pd.DataFrame(rows, columns=[c.split()[0] for c in _INDEX.split(", ")])
        rows.clear()
        return done

    for batch in batches:
        for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
            if file is None:
                path, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                store, inside = _store(path)
                store.create_dir(inside.rpartition("/")[0], recursive=True)
                file = store.open_output_stream(inside, compression=None)  # each record is compressed by itself
            payload = html.encode()
            digest = hashlib.sha256(payload).hexdigest()
            data = gzip.compress(make_record(page_id, url, payload, digest, refers_to), 6, mtime=0)
            file.write(data)
            kind = "response" if refers_to is None else "revisit"
            rows.append((page_id, url, kind, refers_to, digest, path, offset, len(data)))
            offset += len(data)
            if offset >= archive_bytes:
                yield closed()
                file = None
    if file is not None:
        yield closed()


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index.

    Null html is an empty payload. Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is the
    response, the others revisit it (null page_ids last; if all are null, all are responses); rows that repeat that page_id are
    responses too. A page_id may repeat with other payloads: a record is named by its page_id and its payload. White space and control characters in a URL are percent-encoded; a null url is about:blank. An empty table gives
    an empty index and no archive. Other columns are not read.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.when(F.octet_length(html) >= LEAST_REVISIT, F.sha2(html, 256)).alias("digest"))
    shared = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1 and first is not null").select("digest", "first"), "shared_digests")
    rows = rows.join(shared, "digest", "left")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    # Ids travel as text: pandas has no null integers.
    rows = rows.select(F.col("page_id").cast("string"), url.alias("url"), "html", refers_to.cast("string").alias("refers_to"))
    index = written(rows.mapInPandas(lambda b: _write(b, path, archive_bytes), _INDEX), "warc_index")
    return index.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def _store(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def parse(record: bytes) -> dict:
    """Headers and payload of a record; a revisit has no payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    return {"fields": fields, "payload": payload if fields["WARC-Type"] == "response" else None}


def _coalesced(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, row numbers) of reads for sorted (offset, length) rows."""
    start = end = None
    own: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if own and (offset - end > GAP or offset + length - start > MOST_READ):
            yield start, end, own
            own = []
        if not own:
            start = end = offset
        own.append(i)
        end = max(end, offset + length)
    if own:
        yield start, end, own


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, rows in batch.groupby("path", sort=False):
            store, inside = _store(path)
            ids, offsets, lengths = rows["page_id"].tolist(), rows["offset"].tolist(), rows["length"].tolist()
            with store.open_input_file(inside) as file:
                for start, end, own in _coalesced(list(zip(offsets, lengths))):
                    file.seek(start)
                    data = file.read(end - start)
                    out = []
                    for i in own:
                        at = offsets[i] - start
                        x = parse(zlib.decompress(data[at : at + lengths[i]], 31))
                        f = x["fields"]
                        out.append((ids[i], f["WARC-Target-URI"], f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), x["payload"]))
                    yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "record_id", "refers_to_id", "payload"])


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an index name: page_id, url, record_type, record_id, refers_to_id, payload (binary, null for revisits)."""
    kind = index.schema["page_id"].dataType
    rows = index.select(F.col("page_id").cast("string"), "path", "offset", "length")
    part = F.floor(F.col("offset") / MOST_READ)  # neighbours stay together, large archives are read by many tasks
    rows = rows.repartition(shuffle_partitions(index.sparkSession), "path", part).sortWithinPartitions("path", "offset")
    got = rows.mapInPandas(
        _read_ranges, "page_id string, url string, record_type string, record_id string, refers_to_id string, payload binary"
    )
    return got.withColumn("page_id", F.col("page_id").cast(kind))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    got = read_records(index).select(
        "page_id", "record_type", "record_id", "refers_to_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
    )
    got = written(got, "records")
    responses, revisits = got.where("record_type = 'response'"), got.where("record_type <> 'response'")
    of_id = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    referred = revisits.select("page_id", "record_type", "refers_to_id").join(of_id, "refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast(got.schema["page_id"].dataType)).select(*columns).union(referred.select(*columns))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h AS mh, min(page_id) AS first FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY h)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN m ON h = mh
"""
