"""WARC archives with a two-level capture index.

Archives: one gzip member a record; a payload that an earlier page has is a revisit record. Index: the captures' keys (host reversed, then path, then page) are
range-sorted; each range is written as compressed blocks of entries, and a sparse directory keeps the first key of every block. A lookup finds its range among the
ranges' first keys, its block by binary search in that range's directory, its entry by binary search in the block, and then reads the record's bytes alone.

Tasks write files under names of their own and return what they wrote; only files that a finished task has returned are ever read, so a task that is
run again leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import materialize, new_dir, shuffle_partitions

#: Payloads of fewer bytes are always stored.
LEAST = 100
BLOCK_ENTRIES = 256
DATE = "1970-01-01T00:00:00Z"  # the pages have no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:\d*)?([^#]*)", re.I)


def safe_uri(url: str | None) -> str:
    """url with everything but printable ASCII percent-encoded, so that it stays within a header line."""
    return "".join(chr(b) if 33 <= b <= 126 else f"%{b:02X}" for b in (url or "").encode())


def capture_key(url: str | None, page_id: int | None, digest: str) -> str:
    """Reversed host, path and query, then page and payload, which tell captures of one URL apart: com,example,www)/path 00000000000000000007 9f86d081884c7d65."""
    url = safe_uri(url)
    m = _URL.match(url)
    host = f"{','.join(reversed(m[1].lower().split('.')))}{m[2] or ''}){m[3] or '/'}" if m else f"){url}"
    return f"{host} {'-' if page_id is None else f'{page_id:020d}'} {digest[:16]}"


def _record(kind: str, page_id: int | None, url: str, digest: str, block: bytes, more: str = "") -> bytes:
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {url}\r\n"
        f"WARC-Payload-Digest: sha256:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def _zipped(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


def with_first_pages(pages: DataFrame, salts: int = 16) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the smallest page with an equal payload of at least LEAST bytes; null for that page.

    A payload that very many pages share is met in ``salts`` places. Pages without an id are never referred to.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    first = p.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    later = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return p.join(first, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", later.alias("refers_to"))


_CAPTURE = "key string, page_id long, file string, start long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, payload, digest, refers_to), a file for each batch of rows: (key, page_id, file, start, length) each."""
    kinds = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        for b in batches:
            t = {"key": [], "page_id": [], "file": [], "start": [], "length": []}
            name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
            # The file is closed before its rows are returned.
            with where.open_output_stream(f"{path}/{name}", compression=None) as out:
                block = b"software: capture writer\r\nformat: WARC File Format 1.1\r\n"
                info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\n"
                info += f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
                at += out.write(_zipped(info.encode() + block + b"\r\n\r\n"))
                for page_id, url, payload, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    if refers_to is None:
                        record = _record("response", page_id, safe_uri(url), digest, http + payload)
                    else:
                        more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
                        record = _record("revisit", page_id, safe_uri(url), digest, http, more)
                    z = _zipped(record)
                    out.write(z)
                    for column, x in zip(t.values(), (capture_key(url, page_id, digest), page_id, name, at, len(z)), strict=True):
                        column.append(x)
                    at += len(z)
            yield pa.RecordBatch.from_pydict(t, schema=kinds)

    return materialize(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, _CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by key into ranges, each a file of compressed blocks; returns the directory: (part, first_key, start, length) a block."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        name = f"part-{uuid.uuid4().hex}.idx"
        rows, found, at = [], {"part": [], "first_key": [], "start": [], "length": []}, 0
        out = None

        def flush(n: int):
            nonlocal out, at, rows
            if out is None:
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            z = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows[:n]).encode(), 5)
            for column, x in zip(found.values(), (name, rows[0][0], at, len(z)), strict=True):
                column.append(x)
            at += out.write(z)
            rows = rows[n:]

        for b in batches:
            rows += zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
            while len(rows) >= BLOCK_ENTRIES:
                flush(BLOCK_ENTRIES)
        if rows:
            flush(len(rows))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("part", pa.string()), ("first_key", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    n = shuffle_partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key").sortWithinPartitions("key").select("key", "file", "start", "length")
    return materialize(ordered.mapInArrow(write, "part string, first_key string, start long, length long"), "directory")


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, body


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "None" else int(found)


def parsed(record: bytes) -> tuple[int | None, str, int | None, int, str, bytes | None]:
    """Page, type, the page that a revisit refers to, bytes of the full payload, its digest, and the payload (of a response, where it is checked)."""
    head, rest = _headers(record)
    block = rest[: int(head["content-length"])]
    http, payload = _headers(block)
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "revisit":
        return _page(head["warc-record-id"]), "revisit", _page(head["warc-refers-to"]), int(http["content-length"]), digest, None
    found = hashlib.sha256(payload).hexdigest()
    if found != digest:
        raise ValueError(f"payload of {head['warc-record-id']} has digest {found}, not {digest}")
    return _page(head["warc-record-id"]), "response", None, len(payload), found, payload


def fetch(wanted: DataFrame, directory: DataFrame, index_folder: str, archive_folder: str, payloads: bool = False) -> DataFrame:
    """Look up wanted (key) and read the records: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    Only the first key of each range is known everywhere, as many keys as the index has ranges. Keys that the index lacks give no row.
    """
    ranges = [(r[0], r[1]) for r in directory.groupBy("part").agg(F.min("first_key").alias("k")).select("k", "part").collect()]
    ranges.sort()
    firsts, parts = [k for k, _ in ranges], [p for _, p in ranges]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [max(0, bisect_right(firsts, k) - 1) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([parts[i] if parts else None for i in at], pa.string())], names=["key", "part"])

    def read(lookups: pa.Table, blocks: pa.Table) -> pa.Table:
        where, index = _open(index_folder)
        _, archive = _open(archive_folder)
        blocks = blocks.sort_by("first_key")
        heads, start, length = (blocks[c].to_pylist() for c in ("first_key", "start", "length"))
        hits, now, entries, keys = [], -1, [], []
        with where.open_input_file(f"{index}/{blocks['part'][0].as_py()}") as f:
            for key in sorted(lookups["key"].to_pylist()):
                at = bisect_right(heads, key) - 1
                if at < 0:
                    continue
                if at != now:
                    now = at
                    entries = [x.split("\t") for x in zlib.decompress(f.read_at(length[at], start[at])).decode().split("\n")]
                    keys = [x[0] for x in entries]
                i = bisect_right(keys, key) - 1
                if i >= 0 and keys[i] == key:
                    hits.append((entries[i][1], int(entries[i][2]), int(entries[i][3])))
        hits.sort()
        out, file, name = [], None, None
        for n, at, size in hits:
            if n != name:
                if file is not None:
                    file.close()
                name, file = n, where.open_input_file(f"{archive}/{n}")
            page_id, kind, refers_to, n_bytes, digest, payload = parsed(zlib.decompress(file.read_at(size, at), 31))
            out.append((page_id, n_bytes, digest, kind, refers_to, payload)[: 6 if payloads else 5])
        if file is not None:
            file.close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if payloads else 5]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names[: len(kinds)])

    def found(lookups: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            lookups = lookups.slice(0, 0)
        return read(lookups, blocks) if lookups.num_rows else _nothing(payloads)

    routed = wanted.select("key").mapInArrow(route, "key string, part string")
    return routed.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(found, schema)


def _nothing(payloads: bool) -> pa.Table:
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.schema(fields + [("payload", pa.binary())] * payloads).empty_table()


def archive_round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Archive pages (page_id, url, html) in the shared folder, index them, and read every record back through the index.

    Null html is an empty payload, a null url an empty one. Rows that are equal have equal records, any of which may be read for each of them. A page without an id is archived, and is a revisit if any page with an id has its payload. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    archives, index = new_dir(spark, "warc"), new_dir(spark, "warc-index")
    captures = write_archives(with_first_pages(pages), archives)
    directory = write_index(captures, index)
    return fetch(captures.select("key"), directory, index, archives, payloads)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_page FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
