"""WARC archives: a writer, and a splittable reader of gzip members.

Reader: files are cut into byte ranges, one row each. A task looks for the gzip
magic in its range, and takes a place for a record's start only if the member
there inflates to a WARC header; from then on each member's end is the next
one's start, and a broken member sends it back to looking. A task owns the
records that start inside its range and reads past its end to finish the last,
so every record has one owner whatever the ranges. A record is inflated as it is
read, so memory follows the largest record.

Files are opened by URI through pyarrow.fs, so any store that it knows will do.
Writers name files by partition and put them in place by renaming: a task that
runs again writes the same file again.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<id>;
line breaks in urls are escaped; equal payloads are found by SHA-1; a page with a
null id is a record named urn:page:null and comes back with a null id, a revisit if
a page with an id has its payload and else a response; of rows that repeat an id
each becomes a record of the same name, and a revisit is told by name and digest
together which response it means; an empty table makes no archive; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import materialize, scratch_path, table

RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str):
    """(filesystem, path) of a URI; a bare path is a local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, uri: str, digest: str, block: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        "",
        "",
    ]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Writes (id, url, html, refers_to) to <uri>/part-*.warc.gz; returns (path, size) of the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = TaskContext.get()
        store, root = open_store(uri)
        store.create_dir(root, recursive=True)
        path = posixpath.join(root, f"part-{own.partitionId():05d}.warc.gz")
        draft = f"{path}.{own.taskAttemptId()}"
        size = 0
        with store.open_output_stream(draft) as out:
            for pdf in batches:
                for i, url, html, ref in zip(pdf["id"], pdf["url"], pdf["html"], pdf["refers_to"]):
                    i = "null" if i is None else i
                    payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                    target = f"urn:page:{i}" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                    twin = ref is not None
                    data = record(
                        "revisit" if twin else "response",
                        f"urn:page:{i}",
                        target,
                        sha1_base32(payload),
                        HTTP if twin else HTTP + payload,
                        f"urn:page:{ref}" if twin else None,
                    )
                    size += len(data)
                    out.write(data)
        if size:
            store.move(draft, path)
            yield pd.DataFrame({"path": [posixpath.join(uri, posixpath.basename(path))], "size": [size]})
        else:
            store.delete_file(draft)

    rows = pages.select(F.col("id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return rows.mapInPandas(run, "path string, size long")


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and block of an inflated record; None if it is none."""
    cut = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or cut < 0:
        return None
    fields = {}
    for line in data[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    if not fields.get("content-length", "").isdigit():
        return None
    n = int(fields["content-length"])
    block = data[cut + 4 : cut + 4 + n]
    return (fields, block) if len(block) == n else None


class Window:
    """Bytes of a file from any place on, fetched as they are asked for."""

    def __init__(self, handle, size: int, at: int) -> None:
        self.handle, self.size, self.base, self.data = handle, size, at, bytearray()

    def upto(self, end: int) -> bool:
        """Fetches until ``end`` or the file's end; whether there is anything there."""
        while self.base + len(self.data) < min(end, self.size):
            self.handle.seek(self.base + len(self.data))
            got = self.handle.read(READ_BYTES)
            if not got:
                break
            self.data += got
        return self.base + len(self.data) >= min(end, self.size)

    def forget(self, before: int) -> None:
        if before - self.base > READ_BYTES:
            del self.data[: before - self.base]
            self.base = before

    def find_magic(self, at: int, end: int) -> int:
        """The first place in [at, end) with the magic, or -1."""
        while at < end:
            self.upto(min(end, at + READ_BYTES) + len(MAGIC) - 1)
            stop = min(end, at + READ_BYTES)
            hit = self.data.find(MAGIC, at - self.base, stop - self.base + len(MAGIC) - 1)
            if hit >= 0:
                return self.base + hit
            at = stop
            self.forget(at)
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The member at ``at`` inflated, and its end; None where nothing sound starts. Headers are looked at first."""
        inflate, out, pos = zlib.decompressobj(31), [], at
        while not inflate.eof:
            self.upto(pos + 65536)
            part = self.data[pos - self.base : pos - self.base + 65536]
            if not part:
                return None
            try:
                out.append(inflate.decompress(part))
            except zlib.error:
                return None
            pos += len(part)
            if sum(map(len, out[:2])) >= 5 and not b"".join(out[:2]).startswith(b"WARC/"):
                return None
        return b"".join(out), pos - len(inflate.unused_data)


def records_in(handle, size: int, lo: int, hi: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header fields, block) of the records that start in [lo, hi)."""
    win, at = Window(handle, size, lo), lo
    while (at := win.find_magic(at, min(hi, size))) >= 0:
        got = win.member(at)
        sound = parse(got[0]) if got else None
        if sound is None:
            at += 1
            continue
        yield at, *sound
        at = got[1]
        win.forget(at)


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the files (path, size): one row each, with the payload's measures of responses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "place", "kind", "name", "target", "declared", "refers_to", "payload_bytes", "payload_digest"]
        for pdf in batches:
            for path, size, lo in zip(pdf["path"], pdf["size"], pdf["lo"]):
                store, inner = open_store(path)
                rows = []
                with store.open_input_file(inner) as handle:
                    for at, head, block in records_in(handle, int(size), int(lo), int(lo) + range_bytes):
                        kind, cut = head.get("warc-type"), block.find(b"\r\n\r\n")
                        payload = block[cut + 4 :] if head.get("content-type", "").startswith("application/http") and cut >= 0 else block
                        whole = kind == "response"
                        rows.append((path, at, kind, head.get("warc-record-id", "").strip("<>"), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-refers-to", "").strip("<>") or None, len(payload) if whole else None, sha1_base32(payload) if whole else None))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("lo"))
    ranges = ranges.repartition(F.col("path"), F.col("lo"))
    return ranges.mapInPandas(run, "path string, place long, kind string, name string, target string, declared string, refers_to string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", uri: str | None = None, least: int = 0) -> DataFrame:
    """Writes a record per page, equal payloads as revisits of the largest id, reads the archives back: one row per page."""
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    marked = base.withColumn("h", F.when(F.length(payload) >= least, F.sha1(payload)).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    last = materialize(marked.groupBy("h").agg(F.max("id").alias("last")), "payloads")
    full = marked.join(last, "h").withColumn("refers_to", F.when((F.length(payload) >= least) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last")))
    files = materialize(write_archives(full, uri or scratch_path(spark, "warc")), "archives")
    found = materialize(read_archives(files), "records")
    num = F.regexp_extract("name", r"^urn:page:(-?\d+)$", 1).try_cast("long")
    ref = F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1).try_cast("long")
    rows = found.select(num.alias("id"), "kind", "declared", F.when(F.col("refers_to").isNotNull(), ref).alias("ref"), "payload_bytes", "payload_digest")
    heads = rows.where("kind = 'response'")
    twins = rows.where("kind = 'revisit'").drop("payload_bytes", "payload_digest")
    first = heads.where("id IS NOT NULL").groupBy(F.col("id").alias("ref"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("payload_bytes"))
    first = first.withColumn("payload_digest", F.col("declared"))
    both = heads.unionByName(twins.join(materialize(first, "responses"), ["ref", "declared"]).select(heads.columns))
    return both.select(
        F.col("id").alias(id_col),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("ref").alias("refers_to"),
        (F.col("declared") == F.col("payload_digest")).alias("digest_verified"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


_BITS = "[" + ", ".join(f"'{k:04b}'" for k in range(16)) + "]"
#: What the archives must tell of the pages; the digest's hexadecimal digits are bits, five of which make a base32 sign.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, array_to_string([{_BITS}[instr('0123456789abcdef', d)] FOR d IN string_split(sha1(body), '')], '') AS bits, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(('0b' || bits[5 * k + 1 : 5 * k + 5]) AS INT)] FOR k IN range(0, 32)], '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS digest_verified FROM h"""
