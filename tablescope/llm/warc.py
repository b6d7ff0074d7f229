"""WARC archives with a two-level capture index.

Writing: a page is a WARC record, gzipped alone, in an archive file of its task.  Of records with equal payloads of
``MIN_REVISIT`` bytes or more, the one with the largest key is the response, the others are revisits that carry headers
only.  Files are written in the shared folder under a name that no other attempt uses; only files named in the table of
captures exist for readers, so a task that is run again after a lost executor leaves at most an unused file.

Index: captures are sorted by the page's reversed-host URL (``com,example,www)/path``) and key, ``BLOCK_LINES`` lines form
a zlib block, the blocks of a task one file, and a directory file beside it has each block's first line, offset and
length.  The list of parts (first line, files) is the upper level; it has a row for each task of the sort.

Reading: wanted captures are sorted like the index, so a task meets few parts; it searches the list of parts, then the
part's directory, by bisection, reads one block by its range, finds the line in it by bisection, and reads the record's
range of the archive.

Null html is an empty payload, null URLs are the empty key.  Rows with equal keys and URLs are captures of their own, told
apart by place.  Ids are integers, a null id comes before all others.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored, texts

MIN_REVISIT = 1000
BLOCK_LINES = 1000
PART_LINES = 50_000  # captures of one part of the index
NO_ID = -(2**63)
CAPTURE = "urlkey string, page_id bigint, url string, kind string, refers_to bigint, file string, offset bigint, length bigint"
PART = "first string, blocks string, directory string"


def url_key(url: str | None) -> str:
    """Host names reversed, lower case, without ``www`` and default port; then path and query."""
    if not url:
        return ")"
    try:
        part = urlsplit(url if "//" in url else f"//{url}")
        host, port = (part.hostname or "").lower(), part.port
    except ValueError:
        return f"){url}"
    names = host.split(".")
    if names[0] == "www":
        names = names[1:]
    shown = f":{port}" if port and (part.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(names)) + shown + ")" + (part.path or "/") + (f"?{part.query}" if part.query else "")


def line_of(urlkey: str, page_id: int | None) -> str:
    """Sorts by URL key, then id; ids as sixteen digits of the shifted number."""
    return f"{json.dumps(urlkey)[1:-1]} {(NO_ID if page_id is None else page_id) + 2**63:016x}"


class Store:
    """Files of the shared folder, on any file system that Arrow knows; each is opened once for reading."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.open: dict[str, object] = {}

    def writer(self, name: str):
        self.system.create_dir(self.base, recursive=True)
        return self.system.open_output_stream(f"{self.base}/{name}", compression=None)

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.base}/{name}")
        self.open[name].seek(offset)
        return self.open[name].read(length)

    def whole(self, name: str) -> bytes:
        with self.system.open_input_file(f"{self.base}/{name}") as f:
            return f.read()


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, n_bytes: int) -> bytes:
    """One WARC/1.1 record with the HTTP answer it stands for; a revisit has the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzipped record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _write(folder: str):
    def run(batches):
        import pyarrow as pa

        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("page_id", "url", "digest", "kind", "refers_to", "n_bytes")}
            rows = []
            for i, payload in enumerate(texts(batch.column("html"))):
                if out is None:
                    out = Store(folder).writer(name)
                data = record(col["page_id"][i], col["url"][i], payload, col["digest"][i], col["kind"][i], col["refers_to"][i], col["n_bytes"][i])
                out.write(data)
                rows.append((url_key(col["url"][i]), col["page_id"][i], col["url"][i], col["kind"][i], col["refers_to"][i], name, at, len(data)))
                at += len(data)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], [f.split()[0] for f in CAPTURE.split(", ")])
        if out is not None:
            out.close()

    return run


def _index(folder: str):
    def run(batches):
        import pyarrow as pa

        name, out, at, lines, directory = uuid.uuid4().hex, None, 0, [], []

        def close():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 3)
            out.write(data)
            directory.append((lines[0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = Store(folder).writer(f"{name}.blocks")
                lines.append("\t".join([row[0], json.dumps(row[1:])]))
                if len(lines) == BLOCK_LINES:
                    close()
        if out is not None:
            if lines:
                close()
            out.close()
            with Store(folder).writer(f"{name}.directory") as f:
                f.write(json.dumps(directory).encode())
        first = [directory[0][0].split("\t")[0]] if directory else []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (first, [f"{name}.blocks"] * len(first), [f"{name}.directory"] * len(first))], ["first", "blocks", "directory"])

    return run


class Index:
    """The two levels, for one task."""

    def __init__(self, folder: str, parts: list[tuple[str, str, str]]):
        self.store, self.parts = Store(folder), parts
        self.firsts = [p[0] for p in parts]
        self.directories: dict[int, tuple] = {}
        self.blocks: dict[tuple, list[str]] = {}

    def _block(self, part: int, number: int) -> list[str]:
        if (part, number) not in self.blocks:
            if len(self.blocks) >= 8:
                self.blocks.pop(next(iter(self.blocks)))
            _, at, n = self.directories[part][1][number]
            self.blocks[part, number] = zlib.decompress(self.store.range(self.parts[part][1], at, n)).decode().split("\n")
        return self.blocks[part, number]

    def find(self, line: str) -> list[list]:
        """Captures whose line begins with ``line`` (of one URL key and id)."""
        part = max(0, bisect_right(self.firsts, line) - 1)
        while part > 0 and self.firsts[part] == line:  # equal lines may begin in the part before
            part -= 1
        found, number = [], None
        while part < len(self.parts) and self.firsts[part] <= line:
            if part not in self.directories:
                if len(self.directories) >= 8:
                    self.directories.pop(next(iter(self.directories)))
                entries = json.loads(self.store.whole(self.parts[part][2]))
                self.directories[part] = [e[0].split("\t")[0] for e in entries], entries
            heads = self.directories[part][0]
            number = max(0, bisect_right(heads, line) - 1)
            while number > 0 and heads[number] == line:
                number -= 1
            while number < len(heads) and heads[number] <= line:
                block = self._block(part, number)
                k = bisect_right(block, line)
                while k < len(block) and block[k].startswith(line + "\t"):
                    found.append(json.loads(block[k].split("\t", 1)[1]))
                    k += 1
                number += 1
            part += 1
        return found


def written(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", *, min_revisit: int = MIN_REVISIT) -> tuple[str, DataFrame, DataFrame]:
    """Write archives and index: the folder, the table of captures and the list of the index's parts."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder
    folder = folder.replace("file:////", "file:///")
    narrow = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = narrow.count()
    heads = stored(narrow.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("bigint").alias("n_bytes")).distinct(), "heads")
    keepers = heads.where(F.col("n_bytes") >= min_revisit).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    keepers = stored(keepers.where("n > 1").select("digest", "n_bytes", "keeper"), "keepers")
    plan = heads.join(keepers, ["digest", "n_bytes"], "left").select(
        F.col("page_id").alias("__id"), F.col("digest"), F.col("n_bytes"), F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))
    plan = plan.withColumn("kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    both = narrow.withColumn("__digest", F.sha1("html")).join(plan, narrow["page_id"].eqNullSafe(plan["__id"]) & (F.col("__digest") == F.col("digest")))
    both = both.select("page_id", "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "digest", "kind", "refers_to", "n_bytes")
    # a task of the join writes a file: the pages are shuffled once
    captures = stored(both.mapInArrow(_write(folder), CAPTURE), "captures")
    line = F.udf(line_of, "string")
    lines = captures.withColumn("line", line("urlkey", "page_id"))
    order = lines.select("line", "page_id", "url", "kind", "refers_to", "file", "offset", "length")
    parts = order.repartitionByRange(max(1, rows // PART_LINES), "line", "file", "offset").sortWithinPartitions("line", "file", "offset").mapInArrow(_index(folder), PART)
    return folder, captures, stored(parts, "index-parts")


def fetched(folder: str, parts: DataFrame, wanted: DataFrame, url: str = "url", id: str = "page_id") -> DataFrame:
    """For each distinct (url, id) of ``wanted``: the records of its captures, found by the index and read from the archives."""
    spark = wanted.sparkSession
    # one row for each task that sorted the index, not for its lines
    listed = spark.sparkContext.broadcast(sorted(tuple(r) for r in parts.toLocalIterator()))

    @F.udf("string")
    def line(url, page_id):
        return line_of(url_key(url), page_id)

    def run(batches):
        import pyarrow as pa

        index = Index(folder, listed.value)
        for batch in batches:
            rows = []
            for wanted in batch.column(0).to_pylist():
                for page_id, address, kind, refers_to, file, offset, length in index.find(wanted):
                    warc, http, payload = parsed(index.store.range(file, offset, length))
                    digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = warc["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                    refers = int(warc["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">")) if kind == "revisit" else None
                    own = warc["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    rows.append((int(own) if own else None, address, payload if kind == "response" else None, int(http["Content-Length"]), digest, kind, refers))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    lines = wanted.select(line(F.col(url).cast("string"), F.col(id).cast("bigint")).alias("line")).distinct()
    tasks = max(len(listed.value), spark.sparkContext.defaultParallelism)
    return lines.repartitionByRange(tasks, "line").sortWithinPartitions("line").mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
