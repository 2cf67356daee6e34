"""WARC archives with a two-level capture index.

One gzip member holds one record. Of records with equal payloads (of at least ``min_bytes``) the one with the largest
id is a response and the others are revisits that name it; shorter payloads are always responses. A revisit keeps the
HTTP header, with the full payload's length, and the payload's digest.

Each archive begins with a warcinfo record. The index has one line for each record, sorted by its key: the URL with the
host's labels reversed, then the id. Lines go into compressed blocks, each index file ends with a sparse directory of its blocks' first keys, and the manifest
lists the files' first keys. A look-up searches the manifest, then one directory, then one block by bisection, and
reads the record's own bytes.

``round_trip`` reads every record that way: files of the index are dealt out to tasks, each walks its directory and
blocks in order and reads the ranges found there; ``look_up`` does it for a table of URLs, in executors.

Null html counts as empty; null URLs as ``urn:page:<id>``. Repeated rows are written each, under record ids of their own;
they revisit one of them. Rows without an id stay without one, ties of ids go to the larger URL. An empty table gives no
file. Very long pages are one record like any other. Only the three columns that are named are looked at. Files appear
on shared storage under names of one attempt alone and are read only through the manifests of attempts that succeeded.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.common import filesystem, fresh_path, release, slices, spread_join, staged

#: Bytes after which a new archive or index file begins, index lines in a block, records handed on at once.
ARCHIVE_BYTES, INDEX_BYTES = 256 << 20, 64 << 20
BLOCK_LINES, HANDED = 1000, 5000
#: Blocks of the index, and so records, that one task reads back.
TASK_BLOCKS = 4
_BLANK = "00000000-0000-0000-0000-000000000000"
_BREAKS = re.compile(r"[\r\n]+")


def url_key(url: str) -> str:
    """``https://a.b.org/x?y`` as ``org,b,a)/x?y``; what has no host stays as it is."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url
    host = re.match(r"[^/?#]*", rest).group()
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]


def _record(record_id: str, url: str, payload: bytes, digest: str, role: str, page_id, refers_to, refers_id) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if role == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {role}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Target-URI: {_BREAKS.sub(' ', url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if role == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{refers_id}>"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    text = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(text + block + b"\r\n\r\n", 6, mtime=0)


def _info(name: str) -> bytes:
    """The warcinfo record at the head of an archive."""
    body = b"software: fluxweave\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.UUID(_BLANK), name)}>", f"WARC-Filename: {name}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """One record: id, url, type, digest (as named in the header), length of the full payload, payload, refers_to."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "digest": fields["WARC-Payload-Digest"].partition(":")[2],
        "payload_bytes": length,
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "refers_to": number("X-Refers-To-Page-ID"),
    }


def roles(prints: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``prints`` (row, id, url, sha1, size) with ``top``, the record that equal payloads name: struct (id, url, row).

    Tops come from partially aggregated sums and go back by ``spread_join``, so a payload that very many pages share is
    dealt over all tasks.
    """
    keyed = prints.where(F.col("size") >= min_bytes).withColumn("key", F.struct("sha1", "size"))
    first = keyed.groupBy("key").agg(F.max(F.struct("id", "url", "row")).alias("top"), F.count("*").alias("n")).where("n > 1")
    return spread_join(keyed.select("row", "key"), first, "key", "n", prints.count()).select("row", "top")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives below ``folder``; the captures have one row a record: key, id, uri, offset, length.

    Pages are told apart by a row number that is fixed by a written table of ids, URLs and digests; the pages themselves
    are read where they lie and meet their roles by one shuffle.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.concat(F.lit("urn:page:"), F.col(id_col).cast("string")), F.lit("urn:page")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    # Equal rows are interchangeable: each distinct one is counted, and its copies are written together.
    prints = rows.select("id", "url", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("size")).groupBy("id", "url", "sha1", "size").agg(F.count("*").alias("copies"))
    prints = staged(prints.withColumn("row", F.sha2(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), "sha1", "url"), 256)), "prints")
    marked = prints.join(roles(_each(prints), min_bytes).distinct(), "row", "left").select("row", "sha1", "copies", "top")
    keyed = rows.withColumn("row", F.sha2(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.sha1("html"), "url"), 256))
    ready = keyed.dropDuplicates(["row"]) if not prints.where("copies > 1").isEmpty() else keyed
    ready = ready.join(marked, "row").select("row", "id", "url", "html", "sha1", "copies", "top.id", "top.row").toDF("row", "id", "url", "html", "sha1", "copies", "top_id", "top_row")

    def run(batches):
        files, path = filesystem(folder)
        part = TaskContext.get().partitionId()
        sink, uri, at, out = None, "", 0, []

        def handed():
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "id", "uri", "offset", "length"])

        def name_of(row: str, copy: int) -> str:
            return str(uuid.uuid5(uuid.UUID(_BLANK), f"{row} {copy}"))

        try:
            for batch in slices(batches):
                for row, page_id, url, html, sha1, copies, top_id, top_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, digest = html.encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(sha1)).decode()
                    for copy in range(copies):
                        if sink is None or at >= ARCHIVE_BYTES:
                            if sink:
                                sink.close()
                            files.create_dir(path, recursive=True)
                            name = f"{part:08d}-{uuid.uuid4().hex}.warc.gz"
                            sink, uri = files.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"
                            info = _info(name)
                            sink.write(info)
                            at = len(info)
                        role = "response" if top_row is None or top_row == row and copy == 0 else "revisit"
                        member = _record(name_of(row, copy), url, payload, digest, role, page_id, top_id, top_row and name_of(top_row, 0))
                        sink.write(member)
                        out.append((url_key(url), page_id, uri, at, len(member)))
                        at += len(member)
                        if len(out) >= HANDED:
                            yield handed()
            yield handed()
        finally:
            if sink:
                sink.close()

    return staged(ready.mapInArrow(run, "key string, id long, uri string, offset long, length long"), "captures")


def _each(prints: DataFrame) -> DataFrame:
    """Distinct rows that are there more than once count as two records: the one that is named and the others."""
    return prints.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(2)).cast("int")))).drop("copy")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Index files in key order below ``folder``; the manifest has one row a file: first_key, uri, place, length, blocks."""
    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "uri", "offset")

    def run(batches):
        files, path = filesystem(folder)
        sink, uri, at, lines, blocks = None, "", 0, [], []

        def flush():
            nonlocal at, lines, sink, uri
            if sink is None:
                files.create_dir(path, recursive=True)
                name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.cdx"
                sink, uri, at = files.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}", 0
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            sink.write(data)
            blocks.append([lines[0][0], at, len(data)])
            at, lines = at + len(data), []

        def close():
            nonlocal sink, blocks
            directory = zlib.compress(json.dumps(blocks).encode())
            sink.write(directory)
            sink.close()
            row = [[blocks[0][0]], [uri], [at], [len(directory)], [len(blocks)]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            sink, blocks = None, []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["first_key", "uri", "place", "length", "blocks"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(list(row))
                if len(lines) == BLOCK_LINES:
                    flush()
                    if at >= INDEX_BYTES:
                        yield close()
        if lines:
            flush()
        if sink:
            yield close()

    return staged(ordered.mapInArrow(run, "first_key string, uri string, place long, length long, blocks int"), "index")


def read_range(uri: str, at: int, size: int) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_file(path) as source:
        return source.read_at(size, at)


class _Sources:
    """Open files by URI; a few stay open at a time."""

    def __init__(self, most: int = 64):
        self.held, self.most = {}, most

    def read(self, uri: str, at: int, size: int) -> bytes:
        if uri not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).close()
            files, path = filesystem(uri)
            self.held[uri] = files.open_input_file(path)
        return self.held[uri].read_at(size, at)

    def close(self) -> None:
        for source in self.held.values():
            source.close()
        self.held.clear()


def directory(read, uri: str, place: int, length: int) -> list[list]:
    """The sparse directory of an index file: first key, place and length of each block."""
    return json.loads(zlib.decompress(read(uri, place, length)))


def block_lines(read, uri: str, place: int, length: int) -> list[list]:
    """The lines (key, id, archive, offset, length) of one block."""
    return [json.loads(x) for x in zlib.decompress(read(uri, place, length)).decode().split("\n")]


class CaptureIndex:
    """Look-ups by URL over the files (first_key, uri, place, length) of an index."""

    def __init__(self, files: list[tuple], read=read_range):
        self.files, self.read = sorted(files), read
        self.keys = [f[0] for f in self.files]
        self.directories: dict[str, list[list]] = {}

    def captures(self, url: str) -> list[list]:
        """The index lines of a URL, in id order: manifest, one directory, one block (more where a key goes on)."""
        key, found = url_key(url), []
        at = max(0, bisect.bisect_left(self.keys, key) - 1)
        while at < len(self.files) and self.keys[at] <= key:
            _, uri, place, length = self.files[at]
            if uri not in self.directories:
                if len(self.directories) >= 256:
                    self.directories.clear()
                self.directories[uri] = directory(self.read, uri, place, length)
            blocks = self.directories[uri]
            first = max(0, bisect.bisect_left([b[0] for b in blocks], key) - 1)
            for first_key, start, size in blocks[first:]:
                if first_key > key:
                    break
                lines = block_lines(self.read, uri, start, size)
                names = [x[0] for x in lines]
                found += lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
            at += 1
        return found

    def find(self, url: str) -> list[dict]:
        """All records of a URL, in id order."""
        return [parse(self.read(uri, start, size)) for _, _, uri, start, size in self.captures(url)]


_FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _columns(records) -> pa.RecordBatch:
    """A response's digest and length are taken from the payload that was read, a revisit's from its header."""
    out = []
    for r in records:
        if r["payload"] is not None:
            r["payload_bytes"], r["digest"] = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
        out.append((r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]))
    cols = list(zip(*out, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(index: DataFrame) -> DataFrame:
    """Every record of the archives through their index: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to. A task takes TASK_BLOCKS blocks of a file: its directory tells where they lie, each block where its
    records do, and these are read by their ranges, in the order in which they lie in the archives."""

    def run(batches):
        sources = _Sources()
        try:
            for batch in batches:
                for uri, place, length, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for _, start, size in directory(sources.read, uri, place, length)[first : first + TASK_BLOCKS]:
                        lines = block_lines(sources.read, uri, start, size)
                        lines.sort(key=lambda x: (x[2], x[3]))
                        for at in range(0, len(lines), 200):
                            yield _columns(parse(sources.read(archive, offset, size_)) for _, _, archive, offset, size_ in lines[at : at + 200])
        finally:
            sources.close()
            release()

    dealt = index.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(TASK_BLOCKS)))).select("uri", "place", "length", "first")
    tasks = max(1, dealt.count())
    return dealt.repartition(tasks, "uri", "first").mapInArrow(run, _FOUND)


def look_up(urls: DataFrame, index: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of each distinct URL of a table, searched in executors; only the list of index files goes to each."""
    files = [tuple(r) for r in index.select("first_key", "uri", "place", "length").collect()]  # one row for 64 MB of index

    def run(batches):
        sources = _Sources()
        try:
            held = CaptureIndex(files, sources.read)
            for batch in slices(batches):
                for url in batch.column(0).to_pylist():
                    yield _columns(held.find(url))
        finally:
            sources.close()
            release()

    distinct = urls.select(F.col(url_col).cast("string").alias("url")).where("url is not null").distinct()
    return distinct.mapInArrow(run, _FOUND)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives and their index, then read every record back through the index."""
    spark = pages.sparkSession
    captures = write(pages, fresh_path(spark, "warc"), min_bytes)
    return read(build_index(captures, fresh_path(spark, "cdx")))
