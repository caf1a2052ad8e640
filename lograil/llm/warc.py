"""WARC archives with a two-level capture index.

Captures are written as gzip members, one for each record, into archives of the shared folder. The index sorts capture
keys (reversed host, then path) into compressed blocks. Each index file ends with its sparse directory, the first and last
key of each block; the table of index files, one row for each task that wrote one, says which keys a file has. A look-up
finds the file and then the block by bisection, opens that block, and reads the record's range of its archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm._common import materialize, scratch_dir

#: Captures of an index block, and the least payload that a revisit stands for.
BLOCK, LEAST = 512, 100
#: Captures that a task of a look-up may find, and bytes of archives that a task reads.
CAPTURES, BYTES = 500_000, 1 << 25


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, port if one is given that is not the scheme's, path and query as they are.

    Scheme, a leading www., user and fragment do not count, so URLs that differ in these alone are one key.
    """
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = "" if parts.port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{parts.port}"
    except ValueError:
        return (url or "") + ")"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no payload; the length of the one it stands for is a field."""
    clean = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if kind == "revisit" else payload
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path


def _page(field: str) -> int | None:
    number = field.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, kind, refers_to: which pages are responses and which revisits.

    Of equal payloads of at least `least` bytes that with the smallest id is the response. Only digests that occur twice
    are joined back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    twice = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("c"), F.min("page_id").alias("first")).where("c > 1").select(F.col("digest").alias("d"), "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(materialize(twice, "twice"), F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write(captures: DataFrame, folder: str) -> DataFrame:
    """Write one archive for each task and return its captures: key, page_id, file, offset, length.

    File names are unique to the attempt and only those of the returned rows count, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                keys, ids, offsets, lengths = [], [], [], []
                for r in batch.to_pylist():
                    data = gzip.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["kind"], r["refers_to"]), 6, mtime=0)
                    out.write(data)
                    keys.append(url_key(r["url"]))
                    ids.append(r["page_id"])
                    offsets.append(offset)
                    lengths.append(len(data))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return materialize(captures.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Write the compressed blocks with their directories; one row for each file: first_key, last_key, file, offset and
    length of its directory, captures.

    Captures are range-partitioned by (key, page_id): the captures of one host or URL spread over as many tasks as they
    need. The rows are as many as the tasks, whatever the number of captures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, offset, out, held, blocks, count = f"{uuid.uuid4().hex}.idx", 0, None, [], [], 0

        def put(data: bytes) -> tuple[int, int]:
            nonlocal offset, out
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data)
            offset += len(data)
            return offset - len(data), len(data)

        def flush(rows: list[dict]) -> None:
            lines = [json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"]], ensure_ascii=False) for r in rows]
            blocks.append([rows[0]["key"], rows[-1]["key"], *put(zlib.compress("\n".join(lines).encode()))])

        try:
            for batch in batches:
                held += batch.to_pylist()
                count += batch.num_rows
                while len(held) >= block:
                    flush(held[:block])
                    held = held[block:]
            if held:
                flush(held)
            if blocks:
                at, length = put(zlib.compress(json.dumps(blocks, ensure_ascii=False).encode()))
        finally:
            if out:
                out.close()
        if blocks:
            cells = [[blocks[0][0]], [blocks[-1][1]], [name], [at], [length], [count]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["first_key", "last_key", "file", "offset", "length", "captures"])

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialize(ordered.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, captures long"), "directory")


def _range(fs: pafs.FileSystem, path: str, offset: int, length: int, held: dict) -> bytes:
    """A range of a file; the last few files stay open."""
    if path not in held:
        if len(held) >= 16:
            held.pop(next(iter(held))).close()
        held[path] = fs.open_input_file(path)
    return held[path].read_at(length, offset)


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """key, page_id, file, offset, length: the captures of each distinct key of a table (column key).

    The rows of the directory, one for each index file, are broadcast, and bisection gives the files that may hold a key. Keys
    are then range-partitioned by file and key, so each task reads the sparse directories of few files, bisects them, and
    opens each block that it needs once. A key with captures in several files is one row for each.
    """
    tops = directory.select("first_key", "last_key", "file", "offset", "length", "captures").toArrow().sort_by([("first_key", "ascending"), ("last_key", "ascending")])
    columns = [tops.column(i).to_pylist() for i in range(6)]
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(columns[:5])
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(columns[5]) // CAPTURES))

    def holders(firsts: list[str], lasts: list[str], key: str) -> Iterator[int]:
        at = bisect.bisect_right(firsts, key) - 1
        while at >= 0 and lasts[at] >= key:
            yield at
            at -= 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, *rest = shared.value
        for batch in batches:
            found = [(key, at) for key in batch.column(0).to_pylist() for at in holders(firsts, lasts, key)]
            cells = [pa.array([k for k, _ in found], pa.string()), *[pa.array([c[at] for _, at in found], t) for c, t in zip(rest, (pa.string(), pa.int64(), pa.int64()), strict=True)]]
            yield pa.RecordBatch.from_arrays(cells, names=["key", "file", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), held = _open(folder), {}
        name, firsts, lasts, spans = None, [], [], []
        opened, block, out = None, {}, []

        def rows() -> pa.RecordBatch:
            cells = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cells, names=["key", "page_id", "file", "offset", "length"])

        for batch in batches:
            for key, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file != name:
                    name = file
                    blocks = json.loads(zlib.decompress(_range(fs, f"{root}/{file}", offset, length, held)))
                    firsts, lasts, spans = [b[0] for b in blocks], [b[1] for b in blocks], [b[2:] for b in blocks]
                for at in holders(firsts, lasts, key):
                    if opened != (file, at):
                        opened, block = (file, at), {}
                        for line in zlib.decompress(_range(fs, f"{root}/{file}", *spans[at], held)).decode().split("\n"):
                            r = json.loads(line)
                            block.setdefault(r[0], []).append(r)
                    out += block.get(key, [])
                    if len(out) >= 8192:
                        yield rows()
        yield rows()

    routed = materialize(keys.select("key").distinct().mapInArrow(route, "key string, file string, offset long, length long"), "routed")
    placed = routed.repartitionByRange(tasks, "file", "key").sortWithinPartitions("file", "key")
    return placed.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def keyed(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """url, key: the sort key of each URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["url", "key"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "url string, key string")


def read(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read captures (file, offset, length) back from the archives; the digest is that of the payload as read.

    Captures are range-partitioned by place in the archives, so each task reads forward. page_id, payload_bytes,
    payload_digest, record_type, refers_to, and payload (null for revisits) if with_payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), held = _open(folder), {}
        for batch in batches:
            cells: list[list] = [[], [], [], [], [], []]
            for c in batch.to_pylist():
                fields, body = parse(gzip.decompress(_range(fs, f"{root}/{c['file']}", c["offset"], c["length"], held)))
                kind = fields["WARC-Type"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(body).hexdigest()
                size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(body)
                row = [_page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, body.decode() if with_payload and kind == "response" else None]
                for cell, x in zip(cells, row, strict=True):
                    cell.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)][: 5 + with_payload], names=names[: 5 + with_payload])

    total = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, -(-total // BYTES))  # by what is read, not by the pointers
    placed = captures.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload)


def find(urls: DataFrame, directory: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """url, page_id, file, offset, length of the captures of each distinct URL of a table; null URLs have none."""
    asked = materialize(keyed(urls.where(F.col(url_col).isNotNull()), url_col).distinct(), "asked")
    return asked.join(lookup(asked, directory, folder), "key").drop("key")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC records, index them, look up the key of every page, and read the captures found back.

    One row for each row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty
    payload; null URLs and ids are written empty and read back null; rows that repeat the smallest id of a payload are all
    responses; of equal payloads without any id all are responses; other columns are not read; an empty table gives no
    rows. White space inside a URL is folded in its header.
    """
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    directory = index(write(typed(pages, id_col, url_col, html_col), folder), folder)
    return read(materialize(lookup(keyed(pages, url_col), directory, folder), "found"), folder)
