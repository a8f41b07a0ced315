"""WARC archives of pages: one gzip member a record, equal payloads stored once, a two-level capture index beside them.

The index holds a line for each record, sorted by the URL with its host reversed, in shards. A shard is a file of
compressed blocks of lines; its end holds a sparse directory with the first and last key of each block. A search reads
directories, finds blocks in them by bisection, and reads only those blocks and then only the records they name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.copies import numbered_copies
from firnline.llm.storage import Scratch
from firnline.llm.textblocks import whole_bytes

#: Bytes after which a task starts a new archive, lines of an index block, lines of a shard, most shards.
ARCHIVE_BYTES, BLOCK_LINES, SHARD_LINES, MOST_SHARDS = 1 << 30, 1024, 1 << 20, 4096
#: Records closer together than this are read at once, up to so many bytes; bytes of records that a task reads.
GAP, READ_BYTES, TASK_BYTES = 1 << 15, 4 << 20, 64 << 20
#: Pages have no time of capture; the archives say this one.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TAIL = "<QI4s"
MARK = b"FCI1"


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed, then path and query; a null URL has the key of an empty one.

    Scheme, user, port and fragment are left out, the host is lower-cased, control characters go and blanks become %20.
    """
    clean = F.replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1f\x7f]", ""), F.lit(" "), F.lit("%20"))
    bare = F.regexp_replace(F.regexp_replace(clean, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^.*@", ""), ":[0-9]*$", ""))
    labels = F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.concat(labels, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _place(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(*parts) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts)).urn}>"


def _uri(url: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _head(name: str, fields: list[tuple[str, object]]) -> bytes:
    return (name + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(kind: str, row: dict, payload: bytes, unique: str) -> bytes:
    """One record as a gzip member; a revisit has the HTTP head of its payload but not the payload."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", row["size"])])
    response, revisit = row["ref_uri"] if kind == "revisit" else row["url"], kind == "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(kind, row["page_id"], row["url"], row["sha1"], unique if revisit else "")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if row["url"] is None else _uri(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{_base32(row['sha1'])}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id("response", row["ref_page"], response, row["sha1"], "") if revisit else None),
        ("WARC-Refers-To-Target-URI", _uri(response) if revisit and response is not None else None),
        ("WARC-Refers-To-Date", DATE if revisit else None),
        ("X-Page-Id", row["page_id"]),
        ("X-Refers-To-Page-Id", row["ref_page"] if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (0 if revisit else len(payload))),
    ]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    parts = [pack.compress(_head("WARC/1.1", fields) + http), b"" if revisit else pack.compress(payload), pack.compress(b"\r\n\r\n"), pack.flush()]
    return b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parsed(member: bytes) -> dict:
    """url, page_id, payload (None in a revisit), payload_bytes, payload_digest, record_type, refers_to; a damaged record is an error."""
    unpack = zlib.decompressobj(31)
    raw = unpack.decompress(member)
    if not unpack.eof or unpack.unused_data or not raw.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a whole record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{f['WARC-Record-ID']}: wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(_fields(http)["Content-Length"])
    if f["WARC-Type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"{f['WARC-Record-ID']}: the payload is not the one that was written")
    else:
        payload = None
    whole = {k: None if v is None else int(v) for k, v in (("page_id", f.get("X-Page-Id")), ("refers_to", f.get("X-Refers-To-Page-Id")))}
    return whole | {"url": f.get("WARC-Target-URI"), "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": f["WARC-Type"]}


ENTRY = "key string, page_id long, file string, at long, length long"


def _arrow(names: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])


ROW = ["key", "page_id", "url", "html", "size", "sha1", "kind", "ref_page", "ref_uri"]


def _rows(pages: DataFrame, scratch: Scratch, least_bytes: int) -> DataFrame:
    """``ROW`` of every page: kind is response or revisit; the html of a revisit is null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumns({"size": F.octet_length("html").cast("long"), "sha": F.unhex(F.sha2("html", 256))})
    same = base.where(F.col("size") >= least_bytes).groupBy("sha", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    same = same.groupBy("sha", "size").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "url", "n")).alias("best")).where("n > 1")
    # the html of repeated payloads is read by Spark from the pages again; this table has only their digests
    groups = scratch.put(same.select("sha", F.col("size").alias("of"), F.col("best.page_id").alias("ref_page"), F.col("best.url").alias("ref_uri"), F.col("best.n").alias("twins")), "groups")
    joined = base.join(groups, "sha", "left").withColumns({"sha1": F.sha1("html"), "key": url_key(F.col("url"))})
    is_best = F.col("page_id").eqNullSafe(F.col("ref_page")) & F.col("url").eqNullSafe(F.col("ref_uri"))
    plain = F.col("twins").isNull() | is_best
    out = joined.where(~(F.coalesce("twins", F.lit(1)) > 1) | ~is_best).withColumn("kind", F.when(plain, "response").otherwise("revisit"))
    if groups.where("twins > 1").isEmpty():
        return out.withColumn("html", F.when(F.col("kind") == "response", F.col("html"))).select(ROW)
    # rows equal in page_id, url and payload: one is the response, the rest revisit it
    best = joined.where((F.col("twins") > 1) & is_best).groupBy("key", "page_id", "url", "size", "sha1", "ref_page", "ref_uri", "twins").agg(F.max("html").alias("html"))
    best = scratch.put(best, "twins")
    more = numbered_copies(best.drop("html").withColumn("more", F.col("twins") - 1), "more", "_number").select(*(F.lit(None).cast("string").alias("html") if c == "html" else F.lit("revisit").alias("kind") if c == "kind" else c for c in ROW))
    first = best.withColumn("kind", F.lit("response")).select(ROW)
    return out.withColumn("html", F.when(F.col("kind") == "response", F.col("html"))).select(ROW).unionByName(first).unionByName(more)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of page_id, url, html; returns key, page_id, file, at and length of each.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest page_id (null least, then by url) is
    the response and the others revisit it; payloads are equal if their SHA-256 is. A null html is an empty payload, a
    null url has no target, a null page_id no number; repeated rows have a record each; a page of any length is one
    record; other columns are not read. No pages make no archives. Every attempt of a task writes files of its own
    names; a file counts if the returned rows name it.
    """

    def run(batches):
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ROW if c != "html"]
                data, offsets = whole_bytes(batch.column("html"))
                found = []
                for i, values in enumerate(zip(*columns, strict=True)):
                    row = dict(zip((c for c in ROW if c != "html"), values, strict=True))
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(row["kind"], row, data[offsets[i] : offsets[i + 1]].tobytes(), f"{name}:{at}")
                    out.write(member)
                    found.append({"key": row["key"], "page_id": row["page_id"], "file": name, "at": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(found, _arrow(ENTRY))
        finally:
            if out is not None:
                out.close()

    return scratch.put(_rows(pages, scratch, least_bytes).mapInArrow(run, ENTRY), "entries")


SHARD = "path string, low string, high string, lines long"


def _bytes(key: str) -> bytes:
    return key.encode()


def build_index(entries: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Sorts the entries by key, page_id and place into shards of compressed blocks; returns path, low, high and lines of each."""

    def run(batches):
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        path, out, at, held, directory, lines = f"{base}/{uuid.uuid4().hex}.cdx", None, 0, [], [], 0

        def flush():
            nonlocal at, held
            packed = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in line) for line in held).encode(), 6)
            out.write(packed)
            directory.append([held[0][0], held[-1][0], at, len(packed)])
            at, held = at + len(packed), []

        for batch in batches:
            if batch.num_rows and out is None:
                out = fs.open_output_stream(path, compression=None)
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(line)
                lines += 1
                if len(held) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if held:
            flush()
        packed = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(packed + struct.pack(TAIL, at, len(packed), MARK))
        out.close()
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path.rsplit('/', 1)[1]}", "low": directory[0][0], "high": directory[-1][1], "lines": lines}], _arrow(SHARD))

    keys = ["key", "page_id", "file", "at"]
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // SHARD_LINES)
    ordered = entries.repartitionByRange(min(n, MOST_SHARDS), *keys).sortWithinPartitions(*keys).select(*keys, "length")
    return scratch.put(ordered.mapInArrow(run, SHARD), "shards")


class _Files:
    """A few files kept open for reads of ranges."""

    def __init__(self, most: int = 16):
        self.most, self.open = most, OrderedDict()

    def read(self, uri: str, at: int, length: int) -> bytes:
        source = self.open.pop(uri, None)
        if source is None:
            fs, path = _place(uri)
            source = fs.open_input_file(path)
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
        self.open[uri] = source
        out = source.read_at(length, at)
        if len(out) != length:
            raise ValueError(f"{uri} is cut short")
        return out

    def size(self, uri: str) -> int:
        self.read(uri, 0, 0)
        return self.open[uri].size()


def directory_of(files: _Files, uri: str) -> tuple[list[bytes], list[tuple[bytes, int, int]]]:
    """Last key of each block of a shard, and its first key, place and length."""
    at, length, mark = struct.unpack(TAIL, files.read(uri, files.size(uri) - struct.calcsize(TAIL), struct.calcsize(TAIL)))
    if mark != MARK:
        raise ValueError(f"{uri} is not an index shard")
    rows = json.loads(zlib.decompress(files.read(uri, at, length)))
    return [_bytes(r[1]) for r in rows], [(_bytes(r[0]), r[2], r[3]) for r in rows]


BLOCK = "path string, at long, length int, low string, high string"


def _blocks_of(shards: list[tuple[str, bytes, bytes]]):
    """For ranges of keys the index blocks that may hold lines of them, by bisection in the shards and in their directories."""
    tops = [high for _, _, high in shards]

    def run(batches):
        files, known = _Files(), OrderedDict()
        for batch in batches:
            found = []
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = _bytes(low), _bytes(high)
                for k in range(bisect_left(tops, a), len(shards)):
                    path, first, _ = shards[k]
                    if first > b:
                        break
                    if path not in known:
                        if len(known) >= 8:
                            known.popitem(last=False)
                        known[path] = directory_of(files, path)
                    last, blocks = known[path]
                    for i in range(bisect_left(last, a), len(blocks)):
                        if blocks[i][0] > b:
                            break
                        found.append({"path": path, "at": blocks[i][1], "length": blocks[i][2], "low": low, "high": high})
                        if len(found) == 8192:
                            yield pa.RecordBatch.from_pylist(found, _arrow(BLOCK))
                            found = []
            yield pa.RecordBatch.from_pylist(found, _arrow(BLOCK))

    return run


def _lines_of(batches):
    """The lines of index blocks that lie in the wanted ranges; rows are sorted by block, and a block is read once."""
    files, at, keys, lines = _Files(), None, [], []
    for batch in batches:
        found = []
        for path, place, length, low, high in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if at != (path, place):
                at = path, place
                lines = [line.split("\t") for line in zlib.decompress(files.read(path, place, length)).decode().split("\n")]
                keys = [_bytes(line[0]) for line in lines]
            b = _bytes(high)
            for i in range(bisect_left(keys, _bytes(low)), len(keys)):
                if keys[i] > b:
                    break
                key, page, file, start, size = lines[i]
                found.append({"key": key, "page_id": int(page) if page else None, "file": file, "at": int(start), "length": int(size)})
                if len(found) == 8192:
                    yield pa.RecordBatch.from_pylist(found, _arrow(ENTRY))
                    found = []
        yield pa.RecordBatch.from_pylist(found, _arrow(ENTRY))


def find(shards: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries whose key lies in a range (columns low and high, both included, by bytes); overlapping ranges find an entry once each.

    One row for each shard, ``MOST_SHARDS`` at most, goes to the tasks; directories and blocks are read where they are
    needed. Blocks of one range go to different tasks, so a URL with very many captures is split.
    """
    held = sorted((r.path, _bytes(r.low), _bytes(r.high)) for r in shards.collect())
    held.sort(key=lambda s: (s[1], s[2]))
    asked = ranges.select("low", "high").where("low is not null and high is not null")
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since rows are small and what they stand for is not
    blocks = asked.repartitionByRange(tasks, "low").sortWithinPartitions("low").mapInArrow(_blocks_of(held), BLOCK)
    return blocks.repartition(tasks, "path", "at").sortWithinPartitions("path", "at").mapInArrow(_lines_of, ENTRY)


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(entries: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that entries (a stored table, since it is read twice) name, each checked against its digest.

    Neighbours in an archive are read together; tasks have their share of the records' bytes.
    """

    def run(batches):
        files, schema, todo = _Files(), _arrow(RECORD), []

        def records(todo):
            start = todo[0][1]
            raw = memoryview(files.read(f"{folder}/{todo[0][0]}", start, todo[-1][1] + todo[-1][2] - start))
            rows = [parsed(raw[at - start : at - start + length]) for _, at, length in todo]
            return pa.RecordBatch.from_pylist(rows if payloads else [r | {"payload": None} for r in rows], schema)

        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length")), strict=True):
                if todo:
                    file, at, length = todo[-1]
                    if entry[0] != file or entry[1] - at - length > GAP or entry[1] + entry[2] - todo[0][1] > READ_BYTES:
                        yield records(todo)
                        todo = []
                todo.append(entry)
        if todo:
            yield records(todo)

    size = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return entries.select("file", "at", "length").repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives that are written and searched.

    The cases are those of ``write_archives``. Archives and index stay in the shared folder.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    entries = write_archives(pages, scratch.path("archives"), scratch, least_bytes)
    shards = build_index(entries, scratch.path("index"), scratch)
    keys = pages.select(url_key(F.col("url").cast("string")).alias("low")).distinct().withColumn("high", F.col("low"))
    found = scratch.put(find(shards, keys), "found")
    return read_records(found, scratch.path("archives"), payloads=False).drop("url", "payload")
