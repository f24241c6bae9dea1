"""WARC archives of pages: payloads travel as chunks, whatever their length, and so they come back."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import _WRITTEN, doc_column, join_counted, materialise, shared_folder, small_batches, tidily

#: Bytes of a chunk; tasks hold a few of them, never a whole payload.
CHUNK = 1 << 20
#: Payloads from this size on are written once, their repeats as revisits.
REVISIT_FROM = 100
#: Uncompressed bytes of an archive, and of the stretch of one that a task reads back.
ARCHIVE_BYTES, STRETCH_BYTES = 256_000_000, 32_000_000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(rb"[^\x21-\x7E]")


def with_row(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, html): ``row`` tells rows apart, alike whenever the table is read.

    It is the page_id where no two rows share one; else rows get numbers in a written copy.
    """
    rows = pages.select(doc_column(pages, "page_id", "long").alias("page_id"), doc_column(pages, "url", "string").alias("url"), doc_column(pages, "html", "string").alias("html"))
    ids = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("held")).where("held > 1 or page_id is null")
    if ids.isEmpty():
        return rows.select(F.col("page_id").alias("row"), "page_id", "url", "html")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-pages").select("row", "page_id", "url", "html")


def chunked(rows: DataFrame, *names: str, size: int = CHUNK) -> DataFrame:
    """(``names``, chunk, data, last): the bytes of ``html`` in pieces of ``size``, in order; a null or empty text has one empty piece."""
    as_bytes = rows.select(*names, F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_bytes"))
    pieces = F.greatest(F.ceil(F.octet_length("_bytes") / size), F.lit(1)).cast("int")
    cut = as_bytes.select(*names, "_bytes", pieces.alias("_pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk"))
    data = F.when(F.col("_pieces") == 1, F.col("_bytes")).otherwise(F.substring("_bytes", F.col("chunk") * size + 1, F.lit(size)))
    return cut.select(*names, "chunk", data.alias("data"), (F.col("chunk") == F.col("_pieces") - 1).alias("last"))


def records(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(row, page_id, payload_bytes, payload_digest): a digest grows from chunk to chunk, which follow each other in their task."""
    fields = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def digested(batches):
        digest, size = hashlib.sha256(), 0
        for batch in batches:
            out = []
            for row, page, data, last in zip(*(batch.column(c) for c in ("row", "page_id", "data", "last")), strict=True):
                view = memoryview(data.as_buffer())
                digest.update(view)
                size += len(view)
                if last.as_py():
                    out.append((row.as_py(), page.as_py(), size, digest.hexdigest()))
                    digest, size = hashlib.sha256(), 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return chunked(rows, "row", "page_id", size=size).mapInArrow(tidily(digested), "row long, page_id long, payload_bytes long, payload_digest string")


def decided(found: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``found`` with record_type, refers_to and refers_row: of equal payloads the least page_id, null last, is the response."""
    same = ["payload_digest", "payload_bytes"]
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    heads = found.where(F.col("payload_bytes") >= least).groupBy(*same).agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("held")).where("held > 1")
    heads = materialise(heads.select(*same, F.col("head.page_id").alias("refers_to"), F.col("head.row").alias("refers_row"), "held"), "repeated-payloads")
    if heads.isEmpty():
        return found.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "refers_row": F.lit(None).cast("long")})
    repeated = join_counted(found, heads, same, "held", found.count()).where("row != refers_row").select("row", "refers_to", "refers_row")
    out = found.join(repeated, "row", "left")
    return out.withColumn("record_type", F.when(F.col("refers_row").isNull(), F.lit("response")).otherwise(F.lit("revisit")))


def record_id(page: int | None, row: int) -> str:
    """``null`` stands for a missing page_id; the row tells records of one page_id apart."""
    return f"<urn:lodestream:page:{'null' if page is None else page}:{row}>"


def heading(r: dict, date: str = DATE) -> bytes:
    """What stands before a record's payload: its own fields, then those of the answer that carried it."""
    size = r["payload_bytes"]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    response = r["refers_row"] is None
    lines = [VERSION, f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(r['page_id'], r['row'])}", f"WARC-Date: {date}"]
    if r["url"]:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], r["url"].encode("utf-8", "replace")).decode("ascii"))
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(r['refers_to'], r['refers_row'])}"]
    lines += [f"WARC-Payload-Digest: sha256:{r['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(answer) + size * response}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + answer


def filesystem(uri: str):
    """(file system, path) that an executor opens ``uri`` with."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(spark: SparkSession, rows: DataFrame, found: DataFrame, folder: str | None = None, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, size: int = CHUNK) -> DataFrame:
    """Writes a record for each of ``rows`` and returns the manifest (file, start, stop) of stretches of whole records.

    Archives are gzip files with a member per record, each written by one task from
    sorted chunks. A task that runs again writes a file of a new name; the manifest,
    a written table, names only the files of tasks that Spark took the rows of.
    """
    folder = folder or f"{shared_folder(spark)}/lodestream/warc-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(folder)
    total = found.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = max(spark.sparkContext.defaultParallelism, -(-total // archive_bytes))
    # What is known of a record goes before its chunks, so that payloads are shuffled once and joined with nothing.
    heads = found.select("row", F.lit(-1).alias("chunk"), "page_id", "payload_bytes", "payload_digest", "refers_to", "refers_row")
    placed = chunked(rows, "row", "url", size=size).unionByName(heads, allowMissingColumns=True).repartition(archives, "row").sortWithinPartitions("row", "chunk")
    fields = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    names = ["row", "chunk", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "refers_row", "last"]

    def written(batches):
        out = head = member = None
        name, begin, plain, stretches = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, []
        for batch in batches:
            if out is None:
                system, path = filesystem(folder)
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(filesystem(name)[1], compression=None)
            meta = batch.select(names).to_pylist()
            for r, data in zip(meta, batch.column("data"), strict=True):
                if r["chunk"] < 0:
                    head = r
                    continue
                if r["chunk"] == 0:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(heading(head | {"url": r["url"]}, date)))
                if head["refers_row"] is None:
                    view = memoryview(data.as_buffer())
                    out.write(member.compress(view))
                    plain += len(view)
                if r["last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    if plain >= STRETCH_BYTES:
                        stretches.append((name, begin, out.tell()))
                        begin, plain = out.tell(), 0
        if out is not None:
            if out.tell() > begin:
                stretches.append((name, begin, out.tell()))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stretches, strict=True), fields, strict=True)], schema=fields)

    return materialise(placed.mapInArrow(tidily(written), "file string, start long, stop long"), "warc-manifest")


class Member:
    """The plain bytes of one gzip member after another, some at a time."""

    def __init__(self, stream, left: int):
        self.stream, self.left, self.held = stream, left, b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        """At most some CHUNK bytes; empty at the end of the stretch."""
        while True:
            if self.inflate.eof:
                self.held, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.held:
                self.held = self.stream.read(min(self.left, 1 << 18))
                self.left -= len(self.held)
                if not self.held:
                    return b""
            out = self.inflate.decompress(self.held, CHUNK)
            if not self.inflate.eof:  # at the end what is left is the next member's
                self.held = self.inflate.unconsumed_tail
            if out:
                return out


def parsed(member: Member) -> Iterator[tuple[dict, int, bytes, bool, int, str | None]]:
    """(fields, chunk, data, last, payload bytes so far, digest with the last chunk) of each record, at most CHUNK bytes of payload at a time."""
    held = b""

    def until(mark: bytes) -> bytes | None:
        nonlocal held
        while (at := held.find(mark)) < 0:
            got = member.more()
            if not got:
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return None
            held += got
        found, held = held[:at], held[at + len(mark):]
        return found

    while (head := until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("ascii").split("\r\n")
        if first != VERSION:
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        left = int(fields["Content-Length"])
        answer = until(b"\r\n\r\n")
        left -= len(answer) + 4
        size, chunk, digest = 0, 0, hashlib.sha256()
        if fields["WARC-Type"] == "revisit":
            of = dict(line.split(": ", 1) for line in answer.decode("ascii").split("\r\n")[1:])
            yield fields, 0, b"", True, int(of["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
        else:
            while True:
                if left and not held:
                    held = member.more()
                    if not held:
                        raise ValueError("an archive ends within a record")
                data, held = held[:left], held[left:]
                digest.update(data)
                size, left = size + len(data), left - len(data)
                yield fields, chunk, data, not left, size, None if left else digest.hexdigest()
                chunk += 1
                if not left:
                    break
        if until(b"\r\n\r\n") != b"":
            raise ValueError("a record has no end")


def page_of(identifier: str | None) -> tuple[int | None, int | None]:
    """(page_id, row) of a record id."""
    if identifier is None:
        return None, None
    page, row = identifier.strip("<>").split(":")[-2:]
    return None if page == "null" else int(page), int(row)


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` (file, start, stop) names.

    One row per chunk: page_id, row, url, record_type, refers_to, chunk, data, last,
    payload_bytes (so far) and, with the last chunk, payload_digest, computed from the
    bytes read, or a revisit's as it stands there. Without ``payload`` only last chunks
    come out, without data.
    """
    kinds = [("page_id", pa.int64()), ("row", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema(kinds)

    def read(batches):
        for batch in batches:
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                system, path = filesystem(file)
                out, size = [], 0
                with system.open_input_file(path) as stream:
                    stream.seek(start)
                    for fields, chunk, data, last, so_far, digest in parsed(Member(stream, stop - start)):
                        if not (payload or last):
                            continue
                        page, row = page_of(fields["WARC-Record-ID"])
                        out.append((page, row, fields.get("WARC-Target-URI"), fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))[0], chunk, data if payload else None, last, so_far, digest))
                        size += len(data) if payload else 0
                        if size >= 4 * CHUNK or len(out) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    # A count, so that Spark doesn't join stretches into one task for the few bytes of their names.
    stretches = manifest.repartitionByRange(max(1, manifest.count()), "file", "start")
    return stretches.mapInArrow(tidily(read), "page_id long, row long, url string, record_type string, refers_to long, chunk long, data binary, last boolean, payload_bytes long, payload_digest string")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, date: str = DATE, least: int = REVISIT_FROM, size: int = CHUNK) -> DataFrame:
    """Writes a WARC record for every row of ``pages`` and returns the archives' manifest (file, start, stop).

    The payload is html in UTF-8, null as empty. Of records with equal payloads of
    ``least`` bytes or more the one with the smallest page_id, null last, is a response
    and the others revisit it; among rows of one page_id one of them. Smaller payloads
    are responses all. Repeated rows have a record each; an empty table gives an empty
    manifest; extra columns are ignored. In urls bytes outside of printable ASCII are escaped.
    """
    small_batches(spark, 500, "4m")
    rows = with_row(pages)
    found = materialise(records(rows, size), "payload-digests")
    return write_archives(spark, rows, materialise(decided(found, least), "record-types"), folder, date, size=size)


def digests(chunks: DataFrame) -> DataFrame:
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
