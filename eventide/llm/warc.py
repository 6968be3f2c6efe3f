"""WARC archives: writing, normalising monolithic gzip, and reading through a sidecar offset index.

A writer that compresses a whole archive as one gzip stream makes a file that can only be read from its start.  The
normaliser inflates such a stream once, in pieces, finds the records in it, rewrites every record as a gzip member of its
own, and keeps a row per record in a sidecar index: file, offset, length.  Readers then fetch single records.

Archives lie in the shared folder under names that hold a random part, and only the rows of finished tasks name them, so
a task that runs twice leaves a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: An archive is closed once so much payload went into it.
ARCHIVE_BYTES = 64_000_000
_PIECE = 1 << 16
_END = b"\r\n\r\n"


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit carries no payload, but digest and size of the one it stands for."""
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_one_line(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    headers.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(headers).encode() + _END + payload + _END


def _one_line(url: str | None) -> str:
    return "".join(x if x.isprintable() and x != " " else f"%{ord(x):02X}" for x in url or "")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    at = data.index(_END)
    lines = data[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    payload = data[at + len(_END) : at + len(_END) + size]
    if len(payload) != size:
        raise ValueError("the record is cut off")
    return headers, payload


def split_records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The records of a gzip stream, of one member or many, inflated once and held one record at a time."""
    held, inflate = bytearray(), zlib.decompressobj(31)
    need, looked = 0, 0
    while True:
        while not need or len(held) < need:  # first the end of the headers, then the end of the record
            if not need:
                at = held.find(_END, max(0, looked - 3))
                if at >= 0:
                    size = next(int(x[15:]) for x in held[:at].split(b"\r\n") if x[:15].lower() == b"content-length:")
                    need = at + len(_END) + size + len(_END)
                    continue
                looked = len(held)
            if inflate.eof and inflate.unused_data:
                rest, inflate = inflate.unused_data, zlib.decompressobj(31)
                held += inflate.decompress(rest)
                continue
            piece = read(_PIECE)
            if not piece:
                if held:
                    raise ValueError("the archive ends within a record")
                return
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            held += inflate.decompress(piece)
        yield bytes(held[:need])
        del held[:need]
        need = looked = 0


def _member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_monolithic(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Archives of one gzip stream each, from (page_id, url, html, kind, digest, size, refers_to); a row (file) for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.open_path(folder)
        fs.create_dir(root, recursive=True)
        out, pack, name, taken = None, None, "", 0

        def close():
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, taken = f"raw-{uuid.uuid4().hex}.warc.gz", 0
                    out, pack = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record_bytes(row["kind"], row["page_id"], row["url"], row["html"].encode(), row["digest"], row["size"], row["refers_to"])
                out.write(pack.compress(data))
                taken += len(data)
                if taken >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.mapInArrow(run, "file string")


def normalise(files: DataFrame, folder: str, to: str, level: int = 1) -> DataFrame:
    """Rewrites each archive of ``folder`` into ``to``, a member per record; the sidecar index, a row per record:
    (file, offset, length, record_type, target).

    A stream is inflated once and never held whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.open_path(folder)
        _, target = C.open_path(to)
        fs.create_dir(target, recursive=True)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new = f"warc-{uuid.uuid4().hex}.warc.gz"
                index, offset = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source, fs.open_output_stream(f"{target}/{new}", compression=None) as out:
                    for record in split_records(source.read):
                        headers, _ = parse_record(record)
                        member = _member(record, level)
                        out.write(member)
                        index.append((new, offset, len(member), headers["WARC-Type"], headers["WARC-Target-URI"]))
                        offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["file", "offset", "length", "record_type", "target"])

    return files.mapInArrow(run, "file string, offset long, length long, record_type string, target string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, each fetched by its offset: (page_id, url, record_type, payload, digest, size,
    refers_to).  A payload that does not have the length and digest its record states is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.open_path(folder)
        names = ["page_id", "url", "record_type", "payload", "digest", "size", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source:
                        source.close()
                    name, source = row["file"], fs.open_input_file(f"{root}/{row['file']}")
                headers, payload = parse_record(zlib.decompress(source.read_at(row["length"], row["offset"]), 31))
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                if headers["WARC-Type"] != "revisit" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"record at {row['offset']} of {row['file']} is damaged")
                rows.append((_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], payload, digest, size, _number(headers.get("WARC-Refers-To", ""))))
                held += len(payload)
                if held >= 32_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        if source:
            source.close()

    return index.mapInArrow(run, "page_id long, url string, record_type string, payload binary, digest string, size long, refers_to long")


def _number(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, size, kind, refers_to): among payloads that are equal and of ``least`` bytes or more,
    the one of the largest page_id is the response and the others revisit it.

    Only digests that occur under several page_ids are joined back, so a page that nobody repeats is not looked up in
    anything large, and Spark splits a digest that holds many pages.
    """
    html = C.whole("html")
    full = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    twice = (
        full.where(F.col("size") >= least).select("digest", "page_id")
        .groupBy("digest").agg(F.min("page_id").alias("low"), F.max("page_id").alias("original"), F.count(F.lit(1)).alias("c"), F.count("page_id").alias("named"))
        .where("original IS NOT NULL AND (low <> original OR named < c)").select("digest", "original")
    )
    joined = full.join(twice, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("original")).alias("refers_to"))


def archive_pages(pages: DataFrame, least: int = 1000, level: int = 1) -> tuple[DataFrame, str]:
    """Writes pages as archives of one stream each and normalises them; (sidecar index, folder of the new archives).

    Every row gives a record: a null html is an empty payload, a null page_id an empty record number, rows with the same
    page_id and payload are all responses; an empty table gives no archive and an empty index; other columns are ignored.
    """
    spark = pages.sparkSession
    raw, final = C.new_folder(spark, "warc-raw"), C.new_folder(spark, "warc")
    files = C.written(write_monolithic(with_revisits(pages, least), raw, level), "warc-files")
    # an archive is the unit of work, since one stream can only be inflated from its start
    dealt = files.repartition(max(1, files.count()), "file")
    index = C.written(normalise(dealt, raw, final, level), "warc-index")
    fs, folder = C.open_path(raw)
    if fs.get_file_info(folder).type.name == "Directory":
        fs.delete_dir(folder)  # every record has its member now
    return index, final


def warc_round_trip(pages: DataFrame, least: int = 1000, level: int = 1, task_bytes: int = 8_000_000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its archived record."""
    index, folder = archive_pages(pages, least, level)
    # the index is far smaller than what it points to, so tasks are cut by the bytes that they will fetch
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // task_bytes
    dealt = index.repartition(tasks, "file", F.floor(F.col("offset") / task_bytes)).sortWithinPartitions("file", "offset")
    return read_records(dealt, folder).select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
