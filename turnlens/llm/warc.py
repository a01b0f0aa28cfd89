"""WARC (operator 7): archives written by Spark, normalised from one gzip stream to one member a record, read back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._files import open_file, open_stream, written_whole
from ._shared import checkpoint, fresh_dir

#: Fixed values of the format.
VERSION, BREAK = "WARC/1.0", "\r\n"
DIGEST_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PIECE = 1 << 20
#: Revisits up to this many are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
INDEX = "archive string, offset long, length long, record_id string, record_type string, uri string, payload_digest string, refers_to string"


def base32_sha1(data) -> F.Column:
    """Upper-case base32 of the SHA-1 of a binary column: 160 bits are 8 groups of 20, each four digits of base 32."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGEST_ALPHABET)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, refers_to): pages whose payload, of ``least_bytes`` or more, a smaller page_id has too."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.filter(F.col("page_id").isNotNull() & (F.octet_length(payload) >= least_bytes)).select("page_id", F.sha1(payload).alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    return keyed.join(firsts, "digest").filter("page_id > refers_to").select("page_id", "refers_to").distinct()


def warc_records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column, record: the text of a WARC record for each page (page_id, url, html), with its closing blank lines.

    A response has the HTTP header and the payload (the html; null counts as empty). A revisit has the HTTP header
    alone, with the length of the whole payload, and refers to the response."""
    again = checkpoint(revisits(pages, least_bytes))
    small = again.count() <= BROADCAST_ROWS
    again = F.broadcast(again) if small else again
    base = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    joined = base.join(again.select(F.col("page_id").alias("_p"), "refers_to"), F.col("page_id") == F.col("_p"), "left")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.octet_length("html").cast("string"), F.lit(BREAK * 2))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    profile = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    head = F.concat_ws(
        BREAK,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html").cast("binary"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(profile)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(head, F.lit(BREAK * 2), block, F.lit(BREAK * 2)).alias("record"))


def write_monolithic(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Writes archives of one gzip stream each. The text writer ends a row by a newline, which is the record's last."""
    body = records.select(F.expr("left(record, length(record) - 1)").alias("value"))
    body.write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).mode("error").text(path)


class _Inflated:
    """A gzip stream of one or many members, inflated once, front to back, in pieces."""

    def __init__(self, stream):
        self.stream, self.inflate, self.raw, self.data, self.ended = stream, zlib.decompressobj(31), b"", bytearray(), False

    def more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data.lstrip(b"\0") or self.raw
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.unconsumed_tail or self.raw or self.stream.read(PIECE)
            self.raw = b""
            if not piece:
                self.ended = True
                return False
            got = self.inflate.decompress(piece, PIECE)
            self.data += got
            if got:
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with ``mark``; None at the end."""
        seen = 0
        while (at := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark))
            if not self.more():
                if self.data.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields in lower case, header, block) of every record of a plain-gzip or member-wise archive."""
    source = _Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        lines = head.decode("utf-8", "replace").split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if ":" in line)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record's block has another length than its header says")
        yield fields, head, block


def normalise(spark: SparkSession, path: str, out: str, level: int = 6) -> DataFrame:
    """Rewrites every gzip archive below ``path`` into ``out`` with one gzip member a record; returns the offset index
    (see INDEX), of which each archive also has a sidecar of JSON lines, archive.idx.

    Archives are dealt to tasks, one stream each (gzip cannot be split); a task holds one record and a megabyte of the
    stream. A file appears under its name only when complete, so lost tasks can run again. Spark lists the archives;
    they are opened through Arrow's file systems."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "length")
    tasks = max(1, listed.count())
    listed = listed.repartition(tasks, "path").select("path")

    def work(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                stem = re.sub(r"(\.txt|\.warc)*\.gz$", "", source.rpartition("/")[2])
                name = f"{stem}-{xxhash.xxh64_hexdigest(source)}.warc.gz"  # archives of one name may stand in two folders
                target, offset, rows = f"{out}/{name}", 0, []
                with open_stream(source) as stream, written_whole(target) as archive:
                    for fields, head, block in read_records(stream):
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()
                        archive.write(member)
                        rows.append((target, offset, len(member), *(fields.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to"))))
                        offset += len(member)
                names = [x.split()[0] for x in INDEX.split(", ")]
                with written_whole(f"{target}.idx") as sidecar:
                    for row in rows:
                        sidecar.write((json.dumps(dict(zip(names[1:], row[1:], strict=True))) + "\n").encode())
                kinds = [pa.int64() if n in ("offset", "length") else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    return checkpoint(listed.mapInArrow(work, INDEX))


def read_member(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
    """One record by its place in a normalised archive."""
    with open_file(uri) as archive:
        return next(read_records(pa.BufferReader(archive.read_at(length, offset))))


def payloads(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of an index, from the archives.

    Each record is inflated from its own offset. A response's length and digest are those of the payload read, and
    must be those that it states; a revisit has no payload, so they are what its HTTP and WARC headers state."""
    archives = index.agg(F.count_distinct("archive")).first()[0]
    # as many tasks as archives: without a number, these small rows would all be put into one
    places = index.select("archive", "offset", "length").repartition(max(1, archives), "archive").sortWithinPartitions("archive", "offset")

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def work(batches):
        name, archive = None, None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != name:
                    if archive is not None:
                        archive.close()
                    name, archive = uri, open_file(uri)
                fields, _, block = next(read_records(pa.BufferReader(archive.read_at(length, offset))))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                    raise ValueError(f"the payload of {fields['warc-record-id']} is not what its record states")
                rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return places.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id: bigint, url, html) as archives, normalises them and reads them back (see ``payloads``).

    Of the pages with equal payloads of ``least_bytes`` or more, the smallest page_id is a response, the others revisit
    it. A null html is an empty payload; a null page_id is a response of its own. Rows that repeat a page_id with the
    same payload as the response are responses too. An empty table gives an empty result."""
    spark = pages.sparkSession
    whole, members = fresh_dir(spark, "warc-stream"), fresh_dir(spark, "warc")
    write_monolithic(warc_records(pages, least_bytes), whole)
    return payloads(normalise(spark, whole, members))
