"""WARC archives and a normaliser for monolithic gzip files.

A monolithic archive is one gzip stream for a whole file and can only be read
from its start. The normaliser inflates it once, as a stream, and rewrites
every record as a gzip member of its own, with a sidecar index of offsets, so
that any record is read by itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._scratch import Scratch, open_file, put_file
from ._tokens import pieces

LEAST_PAYLOAD, _READ = 100, 1 << 20
FEW = 50_000  # most repeated pages that are broadcast, some 100 bytes each
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record, with the HTTP header only, of the page refers_to."""
    uri = re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()).decode() or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _length(head: bytes) -> int:
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    if m is None:
        raise ValueError("a record without Content-Length")
    return int(m[1])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and the block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: _length(head)]


def inflate(stream, size: int = _READ):
    """Pieces of the inflated content of gzip members, one after the other, read once; a cut member is an error."""
    d, inside = zlib.decompressobj(31), False
    while data := stream.read(size):
        more = True
        while more:
            out = d.decompress(data, _READ)
            if out:
                yield out
            inside = not d.eof
            data = d.unused_data if d.eof else d.unconsumed_tail
            more = bool(data) or inside and len(out) == _READ
            if d.eof:
                d = zlib.decompressobj(31)
    if inside:
        raise ValueError("the archive ends inside a gzip member")


def records(chunks):
    """Raw records of an inflated stream; holds one record at a time."""
    held, chunks = bytearray(), iter(chunks)
    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0:
            more = next(chunks, None)
            if more is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
            held += more
            at = held.find(b"\r\n\r\n")
        n = _length(bytes(held[: at + 2]))
        end = at + 4 + n + 4
        while len(held) < end:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the archive ends inside a record")
            held += more
        yield bytes(held[:end])
        del held[:end]


def _deflated(parts, level: int):
    """One gzip stream of all parts."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    for p in parts:
        out = c.compress(p)
        if out:
            yield out
    yield c.flush()


def normalise(stream, level: int, index: list[dict]):
    """Members of the records of a gzip stream; index gets offset, length, id, type, uri and digest of each."""
    at = 0
    for raw in records(inflate(stream)):
        member = b"".join(_deflated([raw], level))
        fields, _ = parse(raw)
        index.append({"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")})
        at += len(member)
        yield member


def _write(root: str, date: str):
    def write(batches):
        part, count = TaskContext.get().partitionId(), [0]

        def rows():
            for batch in batches:
                for piece in pieces(batch, "html"):
                    for page_id, url, html, digest, refers_to in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                        count[0] += 1
                        yield record(page_id, url, html.encode(), digest, refers_to, date)

        put_file(f"{root}/mono-{part:06d}.warc.gz", _deflated(rows(), 1))
        if count[0]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": pa.array(count, pa.int64())})

    return write


def _normalise(level: int):
    def run(batches):
        for batch in batches:
            for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
                index: list[dict] = []
                with open_file(source) as stream:
                    put_file(f"{target}.warc.gz", normalise(stream, level, index))
                put_file(f"{target}.idx", (json.dumps(x).encode() + b"\n" for x in index))
                yield pa.RecordBatch.from_pydict({"target": pa.array([target], pa.string()), "records": pa.array([len(index)], pa.int64())})

    return run


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive, by its place in the index."""
    file.seek(offset)
    return parse(zlib.decompress(file.read(length), 31))


def _page(uri: str) -> int:
    return int(uri.rpartition(":")[2].rstrip(">"))


def _read():
    def read(batches):
        for batch in batches:
            for target in batch.column("target").to_pylist():
                with open_file(f"{target}.idx") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with open_file(f"{target}.warc.gz") as f:
                    for x in index:
                        fields, block = read_record(f, x["offset"], x["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = _length(http)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{x['id']} doesn't hold what its header says")
                        rows.append((_page(fields["warc-record-id"]), size, digest, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None))
                cols = list(zip(*rows)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def write_archives(pages: DataFrame, tmp: Scratch, root: str, least: int = LEAST_PAYLOAD, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a monolithic archive per partition of pages(page_id, url, html, ...); part and records of each.

    Of pages with equal payloads of `least` bytes or more, the one with the
    smallest page_id is a response, the others revisit it. Null html is an
    empty payload, a null url the page's own urn. Rows without page_id are left
    out; rows with equal page_id and payload get the same kind of record. A
    payload of any length is one record, which a task holds whole. An empty
    table gives no archives. Pages are written where they lie if few are
    repeated, else they are joined with what they repeat by page_id.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).filter("page_id is not null")
    p = p.withColumn("digest", F.sha2("html", 256))
    # Only ids of repeated payloads are joined back, by page: one payload may be any share of all
    some = tmp.save(p.filter(F.octet_length("html") >= least).select("page_id", "digest"), "digests")
    first = some.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = tmp.save(some.join(first, "digest").filter("page_id <> first").select(F.col("page_id").alias("again"), F.col("digest").alias("of"), "first").distinct(), "again")
    if again.limit(FEW + 1).count() <= FEW:
        again = F.broadcast(again)
    p = p.join(again, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("of")), "left")
    return p.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to")).mapInArrow(_write(root, date), "part int, records long")


def normalise_archives(archives: DataFrame, level: int = 4) -> DataFrame:
    """Rewrite archives(source, target) with a member per record and an index; target and records of each.

    source: the path of a gzip archive of WARC records, of one stream or of
    many; target: the path, without suffix, of <target>.warc.gz and
    <target>.idx. A task inflates an archive as a stream and holds one record
    at a time and the index. A cut archive, and a record without
    Content-Length, are errors.
    """
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("source", "target").repartition(n).mapInArrow(_normalise(level), "target string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of archives(target), read by the index and checked against its digest."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("target").repartition(n).mapInArrow(_read(), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise them, drop the monolithic ones and read the others back."""
    tmp = Scratch(pages.sparkSession, "warc")
    parts = tmp.save(write_archives(pages, tmp, tmp.path("monolithic")), "parts")
    name = F.format_string("%06d", "part")
    both = parts.select(F.concat(F.lit(tmp.path("monolithic") + "/mono-"), name, F.lit(".warc.gz")).alias("source"), F.concat(F.lit(tmp.path("archives") + "/part-"), name).alias("target"))
    done = tmp.save(normalise_archives(both), "normalised")
    tmp.drop("monolithic", "parts", "digests", "again")
    return read_archives(done)
