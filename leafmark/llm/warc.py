"""WARC archives of pages, and a normaliser of monolithic gzip archives.

write() makes one WARC record a page and packs the records of an archive into
a single gzip stream.  normalise() inflates such a stream once, from its
first to its last byte, rewrites every record as a gzip member of its own, and
gives the offset and length of each: the sidecar index.  lay_out() writes the
normalised archives, each with its sidecar, and read_laid() cuts every record
out of its archive by the index and inflates it.

Archives are tables of byte pieces in the shared folder, so that they live in
any store that Spark writes to; export() lays them out as files and load()
takes whole-file archives from any path.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.components import attach
from leafmark.llm.shared import lean, stage
from leafmark.llm.words import bounded

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of records in an archive, and of a piece of it, about.
ARCHIVE_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Bytes of archives that a partition holds, about.
PARTITION_BYTES = 16 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
#: Duplicated payloads (48 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST = 500_000

ARCHIVE = "archive string, part int, data binary"
MEMBERS = "archive string, number long, offset long, length long, record_id string, record_type string, member binary"
_MEMBER_NAMES = ["archive", "number", "offset", "length", "record_id", "record_type", "member"]
LAID = "archive string, part int, base long, data binary, sidecar array<struct<number: long, offset: long, length: long, record_id: string, record_type: string>>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of every page.

    Of the pages with one payload of LEAST_BYTES or more, that with the
    smallest page_id is a response and the others refer to it.  A null html is
    an empty payload.  Pages without an id are responses if no page of their
    payload has one; rows that repeat the smallest id are responses all.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    sized = lean(pages).select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    sized = sized.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    keys = sized.where(F.col("payload_bytes") >= LEAST_BYTES).select("payload_digest", "page_id")
    firsts = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stage(firsts, "firsts")
    known, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    joined = sized.join(F.broadcast(firsts.drop("n")), "payload_digest", "left") if known <= BROADCAST else attach(sized, firsts, ["payload_digest"], "n", total, "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A response, or a revisit whose block is the HTTP header alone."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (names in lower case) and the block of one record; a header without a length is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        raise ValueError(f"a record without Content-Length: {lines[0][:40]!r}")
    return fields, rest[: int(fields["content-length"])]


def write(decided: DataFrame) -> DataFrame:
    """The archives of decide()'s rows, each one gzip stream, as pieces (archive, part, data) in the shared folder."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number, rows = TaskContext.get().partitionId(), 0, []

        def table():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["archive", "part", "data"])

        stream = None
        for b in bounded(batches, "payload"):
            names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
            for values in zip(*[b.column(n).to_pylist() for n in names], strict=True):
                if stream is None:
                    stream, size, part, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, [b""]
                    name = f"pages-{task:06d}-{number:04d}"
                    info = b"software: leafmark\r\nformat: WARC File Format 1.1\r\n"
                    held.append(stream.compress(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
                record = _record(*values)
                size += len(record)
                held.append(stream.compress(record))
                if sum(map(len, held)) >= PIECE_BYTES or size >= ARCHIVE_BYTES:
                    if size >= ARCHIVE_BYTES:
                        held.append(stream.flush())
                    rows.append((name, part, b"".join(held)))
                    part, held = part + 1, []
                    yield table()
                    if size >= ARCHIVE_BYTES:
                        stream, number = None, number + 1
        if stream is not None:
            rows.append((name, part, b"".join([*held, stream.flush()])))
            yield table()

    return stage(decided.mapInArrow(pack, ARCHIVE), "archives")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Archives from files of any store, each as one piece; a file must fit into a cell (under 2 GB).

    Larger files come as rows (archive, part, data) of any reader: pieces may be cut anywhere.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path archive", "0 part", "content data")


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream, or of several members, that comes in pieces: a bounded number at a time.

    The last member must come to its end, check sum and length included; zero
    bytes behind it are padding, and anything else is an error.
    """
    inflate, ended = None, False
    for piece in pieces:
        more = False
        while piece or more:
            if inflate is None:
                piece = piece.lstrip(b"\0") if ended else piece
                if not piece:
                    break
                inflate = zlib.decompressobj(31)
            try:
                data = inflate.decompress(piece, PIECE_BYTES)
            except zlib.error as why:
                raise ValueError(f"an archive is damaged, or other bytes follow its end: {why}") from None
            yield data
            if inflate.eof:
                piece, inflate, ended, more = inflate.unused_data, None, True, False
            else:  # what is inflated and not yet given is asked for, even if all bytes are taken
                piece, more = inflate.unconsumed_tail, len(data) == PIECE_BYTES
    if inflate is not None or not ended:
        raise ValueError("an archive ends within a record or before its gzip stream does")


def _records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip stream that comes in pieces, inflated once; at most one record and a piece are held."""
    held, at, need = bytearray(), 0, 1
    for data in _inflated(pieces):
        held += data
        while len(held) - at >= need:
            head = held.find(b"\r\n\r\n", at)
            if head < 0:
                need = len(held) - at + 1
                break
            found = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", held[at : head + 2], re.IGNORECASE)
            if not found:
                raise ValueError("a record without Content-Length")
            end = head + 4 + int(found[1]) + 4
            if end > len(held):
                need = end - at
                break
            yield bytes(held[at:end])
            at, need = end, 1
        if at >= PIECE_BYTES:
            del held[:at]
            at = 0
    if held[at:].strip(b"\r\n"):
        raise ValueError("an archive ends within a record")


def _in_order(archives: DataFrame, order: str) -> DataFrame:
    """The rows of each archive one after the other in a partition; partitions are ranges of archives, sized by bytes."""
    column = "data" if order == "part" else "member"
    total = lean(archives).agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    n = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    return archives.repartitionByRange(n, "archive").sortWithinPartitions("archive", order)


def _members(batches) -> Iterator[tuple]:
    """The MEMBERS of archives whose pieces come in order."""
    pieces = ((b.column("archive")[i].as_py(), b.column("data")[i].as_py()) for b in batches for i in range(b.num_rows))
    for name, own in itertools.groupby(pieces, key=lambda x: x[0]):
        offset = 0
        for number, record in enumerate(_records(data for _, data in own)):
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = pack.compress(record) + pack.flush()
            fields, _ = parse(record)
            yield name, number, offset, len(member), fields.get("warc-record-id"), fields.get("warc-type"), member
            offset += len(member)


def _in_pieces(rows: Iterator[tuple]) -> Iterator[tuple[str, list[tuple]]]:
    """Runs of members of an archive of about PIECE_BYTES."""
    held, size = [], 0
    for row in rows:
        if held and (row[0] != held[0][0] or size >= PIECE_BYTES):
            yield held[0][0], held
            held, size = [], 0
        held.append(row)
        size += row[3]
    if held:
        yield held[0][0], held


def normalise(archives: DataFrame) -> DataFrame:
    """Every record as a gzip member: archive, number, offset, length, record_id, record_type, member.

    An archive is the members in the order of their numbers.  Archives are
    streamed: a task holds a piece and a record.  A stream that is cut off, be
    it between two records or within the check sum at its end, is an error, as
    is one without any byte, one that other bytes than zeros follow, and a
    record without Content-Length.  An empty table gives an empty table.
    """

    def rewrite(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for _, rows in _in_pieces(_members(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _MEMBER_NAMES)

    return _in_order(archives, "part").mapInArrow(rewrite, MEMBERS)


def lay_out(archives: DataFrame) -> DataFrame:
    """The normalised archives in the shared folder, in pieces of whole members, each with its part of the sidecar.

    A piece is (archive, part, base, data, sidecar): data begins at `base` of
    the archive; offsets count from the archive's start.
    """

    def lay(batches):
        import pyarrow as pa

        entry = pa.struct([("number", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
        kinds, part, before = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(entry)), 0, None
        for name, rows in _in_pieces(_members(batches)):
            part, before = part + 1 if name == before else 0, name
            sidecar = [dict(zip(("number", "offset", "length", "record_id", "record_type"), r[1:6], strict=True)) for r in rows]
            values = (name, part, rows[0][2], b"".join(r[6] for r in rows), sidecar)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["archive", "part", "base", "data", "sidecar"])

    return stage(_in_order(archives, "part").mapInArrow(lay, LAID), "normalised")


def _page(uri: str | None) -> int | None:
    """The page of a record's id; null for ids that aren't of pages here."""
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _fits(label: str | None, payload: bytes) -> bool:
    """Whether a payload has the digest of its header, in hex or base32; true where there is none or its kind is unknown."""
    kind, _, value = (label or "").partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5"):
        return True
    raw = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _opened(records):
    """A batch of RECORDS from inflated records.

    Records from elsewhere may lack a payload digest or have one of another
    kind: a response's digest is made of its payload, a revisit's is null.
    """
    import pyarrow as pa

    rows = []
    for record in records:
        fields, block = parse(record)
        kind, label = fields.get("warc-type"), fields.get("warc-payload-digest")
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
        chunked = re.search(rb"(?i)\r\ntransfer-encoding:[ \t]*chunked", http)
        if kind == "response":
            if not chunked and (not _fits(label, payload) or (size and len(payload) != int(size[1]))):
                raise ValueError(f"payload of {fields.get('warc-record-id')} is damaged")
            digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
        else:
            value = (label or "").removeprefix("sha256:")
            digest, length = value if re.fullmatch("[0-9a-f]{64}", value) else None, int(size[1]) if size else None
        rows.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), length, digest, kind, _page(fields.get("warc-refers-to")), payload if kind == "response" else None))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(normalised: DataFrame) -> DataFrame:
    """The response and revisit records, each from its own member.

    A response's payload must have the digest and length of its header, where
    it has them (a body in chunks is given as it is, unproved); a revisit's
    payload is null, its size and digest those of the page it refers to.  Ids
    of records from elsewhere give a null page_id.
    """

    def opened(batches):
        for b in bounded(batches, "member"):
            yield _opened(zlib.decompress(m, 31) for m in b.column("member").to_pylist())

    return normalised.select("member").mapInArrow(opened, RECORDS)


def read_laid(laid: DataFrame) -> DataFrame:
    """read()'s records, each cut out of its archive by the offset and length that the sidecar gives.

    The members that the sidecar cuts must be the whole piece and hold the
    records that it names.
    """

    def cut(name, base, data, sidecar):
        end = 0
        for e in sidecar:
            inflate, record = zlib.decompressobj(31), None
            if e["offset"] - base == end:
                record = inflate.decompress(data[end : end + e["length"]])
                end += e["length"]
            if record is None or not inflate.eof or inflate.unused_data or parse(record)[0].get("warc-record-id") != e["record_id"]:
                raise ValueError(f"the sidecar of {name} doesn't fit at record {e['number']}")
            yield record
        if end != len(data):
            raise ValueError(f"the sidecar of {name} doesn't reach its end")

    def opened(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield _opened(cut(*(b.column(c)[i].as_py() for c in ("archive", "base", "data", "sidecar"))))

    return laid.mapInArrow(opened, RECORDS)


def export(normalised: DataFrame, folder: str) -> DataFrame:
    """Write <archive>.warc.gz and <archive>.idx (offset, length, record) under a folder that all executors can open.

    Returns (path, records).  Archives are streamed; each is written to a name of its own task and renamed, so a task may run twice.
    """
    root = folder.removeprefix("file://")

    def lay(batches):
        import os
        import uuid

        import pyarrow as pa

        rows = (r for b in batches for r in b.to_pylist())
        for name, own in itertools.groupby(rows, key=lambda r: r["archive"]):
            path = os.path.join(root, re.sub(r"[^\w.-]", "_", name))
            os.makedirs(root, exist_ok=True)
            held, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
            with open(held, "wb") as data, open(held + "i", "w") as entries:
                for r in own:
                    data.write(r["member"])
                    entries.write(f"{r['offset']}\t{r['length']}\t{r['record_id']}\n")
                    n += 1
            os.replace(held, path + ".warc.gz")
            os.replace(held + "i", path + ".idx")
            yield pa.RecordBatch.from_pydict({"path": [path + ".warc.gz"], "records": pa.array([n], pa.int64())})

    ordered = _in_order(normalised.select("archive", "number", "offset", "length", "record_id", "member"), "number")
    return ordered.mapInArrow(lay, "path string, records long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of pages (page_id, url, html) after writing, normalising and reading back by the sidecar.

    One record a row: rows that repeat a page are records each, and a null html
    is an empty payload.  Other columns are ignored, whatever their names.
    """
    return read_laid(lay_out(write(decide(pages.select("page_id", "url", "html")))))
