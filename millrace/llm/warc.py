"""WARC archives: a distributed writer, and a splittable reader of gzip members.

Writer: every task writes one .warc.gz file of its own, a gzip member per record, and reports it in a
manifest that Spark commits; files of lost attempts are in no manifest. Of equal payloads of at least
`min_revisit` bytes the record with the largest id is the response and all others are revisits.

Reader: tasks take byte ranges of the files, look for gzip magic, accept a member only if it decodes to the
headers of a WARC record, and own the records that start inside their range. A range is read block by block, and
members are found and decoded in the block at hand. A payload that deflate stores as it is may hold a whole archive, whose members
are none of the file's: where it ends no member follows. So a record that was searched for counts only if gzip members follow
one another from there to the end of the file, or for CHAIN bytes at least. Archives of this writer never hold bytes that read as
a member within another, so of them any range is read right; of others, so is each that doesn't begin inside of an archive of more than CHAIN
bytes that its record stores as it is.

Defined results: a null payload is empty; a null id or url leaves its header out; rows that repeat the
largest id of a payload are all responses; empty tables give no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

MIN_REVISIT = 1000
SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes for which members must follow one another from a record that was searched for.
CHAIN = 1 << 20
#: Bytes read from a file at once, handed to the decoder at once, and decoded at most to find a record's headers.
_BLOCK, _STEP, _HEAD = 1 << 20, 16 << 10, 64 << 10
MANIFEST = "path string, records long, bytes long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _clean(value: str) -> str:
    return "".join(c if c not in "\r\n" else " " for c in value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. digest: hexadecimal SHA-1 of the payload; refers_to: set for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    text = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    member = _member([text])
    if _holds_record(member):  # an archive that is stored as it is: blocks that end within each magic leave none whole
        first, *rest = text.split(MAGIC)
        member = _member([first, *(piece for part in rest for piece in (MAGIC[:1], MAGIC[1:] + part))])
    return member


def _member(pieces: list[bytes]) -> bytes:
    """A gzip member of some pieces, each in blocks of its own."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = [part for piece in pieces[:-1] for part in (squeeze.compress(piece), squeeze.flush(zlib.Z_SYNC_FLUSH))]
    return b"".join([*out, squeeze.compress(pieces[-1]), squeeze.flush()])


def _holds_record(member: bytes) -> bool:
    """Whether a reader could take some bytes within for a record's member."""
    at = member.find(MAGIC, 1)
    blocks = _Blocks(io.BytesIO(member), len(member)) if at >= 0 else None
    while at >= 0 and not _starts_record(blocks, at):
        at = member.find(MAGIC, at + 1)
    return at >= 0


def decode_record(record: bytes) -> dict | None:
    """The record's fields; None if it isn't one of ours (say, warcinfo)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    size = int(stated["content-length"])
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_id": fields["warc-record-id"], "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
    }


def plan_revisits(pages: DataFrame, page_id: str, payload: str, min_revisit: int, work: str) -> DataFrame:
    """__id, __url, __payload, __digest, __response: the id whose record is the response, where payloads repeat."""
    digest, size = F.sha1(F.col("__payload")), F.octet_length("__payload")
    seen = pages.select(F.col(page_id).alias("__id"), F.coalesce(payload, F.lit("")).alias("__payload"))
    seen = seen.where(size >= min_revisit).select("__id", digest.alias("__repeated"))
    repeated = seen.groupBy("__repeated").agg(F.max("__id").alias("__response"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return storage.save(repeated, work)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write one record per row below folder (a URI all executors can write); the manifest: path, records, bytes."""
    spark = pages.sparkSession
    storage.make_dir(spark, folder)
    storage.small_batches(spark)
    repeated = plan_revisits(pages, page_id, payload, min_revisit, f"{folder}/repeated")
    rows = pages.select(F.col(page_id).cast("long").alias("__id"), F.col(url).alias("__url"), F.coalesce(payload, F.lit("")).alias("__payload"))
    rows = rows.withColumn("__digest", F.sha1("__payload"))
    # Known to be small once it is written; Spark shuffles both sides where it isn't. Only the digest decides, so short payloads never meet it.
    rows = rows.join(repeated, rows["__digest"] == repeated["__repeated"], "left")
    refers = F.when(F.col("__id").isNull() | (F.col("__id") != F.col("__response")), F.col("__response"))
    rows = rows.select("__id", "__url", F.col("__payload").cast("binary").alias("__payload"), "__digest", refers.alias("__refers"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size = None, 0, 0
        fs, root = storage.file_system(folder)
        path = f"part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                member = encode_record(*row)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n], "bytes": [size]})

    return storage.save(rows.mapInArrow(storage.tidy(task), MANIFEST), f"{folder}/manifest")


class _Blocks:
    """A file's bytes, read _BLOCK or more at a time."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.begin, self.held = stream, size, 0, b""

    def at(self, offset: int, n: int) -> memoryview:
        """n bytes from offset, fewer at the end of the file."""
        n = max(0, min(n, self.size - offset))
        if not self.begin <= offset <= offset + n <= self.begin + len(self.held):
            self.stream.seek(offset)
            self.begin, self.held = offset, self.stream.read(min(max(n, _BLOCK), self.size - offset))
        return memoryview(self.held)[offset - self.begin : offset - self.begin + n]

    def find(self, what: bytes, begin: int, end: int) -> int:
        """Where `what` begins first in [begin, end), or -1."""
        while begin < end:
            self.at(begin, min(_STEP, end - begin) + len(what) - 1)
            upto = min(self.begin + len(self.held), end + len(what) - 1) - self.begin
            found = self.held.find(what, begin - self.begin, upto)
            if found >= 0:
                return self.begin + found
            begin = max(begin + 1, self.begin + upto - len(what) + 1)
        return -1


def _starts_record(blocks: _Blocks, offset: int) -> bool:
    """Whether a member at offset decodes to a version line and headers up to a blank line, with the type and length of a record."""
    unpack, head = zlib.decompressobj(31), b""
    while len(head) < _HEAD and not unpack.eof:
        raw = blocks.at(offset, _STEP)
        if not raw:
            return False
        try:
            head += unpack.decompress(raw, _HEAD - len(head))
        except zlib.error:
            return False
        if not head.startswith(b"WARC/1."[: len(head)]):
            return False
        if (stop := head.find(b"\r\n\r\n")) >= 0:
            names = {line.partition(b":")[0].strip().lower() for line in head[:stop].split(b"\r\n")[1:]}
            return {b"warc-type", b"content-length"} <= names
        offset += len(raw)
    return False


def _decode(blocks: _Blocks, offset: int, keep: bool = True) -> tuple[bytes, int]:
    """The record whose member begins at offset (empty, unless it is kept), and where the member ends."""
    unpack, parts, read = zlib.decompressobj(31), [], offset
    while not unpack.eof:
        raw = blocks.at(read, _STEP)
        if not raw:
            raise ValueError("a record is cut off at the end of its file")
        part = unpack.decompress(raw)
        if keep:
            parts.append(part)
        read += len(raw)
    return b"".join(parts), read - len(unpack.unused_data)


def _is_member(blocks: _Blocks, offset: int) -> bool:
    return blocks.at(offset, len(MAGIC)) == MAGIC and _starts_record(blocks, offset)


def _in_a_chain(blocks: _Blocks, offset: int) -> bool:
    """Whether gzip members, of records or not, follow one another from offset to the end of the file, or for CHAIN bytes."""
    here = offset
    while here < blocks.size and here - offset < CHAIN:
        if blocks.at(here, len(MAGIC)) != MAGIC:
            return False
        try:
            _, here = _decode(blocks, here, keep=False)
        except zlib.error:
            return False
    return here >= blocks.size or blocks.at(here, len(MAGIC)) == MAGIC


def records_in(stream, size: int, begin: int, end: int) -> Iterator[bytes]:
    """The decoded records of those members that start in bytes [begin, end) of a file of `size` bytes."""
    blocks, here = _Blocks(stream, size), begin
    while (here := blocks.find(MAGIC, here, end)) >= 0:
        if not _starts_record(blocks, here) or (here and not _in_a_chain(blocks, here)):
            here += 1
            continue
        while here < end:  # members that follow one another need no search
            record, here = _decode(blocks, here)
            yield record
            if here >= end or not _is_member(blocks, here):
                break


def read(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files (path, bytes), as RECORD says; a revisit's payload is null, its size and digest are the full payload's."""
    splits = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
    splits = splits.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "begin")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs, name = storage.file_system(path)
                rows, held = [], 0
                with fs.open_input_file(name) as stream:
                    for record in records_in(stream, size, begin, min(begin + split_bytes, size)):
                        if (row := decode_record(record)) is not None:
                            rows.append(row)
                            held += len(record)
                        if held > _BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return splits.mapInArrow(task, RECORD)
