"""WARC archives: a writer of one gzip member per record and a sequential reader."""

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, scratch_path, written

# Fixed values of the file format
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 32 << 20  # of an archive; a reader's task holds one, packed, and a record of it

ROWS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
        "digest_ok boolean, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def _plain(value: str) -> str:
    for code in range(33):
        value = value.replace(f"%{code:02X}", chr(code))
    return value


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + END


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if url is not None:
        # percent signs are escaped first so that reading gives back the url
        fields.append(("WARC-Target-URI", _field(url.replace("%", "%25"))))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record(fields, block)


def read_members(stream: io.BufferedIOBase, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one gzip member after another, read in chunks.

    Zero bytes between members are padding. A member that ends too soon, or
    bytes that are no member, raise ValueError.
    """
    data, offset = b"", 0
    while True:
        data = data.lstrip(b"\0") or stream.read(chunk)
        if not data:
            return
        if not data.strip(b"\0"):
            continue
        unpack, parts = zlib.decompressobj(31), []
        try:
            while not unpack.eof:
                if not data and not (data := stream.read(chunk)):
                    raise ValueError(f"member {offset} is cut short")
                parts.append(unpack.decompress(data))
                data = unpack.unused_data
        except zlib.error as error:
            raise ValueError(f"member {offset} is damaged: {error}") from error
        offset += 1
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block, framed by Content-Length."""
    head, mark, rest = record.partition(END)
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = int(fields["content-length"])
    if len(rest) != length + len(END) or rest[length:] != END:
        raise ValueError("the block does not have its stated length")
    return fields, rest[:length]


def page_of(record: bytes) -> tuple | None:
    """One row of ROWS, None for records that hold no page. Digests are checked."""
    fields, block = parse_record(record)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(END)
    stated = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    right = fields["warc-block-digest"] == f"sha1:{base32_sha1(block)}"
    if kind == "response":
        right = right and stated == len(payload) and digest == base32_sha1(payload)
    number = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
    url = fields.get("warc-target-uri")
    return (number(fields["warc-record-id"]), None if url is None else _plain(url).replace("%25", "%"), kind, stated, digest,
            number(fields.get("warc-refers-to")), right, payload if kind == "response" else None)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000,
                   bytes_per_file: int = FILE_BYTES) -> None:
    """Write a record per row of pages (page_id, url, html) into WARC files under `path`.

    A file is closed after `records_per_file` records, or before the record that
    would take it over `bytes_per_file`, so no file is larger than that unless one record is.

    A null html is an empty payload, a null url leaves the target out. Among equal
    payloads of at least `min_bytes` the row with the largest page_id is a
    response and the others revisit it; a row repeated with that same id is a
    response too, and rows without an id revisit it. Other columns are ignored.

    Files go through Spark's own text writer, so any file system and its commit
    protocol serve. That writer ends each row with a separator of at least one
    byte: it is a zero byte, which is also the last byte of every member of
    under 16 MiB (the top byte of its length) and left out of the row there. A
    larger member is followed by a small metadata record, which ends with a zero.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    same = written(same.where("copies > 1"), "warc")
    total = same.agg(F.sum("copies")).first()[0] or 0
    rows = join_counted(rows, same, "sha1", "copies", total)
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, records = 0, 0, 0
        for batch in batches:
            out, parts = [], []
            for page_id, url, payload, sha1, to in zip(*(batch[c] for c in batch.columns)):
                whole = member(page_record(None if pd.isna(page_id) else int(page_id), url, payload, base64.b32encode(sha1).decode(),
                                           None if pd.isna(to) else int(to), date))
                if whole[-1]:
                    whole += member(_record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<urn:end:{page_id}>"), ("WARC-Date", date)], b""))
                if records and (held + len(whole) > bytes_per_file or records == records_per_file):
                    part, held, records = part + 1, 0, 0
                held, records = held + len(whole), records + 1
                out.append(whole[:-1])
                parts.append(part)
            yield pd.DataFrame({"value": out, "part": parts})

    members = rows.select("page_id", "url", "payload", "sha1", refers.alias("to")).mapInPandas(pack, "value binary, part int")
    # a folder a part, so a task closes one file where the next part begins
    members.select(F.col("value").cast("string").alias("value"), "part").write.option("lineSep", "\0").partitionBy("part").text(path)


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """The pages of all archives under `path`, see ROWS; one task reads a file from
    front to back. It holds the packed file, FILE_BYTES of those written here unless one record is larger,
    and unpacks one record of it at a time. `payload` is null for revisits."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                found = []
                for record in read_members(io.BytesIO(content)):
                    if (row := page_of(record)) is not None:
                        found.append(row if payloads else row[:-1] + (None,))
                    if len(found) == 256:
                        yield _frame(found, names)
                        found = []
                yield _frame(found, names)

    def _frame(found, names):
        frame = pd.DataFrame(found, columns=names)
        return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    # one archive a batch: two of them never wait in memory together
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInPandas(unpack, ROWS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, payloads=False).drop("payload")
