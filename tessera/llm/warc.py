"""WARC archives in Zstandard with a shared dictionary: writer and reader.

An archive begins with a skippable frame that holds the dictionary; every record is a
frame of its own. Archives are rows (archive, content) of a table that Spark commits
to a shared folder, so a lost executor's archives are simply written again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Fixed values of the format: magic numbers of a dictionary's skippable frame and of a frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: An archive is closed at so many compressed bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 4096
#: The dictionary of DICTIONARY_BYTES that all archives of a write begin with is trained on up to SAMPLE pages, those whose
#: id's and address's hash is least, of SAMPLE_BYTES at most, and on as many made-up ones, so that there is one however little is written.
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 16 << 10, 256, 16 << 10
#: What a record says of a page beside the standard headers.
PAGE, REFERS, LENGTH = "X-Page-Id", "X-Refers-To-Page", "X-Payload-Length"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """The bytes of one response or revisit record; ids as text."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda page: f"<urn:page:{quote(page, safe='')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id or '')}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_clean(url)}"]
    lines += ["WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"{LENGTH}: {len(payload)}"]
    lines += [] if page_id is None else [f"{PAGE}: {quote(page_id, safe='')}"]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {name(refers_to)}", f"{REFERS}: {quote(refers_to, safe='')}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(sample: list[bytes]) -> bytes:
    """A trained Zstandard dictionary for records like these."""
    made_up = [
        record(str(i), f"https://example.org/{i * 7919 % 1000}", f"<!DOCTYPE html><html><head><title>Page {i}</title></head><body><p>{i * 104729 % 9973}</p></body></html>".encode(), None, False)
        for i in range(SAMPLE)
    ]
    return zstandard.train_dictionary(DICTIONARY_BYTES, sample + made_up).as_bytes()


def archives(records: Iterator[bytes], words: bytes) -> Iterator[bytes]:
    """Archives of the records: a frame with the dictionary ``words``, then a frame for each record."""
    packed = zstandard.ZstdCompressor(level=9).compress(words)
    begin = struct.pack("<II", SKIPPABLE, len(packed)) + packed
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    out, size = [begin], 0
    for x in records:
        out.append(coder.compress(x))
        size += len(out[-1])
        if size >= ARCHIVE_BYTES or len(out) > ARCHIVE_RECORDS:
            yield b"".join(out)
            out, size = [begin], 0
    if len(out) > 1:
        yield b"".join(out)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    view, at, words = memoryview(content), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"trailing bytes at {at}")
        magic = struct.unpack_from("<I", view, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = struct.unpack_from("<I", view, at + 4)[0]
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) != size:
                raise ValueError("the dictionary frame is cut off")
            if at == 0 and magic == SKIPPABLE:
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body)
                words = zstandard.ZstdCompressionDict(body)
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at {at}")
        if len(view) - at < 9:
            raise ValueError("a frame is cut off")
        decoder = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        parts, step = [], 1 << 14
        while not decoder.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("a frame is cut off")
            parts.append(decoder.decompress(piece))
            at += len(piece)
        at -= len(decoder.unused_data)
        yield b"".join(parts)


#: Types of records that hold a page or refer to one; records of other types are checked and passed over.
TYPES = ("response", "revisit")


def parse(raw: bytes) -> dict | None:
    """The fields of a response or revisit record, None for a sound record of another type; ValueError where headers or lengths don't hold.

    A response that is an HTTP message has what follows its HTTP headers as payload, another one its whole block. A SHA-1 digest in base 32, a
    stated payload length and the block's length are checked; a revisit takes its digest from its header, and its length if it states one.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("headers have no end")
    version, *lines = head.decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"version {version[:20]!r}")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a header that goes on
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line {line[:40]!r}")
        last = name.lower()
        fields[last] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    n = int(fields["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {n}, but {len(rest) - 4} bytes")
    kind = fields["warc-type"].lower()
    if kind not in TYPES:
        return None
    block, is_http = rest[:n], fields.get("content-type", "").lower().startswith("application/http")
    if is_http:
        http, gap, payload = block.partition(b"\r\n\r\n")
        if (block or kind == "response") and (not http.startswith(b"HTTP/") or not gap and kind == "response"):
            raise ValueError("no HTTP headers")
    else:
        payload = block
    named = lambda header: unquote(fields[header.lower()]) if header.lower() in fields else None
    out = {
        "record_type": kind, "record_id": fields["warc-record-id"].strip("<>"), "url": fields.get("warc-target-uri", "").strip("<>") or None,
        "refers_to_record": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "page_id": named(PAGE), "refers_to": named(REFERS), "payload": None,
    }
    stated = fields.get("warc-payload-digest", "")
    algorithm, _, value = stated.partition(":")
    sha1 = value.upper() if algorithm.lower() == "sha1" and len(value) == 32 else None
    length = int(fields[LENGTH.lower()]) if LENGTH.lower() in fields else None
    if kind == "revisit":
        if not stated or is_http and payload:
            raise ValueError("a revisit needs a digest and has no payload")
        return out | {"payload_bytes": length, "payload_digest": sha1 or stated}
    if sha1 and sha1 != digest(payload):
        raise ValueError("the payload's digest differs")
    if length is not None and length != len(payload):
        raise ValueError("the payload's length differs")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload)}


def write_archives(pages: DataFrame, path: str, smallest: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write each row of ``pages`` as a record to the table of archives (archive string, content binary) at ``path``.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of ``smallest`` bytes or
    more, one with the largest page_id (nulls least) is the response, the others revisit it. Of
    repeated rows of that page_id one is the response. An empty table writes no archive. Ids are of any type that has an order and a text;
    they are compared as they are and written as text.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= smallest
    per_id = rows.where(large).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    top = F.max(F.struct("page_id", "n"))
    some = checkpointed(
        per_id.groupBy("sha")
        .agg(top.alias("top"), F.sum("n").alias("copies"))
        .where("copies > 1")
        .select("sha", F.col("top.page_id").alias("response"), (F.col("top.n") > 1).alias("twice"), F.lit(True).alias("again"))
    )
    # As pages of a large group share one digest, adaptive execution splits the skewed side of this join.
    joined = rows.join(some, "sha", "left")
    joined = joined.withColumn("revisit", F.col("again").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("response")))

    # The sample is found by its keys, 8 bytes each, which need no payload.
    place = F.xxhash64(F.col(page_id), F.col(url))
    least = [r[0] for r in pages.select(place.alias("place")).orderBy("place").limit(SAMPLE).collect()]
    likely = pages.where(place <= (least[-1] if least else 0)).select(F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    likely = likely.where(F.octet_length("html") <= SAMPLE_BYTES).limit(SAMPLE).collect()
    shared = rows.sparkSession.sparkContext.broadcast(dictionary([record("0", r["url"], r["html"].encode(), None, False) for r in likely]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield record(r["page_id"], r["url"], r["html"].encode(), r["response"] if r["revisit"] else None, r["revisit"])

        for content in archives(every(), shared.value):
            yield pa.RecordBatch.from_pydict({"archive": [f"{hashlib.sha1(content).hexdigest()}.warc.zst"], "content": pa.array([content], pa.binary())})

    columns = ["page_id", "url", "html", "response", "revisit"]
    every = joined.select(columns)
    if not some.where("twice").isEmpty():  # rows that repeat the largest page_id: one is the response
        tie = F.coalesce("twice", F.lit(False)) & large & ~F.col("revisit")
        tied = joined.where(tie).groupBy("sha", "page_id", "response", "html", "url").agg(F.count("*").alias("n"))
        first = tied.groupBy("sha", "page_id", "response", "html").agg(F.min("url").alias("url")).withColumn("revisit", F.lit(False))
        others = tied.join(first.select("sha", F.col("url").alias("kept")), "sha").withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("kept")).cast("int"))
        others = others.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("revisit", F.lit(True))
        every = joined.where(~tie).select(columns).union(first.select(columns)).union(others.select(columns))
    every = every.withColumns({c: F.col(c).cast("string") for c in ("page_id", "response")})
    every.mapInArrow(pack, "archive string, content binary").write.mode("overwrite").option("compression", "none").parquet(path)


#: What ``read_archives`` returns; ids of pages are of the type asked for.
RECORD = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "error")
_TYPES = {"payload": pa.binary(), "payload_bytes": pa.int64()}


def read_archives(archives_: DataFrame, content: str = "content", payload: bool = True, id_type: str = "long") -> DataFrame:
    """A row (see ``RECORD``) per response and revisit record of archives in a binary column, as of ``write_archives`` or ``binaryFile``.

    ``error`` is null for a sound record; a record whose headers, lengths or digest don't hold gives a row with only
    the error, and so does an archive that can't be read on. Records of other types are checked and passed over. ``record_id`` and ``refers_to_record`` are
    the standard headers; ``page_id`` and ``refers_to`` are null for archives that don't say them, or in another type than ``id_type``. A
    null or empty archive has no records. ``payload`` false leaves the payloads out once they have been checked.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], _TYPES.get(n, pa.string())) for n in RECORD})

        rows: list[dict] = []
        size = 0
        for batch in batches:
            for content_ in batch.column(0):
                try:
                    for raw in frames(content_.as_py() or b""):
                        try:
                            r = parse(raw)
                            if r is None:
                                continue
                            if not payload:
                                r["payload"] = None
                        except (ValueError, UnicodeDecodeError) as e:
                            r = {"error": str(e)}
                        rows.append(r)
                        size += len(r.get("payload") or b"")
                        if len(rows) >= 2048 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append({"error": str(e)})
        if rows:
            yield batch_of(rows)

    schema = ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if n == 'payload_bytes' else 'string'}" for n in RECORD)
    found = archives_.select(content).mapInArrow(unpack, schema)
    return found.withColumns({c: F.col(c).try_cast(id_type) for c in ("page_id", "refers_to")})
