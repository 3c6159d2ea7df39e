"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, and a last
skippable frame with the seek table (sizes of every frame, packed and plain). Beside it stands an
index: record identifier -> frame, offset inside the unpacked frame, length. A reader takes one
record by unpacking one frame. Bundles are rows of a table, so that Spark's own writers and readers
carry them to any store; export() also puts each one in a file of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.shared import written

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1

#: The profile that WARC 1.1 gives to records whose payload was archived before.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle string, data binary, records array<struct<record_id: string, page_id: long, frame: int, offset: long, length: long>>"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_column(payload: F.Column) -> F.Column:
    """SHA-1 in base 32: four pieces of 40 bits, each eight digits."""
    hexed = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*pieces), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_of(identifier: str) -> int | None:
    name = identifier.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload, and the payload length that the HTTP head states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return fields, payload, stated


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_TABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(data: bytes) -> list[tuple[int, int, int]]:
    """(place, packed size, plain size) of each frame, from the table at the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_TABLE_MAGIC:
        raise ValueError("the bundle ends without a seek table")
    places, at = [], 0
    for packed, plain in struct.iter_unpack("<II", data[-9 - 8 * count : -9]):
        places.append((at, packed, plain))
        at += packed
    return places


def _bundles(batches: Iterator[pd.DataFrame], frame_bytes: int, bundle_bytes: int) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    frames: list[bytes] = []
    sizes: list[tuple[int, int]] = []
    index: list[dict] = []
    plain = bytearray()

    def close_frame() -> None:
        if plain:
            frames.append(pack.compress(bytes(plain)))
            sizes.append((len(frames[-1]), len(plain)))
            plain.clear()

    def close_bundle() -> pd.DataFrame:
        close_frame()
        data = b"".join(frames) + seek_table(sizes)
        out = pd.DataFrame({"bundle": [hashlib.sha1(data).hexdigest()], "data": [data], "records": [list(index)]})
        frames.clear(), sizes.clear(), index.clear()
        return out

    for pdf in batches:
        for page, url, html, digest, first, revisit in zip(pdf.page_id, pdf.url, pdf.html, pdf.digest, pdf.first_id, pdf.revisit):
            page, first = (None if pd.isna(x) else int(x) for x in (page, first))
            raw = record_bytes(page, None if pd.isna(url) else url, html.encode(), digest, first, revisit)
            if plain and len(plain) + len(raw) > frame_bytes:
                close_frame()
            index.append({"record_id": record_id(page), "page_id": page, "frame": len(frames), "offset": len(plain), "length": len(raw)})
            plain += raw
            if sum(a for a, _ in sizes) + len(plain) >= bundle_bytes:
                yield close_bundle()
    if index:
        yield close_bundle()


def write_bundles(pages: DataFrame, min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20) -> DataFrame:
    """Bundles of all rows of pages(page_id, url, html): one row per bundle with its index.

    Among payloads of at least min_bytes that are equal, the record with the smallest page_id is a
    response and the others revisit it; repeated rows with that page_id are responses all. A null
    html is an empty payload; a null page_id comes after all others (and is a response only where no
    other record has the payload). A null url becomes about:blank. An empty table gives no bundle.
    Other columns are ignored.

    Only the smallest id per digest meets in a group (summed before the shuffle); pages then join it,
    which splits a digest that a third of the rows share.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", digest_column(F.col("html").cast("binary")))
    firsts = rows.select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first_id"))
    marked = rows.join(firsts, "digest").withColumn(
        "revisit",
        (F.octet_length("html") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")),
    )
    # Identifiers travel as text: pandas would turn a long column with nulls into doubles.
    marked = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first_id")})
    return marked.mapInPandas(lambda it: _bundles(it, frame_bytes, bundle_bytes), BUNDLES)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for k in range(batch.num_rows):
            data, out = batch["data"][k].as_py(), []
            places, open_frame, text = frame_places(data), -1, b""
            for entry in batch["records"][k].as_py():
                if entry["frame"] != open_frame:
                    open_frame = entry["frame"]
                    at, packed, plain = places[open_frame]
                    text = unpack.decompress(data[at : at + packed], max_output_size=plain)
                fields, payload, stated = parse_record(text[entry["offset"] : entry["offset"] + entry["length"]])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{entry['record_id']}: the payload does not match its digest")
                refers = fields.get("WARC-Refers-To")
                out.append((page_of(fields["WARC-Record-ID"]), stated, digest, kind, page_of(refers) if refers else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, found by index and seek table; digests of responses are checked."""
    return bundles.select("data", "records").mapInArrow(_records, PAGES)


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as <folder>/<bundle>.warc.zst from the tasks; returns the paths. folder: a URI that pyarrow.fs opens."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            paths = []
            for name, data in zip(pdf.bundle, pdf.data):
                with store.open_output_stream(f"{base}/{name}.warc.zst") as to:
                    to.write(data)
                paths.append(f"{folder}/{name}.warc.zst")
            yield pd.DataFrame({"path": paths})

    return bundles.select("bundle", "data").mapInPandas(put, "path string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of all pages to the shared folder and reads every record back."""
    return read_bundles(written(write_bundles(pages)))
