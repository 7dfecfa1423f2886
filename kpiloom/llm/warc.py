"""WARC archives with segmented records.

Writing: a page's payload becomes an HTTP response in chunked transfer framing. A block longer than a
segment is split into the first record and continuation records, which name the first one as their
origin. A payload that another page holds already becomes a revisit record without a block.

Reading: complete records are decoded where they are read. Segments are grouped by origin, put in order
of their segment number, checked against the total length, and decoded; a gap, a wrong length, a
broken frame or a digest that does not fit raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.shared import materialize, open_input, open_output, run_folder

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
READ_BYTES = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Profile of a revisit, and the date of records whose capture time is not known.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
MANIFEST = "uri string, n_records long, n_bytes long"
_RECORD = ("origin string, segment int, total long, record_type string, page_id string, refers_to string, "
           "payload_bytes long, payload_digest string, block binary")


def digest32(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Trailer fields after the last chunk are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if body[at + size:at + size + 2] != b"\r\n" and size:
            raise ValueError("chunk of another length than its frame says")
        if not size:
            trailer = body[at:]
            if trailer != b"\r\n" and (not trailer.endswith(b"\r\n\r\n") or any(b":" not in x for x in trailer[:-4].split(b"\r\n"))):
                raise ValueError("trailing bytes after the last chunk")
            return b"".join(out)
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return dechunked(body) if framed else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_records(name: str, page: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    payload = (page["html"] or "").encode()
    url = " ".join((page["url"] or "").split())
    common = [("WARC-Date", _DATE), *([("WARC-Target-URI", url)] if url else [])]
    # page ids and payload lengths are extension fields, so a revisit is read without its response
    about = [("WARC-Payload-Digest", f"sha1:{page['digest']}"), ("Kpiloom-Payload-Length", str(page["n_bytes"]))]
    about += [("Kpiloom-Page-Id", str(page["page_id"]))] if page["page_id"] is not None else []
    if page["revisit"]:
        refers = [("Kpiloom-Refers-To-Page-Id", str(page["refers_to"]))] if page["refers_to"] is not None else []
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:kpiloom:{name}>"), *common, *about,
                      ("WARC-Profile", _PROFILE), *refers], b"")
        return
    block = _HTTP + chunked(payload)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:kpiloom:{name}>"), *common, *about,
             ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        yield record(first, block)
        return
    yield record([*first, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:kpiloom:{name}/{i}>"), *common,
                      ("WARC-Segment-Origin-ID", f"<urn:kpiloom:{name}>"), ("WARC-Segment-Number", str(i)), *last], part)


def read_members(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive whose records are gzip members; one record in memory."""
    left, data, done = b"", [], True
    unpack = None
    while True:
        piece = left or source.read(READ_BYTES)
        left = b""
        if not piece:
            if not done:
                raise ValueError("archive ends within a record")
            return
        if done:
            unpack, data, done = zlib.decompressobj(31), [], False
        data.append(unpack.decompress(piece))
        if unpack.eof:
            left, done = unpack.unused_data, True
            whole = b"".join(data)
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            size = int(headers["Content-Length"])
            if not lines[0].startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
                raise ValueError("record of another length than its header says")
            yield headers, rest[:size]


def _write(batches: Iterator[pa.RecordBatch], folder: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    part, n, size = TaskContext.get().partitionId(), 0, 0
    uri = f"{folder}/part-{part:06d}.warc.gz"
    with open_output(uri) as out:
        for batch in batches:
            for small in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                for page in small.to_pylist():
                    for data in page_records(f"{part}-{n}", page, segment_bytes):
                        out.write(data)
                        size += len(data)
                    n += 1
    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([size], pa.int64())],
                                     names=["uri", "n_records", "n_bytes"])


def write_archives(pages: DataFrame, folder: str, *, least: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as archives in ``folder``; returns the
    manifest (uri, n_records, n_bytes).

    Null html is empty, a null url is left out. Of records with equal payloads of at least ``least`` bytes that of the
    smallest page id (null last) is the response, of rows that repeat this id one of smallest url (null last);
    all others are revisits of it. An empty table gives archives without records.

    Revisits need no payload: they come from counts of equal (id, url, digest) rows. Payloads are moved once, by the
    same key and after copies in a task are one, so no group of copies is hot."""
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload).cast("long")
    grouped = pages.filter(size >= least).select("page_id", "url", F.sha1(payload).alias("sha"), size.alias("n_bytes"), "html")
    alike = grouped.groupBy("page_id", "url", "sha", "n_bytes").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    lead = alike.groupBy("sha").agg(F.min(order).alias("lead"))
    told = alike.join(lead, "sha").withColumn(
        "leads", F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url")))
    told = materialize(told.select("page_id", "url", "sha", "n_bytes", "copies", "leads", F.col("lead.page_id").alias("refers_to")),
                       f"{folder}/told")
    more = F.col("copies") - F.col("leads").cast("long")
    block = 10_000  # copies are written out in two steps, so no array grows with them
    revisits = (told.withColumn("more", more).filter("more > 0")
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(more - 1) div {block}"))))
                .withColumn("copy", F.explode(F.sequence(F.col("block") * block, F.least(F.col("more") - 1, F.col("block") * block + block - 1)))))
    # one key without nulls, so that the join finds payloads where the aggregate has put them
    alike_key = F.sha1(F.to_json(F.struct("page_id", "url", "sha")))
    texts = grouped.groupBy(alike_key.alias("alike")).agg(F.first("html").alias("html"))
    responses = texts.join(told.filter("leads").withColumn("alike", alike_key), "alike")
    columns = ["page_id", "url", "html", "n_bytes", "revisit", "refers_to", "sha"]
    rows = responses.withColumn("revisit", F.lit(False)).select(columns).unionByName(
        revisits.withColumns({"revisit": F.lit(True), "html": F.lit(None).cast("string")}).select(columns))
    if least > 0:
        small = pages.filter(size < least).select(
            "page_id", "url", "html", size.alias("n_bytes"), F.lit(False).alias("revisit"), F.col("page_id").alias("refers_to"), F.sha1(payload).alias("sha"))
        rows = rows.unionByName(small)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named():
            for b in batches:
                digest = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column("sha").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, digest], names=[*b.schema.names, "digest"])
        return _write(named(), f"{folder}/archives", segment_bytes)

    return materialize(rows.mapInArrow(write, MANIFEST), f"{folder}/manifest")


def _decoded(block: bytes, digest: str) -> int:
    payload = payload_of(block)
    if digest32(payload) != digest:
        raise ValueError("payload does not have the digest of its record")
    return len(payload)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _RECORD.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split(" ")[1]] for f in _RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows, held = [], 0
            with open_input(uri) as source:
                for head, block in read_members(source):
                    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    length = int(head["Kpiloom-Payload-Length"]) if "Kpiloom-Payload-Length" in head else None
                    segment = int(head.get("WARC-Segment-Number", 0))
                    if head["WARC-Type"] == "response" and not segment:
                        length, block = _decoded(block, digest), None
                    total = head.get("WARC-Segment-Total-Length")
                    rows.append((head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), segment, total and int(total),
                                 head["WARC-Type"], head.get("Kpiloom-Page-Id"), head.get("Kpiloom-Refers-To-Page-Id"),
                                 length, digest, block if segment else None))
                    held += len(rows[-1][-1] or b"") + 200
                    if held > READ_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def reassembled(parts: list[dict]) -> bytes:
    """The block of one record from its segments in any order; segments read twice count once."""
    by_number = {p["segment"]: p for p in parts}
    numbers = sorted(by_number)
    block = b"".join(by_number[i]["block"] for i in numbers)
    if numbers != list(range(1, len(numbers) + 1)) or by_number[numbers[-1]]["total"] != len(block):
        raise ValueError(f"segments of {parts[0]['origin']} are not whole")
    return block


def _join_segments(table: pa.Table) -> pa.Table:
    parts = table.to_pylist()
    first = min(parts, key=lambda p: p["segment"])
    n = _decoded(reassembled(parts), first["payload_digest"])
    return pa.table({"page_id": pa.array([first["page_id"]], pa.string()), "payload_bytes": pa.array([n], pa.int64()),
                     "payload_digest": pa.array([first["payload_digest"]], pa.string()),
                     "record_type": pa.array([first["record_type"]], pa.string()),
                     "refers_to": pa.array([first["refers_to"]], pa.string())})


def spread(manifest: DataFrame) -> DataFrame:
    """The uris of a manifest, each in a partition of its own."""
    return manifest.select("uri").repartitionByRange(max(1, manifest.count()), "uri")


def read_archives(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. Only the
    blocks of segmented records are moved, each to the group of its own origin. Every archive is read by a task of its
    own: ranges of so many uris are not merged as small hash partitions would be. Archives without records, or no
    archives, give no rows; a record that is cut, or differs from its digest, raises ValueError."""
    records = materialize(spread(manifest).mapInArrow(_read, _RECORD), f"{folder}/records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = records.filter("segment = 0").select(*columns)
    split = records.filter("segment > 0").groupBy("origin").applyInArrow(
        _join_segments, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return whole.unionByName(split).select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))


def round_trip(pages: DataFrame, *, least: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder and read them back."""
    folder = run_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, least=least, segment_bytes=segment_bytes)
    return read_archives(manifest, folder, pages.schema["page_id"].dataType.simpleString())


