"""WARC bundles: records in independent Zstandard frames, a seek table at the end, and an index from record id to frame and offset.

Equal payloads of ``revisit_bytes`` or more are stored once: the record of the smallest page id is a response, the others
are revisits of it (profile identical-payload-digest), whose HTTP header still states the full length.

Defined results: a null html is an empty payload; a null url gives an empty target; a null page id revisits the smallest known
id of equal payloads, or is a response where there is none; rows that repeat the smallest page id are all
responses; an empty table gives no bundle. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.frames import FrameReader, FrameWriter
from barspark.llm.shared import kept

REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 30
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = np.dtype([("id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("size", "<u8")])
INDEX = "record_id string, page_id long, path string, frame int, offset long, size long"


def revisit_plan(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to. Only ids and digests are joined on digests; the payloads are dealt by row key, of which no value is frequent."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.xxhash64("page_id", "html").alias("row_key"))
    light = rows.filter(F.octet_length("html") >= revisit_bytes).select("page_id", "digest", "row_key")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = first.filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    later = light.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = later.groupBy("row_key", "digest").agg(F.min("refers_to").alias("refers_to"))
    return rows.join(later, ["row_key", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identifier)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its closing blank lines."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC fields, stated payload length, payload as stored) of one record."""
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = raw[cut + 4 : cut + 4 + int(fields["Content-Length"])]
    end = block.index(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", block[:end])[1])
    return fields, stated, block[end + 4 :]


def write_bundles(plan: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the records of ``revisit_plan``; return the index: record_id, page_id, path, frame, offset in the frame, size."""

    def write(batches) -> Iterator[pa.RecordBatch]:
        part, bundle = TaskContext.get().partitionId(), 0
        out, index, frame, filled, total = None, [], [], 0, 0

        def done() -> pa.RecordBatch:
            nonlocal out, index, frame, filled, total
            if frame:
                out.add(b"".join(frame))
            path = out.close(np.array([(i or 0, i is not None, *x) for i, *x in index], dtype=ENTRY).tobytes())
            ids = [x[0] for x in index]
            rows = pa.RecordBatch.from_pydict({
                "record_id": [record_id(i) for i in ids], "page_id": pa.array(ids, pa.int64()), "path": [path] * len(ids),
                "frame": pa.array([x[1] for x in index], pa.int32()), "offset": pa.array([x[2] for x in index], pa.int64()), "size": pa.array([x[3] for x in index], pa.int64()),
            })
            out, index, frame, filled, total = None, [], [], 0, 0
            return rows

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    out = FrameWriter(folder, f"pages-{part:06d}-{bundle:04d}.warc")
                    bundle += 1
                page_id = page_id.as_py()
                raw = record(page_id, url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())
                index.append((page_id, len(out.table), filled, len(raw)))
                frame.append(raw)
                filled += len(raw)
                total += len(raw)
                if filled >= frame_bytes:
                    out.add(b"".join(frame))
                    frame, filled = [], 0
                if total >= bundle_bytes:
                    yield done()
        if out:
            yield done()

    return kept(plan.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of the indexed records, read at their offsets.

    A response whose payload differs from its stated length or digest raises ValueError.
    """

    def read(batches):
        reader = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("path", "frame", "offset", "size")]
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for path, frame, offset, size in zip(*(c[lo : lo + 256] for c in columns)):
                    if reader is None or reader.uri != path:
                        if reader:
                            reader.close()
                        reader = FrameReader(path)
                    fields, stated, payload = parse(reader.frame(frame)[offset : offset + size])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind, refers_to = fields["WARC-Type"], None
                    if kind == "response":
                        if len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{fields['WARC-Record-ID']} in {path} is damaged")
                    else:
                        refers_to, payload = _page(fields["WARC-Refers-To"]), None
                    rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], stated, digest, kind, refers_to, payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if reader:
            reader.close()

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return index.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
