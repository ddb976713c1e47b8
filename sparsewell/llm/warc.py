"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: every page is one record; of pages with equal payloads the one with the
largest id carries it and the others refer to it.

Reading: archives are split at the version line wherever it occurs, also inside
payloads.  Tasks parse what follows each occurrence and emit a candidate record
with the offset of its successor.  Inside a file block, which one task holds,
successors are followed to the first one beyond the block.  Pointer jumping over
these from the start of each file doubles the known part of the chain of blocks
per round, and a second pass marks the records between.  Candidates that the
chain does not reach are payload bytes and are given back to the record around
them.  A chain that does not end at the end of its file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, new_path, sorted_groups

VERSION = "WARC/1.0\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Most records of one archive file; bounds the size of a file.
FILE_RECORDS = 8192
#: Least payload size that may become a revisit.
REVISIT_BYTES = 0

_ID = re.compile(rb"^WARC-Record-ID: <urn:page:(-?\d+|none)>$")
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def format_record(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None) -> str:
    """One record, revisit if ``refers_to`` is given."""
    size = len(payload.encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode())}"]
    return VERSION + "\r\n".join(head) + "\r\n\r\n" + block + "\r\n\r\n"


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as archive files below ``path``.

    A null html is an empty payload; a null page_id is written as such, is
    always a response and is never referred to; of repeated rows with the
    largest page_id of a payload each is a response; record ids are made of
    page_ids and are as unique as those; other columns are ignored; an empty
    table writes no records.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    shared = rows.select("page_id", "sha1", "size").groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    # written, so that its size is known: pages are shuffled to it only if it is too large to be sent to them
    shared = materialize(shared.select("sha1", "size", "last"), "warc-shared")
    refers = F.when((F.col("size") >= revisit_bytes) & (F.col("page_id") < F.col("last")), F.col("last"))
    joined = rows.join(shared, ["sha1", "size"], "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            # the text writer ends every value with the line feed left out here
            yield pa.record_batch([pa.array([format_record(i, u, h, base64.b32encode(bytes.fromhex(d)).decode(), r)[:-1] for i, u, h, d, r in rows], pa.string())], names=["value"])

    joined.mapInArrow(records, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(shared)


def parse_record(body: bytes) -> tuple[int, dict] | None:
    """Parse what follows a version line: (bytes from there to the successor, fields); None if it is no record head."""
    end = body.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict = {"page_id": None, "url": None, "refers_to": None, "digest": None}
    length = kind = None
    for line in body[:end].split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            return None
        if name == b"Content-Length":
            if not value.isdigit():
                return None
            length = int(value)
        elif name == b"WARC-Type":
            kind = value.decode("ascii", "replace")
        elif name == b"WARC-Record-ID":
            m = _ID.match(line)
            fields["page_id"] = int(m[1]) if m and m[1] != b"none" else None
        elif name == b"WARC-Target-URI":
            fields["url"] = value.decode("utf-8", "replace")
        elif name == b"WARC-Refers-To":
            m = re.match(rb"<urn:page:(-?\d+)>$", value)
            fields["refers_to"] = int(m[1]) if m else None
        elif name == b"WARC-Payload-Digest":
            fields["digest"] = value.decode("ascii", "replace").removeprefix("sha1:")
    if length is None or kind is None:
        return None
    fields |= {"kind": kind, "head": end + 4, "length": length}
    return end + 4 + length + 4, fields


def payload_of(body: bytes, fields: dict) -> bytes | None:
    """Full payload of a response; None for a revisit, whose payload stands in another record."""
    if fields["kind"] == "revisit":
        return None
    block = body[fields["head"] : fields["head"] + fields["length"]]
    return block[block.find(b"\r\n\r\n") + 4 :]


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "kind": pa.string(), "refers_to": pa.int64(), "stated": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
_FIELDS_SQL = "page_id long, url string, kind string, refers_to long, stated string, payload_bytes long, payload_digest string"
_PLACE = {"file": pa.string(), "block": pa.int64(), "size": pa.int64(), "here": pa.int64(), "length": pa.int64(), "succ": pa.int64(), "complete": pa.bool_()}
_PLACE_SQL = "file string, block long, size long, here long, length long, succ long, complete boolean"


def _field_values(body: bytes, fields: dict) -> tuple:
    payload = payload_of(body, fields)
    known = (None, None) if payload is None else (len(payload), payload_digest(payload))
    return (fields["page_id"], fields["url"], fields["kind"], fields["refers_to"], fields["digest"], *known)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between version lines: file, block, size (of the file) and body, in file order within a block."""
    lines = spark.read.option("lineSep", VERSION).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("body"))


def _candidates(spark: SparkSession, path: str, with_body: bool) -> DataFrame:
    """A row per occurrence of the version line: place within its block, successor and fields, or else the body.

    ``here`` and ``succ`` count from the start of the block.
    """
    bounded_batches(spark)
    size = len(VERSION)
    kinds = {**_PLACE, "body": pa.binary()} if with_body else _PLACE | _FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = None, 0
        for b in batches:
            rows = []
            for file, block, total, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != (file, block):
                    place, at = (file, block), 0
                parsed = parse_record(body)
                succ = at + parsed[0] if parsed else None
                complete = parsed is not None and parsed[0] <= len(body)
                row = (file, block, total, at - size, len(body) + size, succ, complete)
                if with_body:
                    rows.append((*row, body))
                else:
                    rows.append((*row, *(_field_values(body, parsed[1]) if complete else [None] * len(_FIELDS))))
                at += len(body) + size
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return _pieces(spark, path).mapInArrow(run, f"{_PLACE_SQL}, {'body binary' if with_body else _FIELDS_SQL}")


def _next_inside(start: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Place of each row's successor among the sorted starts of its block; -1 if it is not one of them."""
    at = np.searchsorted(start, succ)
    return np.where(start[np.minimum(at, len(start) - 1)] == succ, at, -1)


def _exits(links: DataFrame) -> DataFrame:
    """(file, start, succ) with the successors followed to the first one beyond the block; chains that break off inside are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, 2):
            start, succ, end = (t.column(c).to_numpy() for c in (2, 3, 4))
            inside, out = _next_inside(start, succ), np.where(succ < end, -1, succ)
            for i in range(len(out) - 1, -1, -1):
                if inside[i] >= 0:
                    out[i] = out[inside[i]]
            whole = pa.array(out >= 0)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().filter(whole), pa.array(start).filter(whole), pa.array(out).filter(whole)], names=["file", "start", "succ"])

    rows = links.select("file", "block", "start", "succ", "end").repartition("file", "block").sortWithinPartitions("file", "block", "start")
    return rows.mapInArrow(run, "file string, start long, succ long")


def _walked(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, start, succ) of the records on the chain, from the entry of each block on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, 2):
            start, succ = t.column(2).to_numpy(), t.column(3).to_numpy()
            inside, on = _next_inside(start, succ), np.zeros(len(start), bool)
            for i in np.flatnonzero(t.column(4).to_numpy()):
                while i >= 0 and not on[i]:
                    on[i] = True
                    i = inside[i]
            on = pa.array(on)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().filter(on), pa.array(start).filter(on), pa.array(succ).filter(on)], names=["file", "start", "succ"])

    rows = links.join(entries.withColumn("entry", F.lit(True)).hint("merge"), ["file", "start"], "left").select("file", "block", "start", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    return rows.repartition("file", "block").sortWithinPartitions("file", "block", "start").mapInArrow(run, "file string, start long, succ long")


def _reachable(links: DataFrame) -> DataFrame:
    """(file, start) that are reached from offset 0, by pointer jumping over (file, start, succ)."""
    known = materialize(links.where("start = 0").select("file", "start"), "warc-known")
    jump = links
    while True:
        # known holds the first 2**k places of each file, jump leads 2**k places on
        further = known.join(jump.hint("merge"), ["file", "start"]).select("file", F.col("succ").alias("start"))
        further = materialize(further.join(links.select("file", "start").hint("merge"), ["file", "start"], "left_semi"), "warc-further")
        if not further.limit(1).count():
            discard(further)
            if jump is not links:
                discard(jump)
            return known
        second = jump.select("file", F.col("start").alias("succ"), F.col("succ").alias("next"))
        longer = materialize(jump.join(second.hint("merge"), ["file", "succ"]).select("file", "start", F.col("next").alias("succ")), "warc-jump")
        more = materialize(known.unionAll(further), "warc-known")
        for old in (known, further, *([jump] if jump is not links else [])):
            discard(old)
        known, jump = more, longer


def _check_ends(parsed: DataFrame, chain: DataFrame) -> None:
    """Raise ValueError for files whose chain does not end at their end."""
    sizes = parsed.groupBy("file").agg(F.max("size").alias("size"))
    ends = chain.groupBy("file").agg(F.max("succ").alias("end"))
    broken = sizes.join(ends, "file", "left").where("coalesce(end, 0) <> size").orderBy("file").limit(5).collect()
    if broken:
        raise ValueError("archives with a broken record: " + ", ".join(f"{r.file} at {r.end or 0} of {r.size}" for r in broken))


def _resolved(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and payload_digest of the referred response for revisits, and ``intact``."""
    there = records.where("kind <> 'revisit' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("n"))
    there = there.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), "n")
    joined = records.join(there, ["refers_to", "stated"], "left")
    revisit = F.col("kind") == "revisit"
    size = F.when(revisit, F.col("n")).otherwise(F.col("payload_bytes"))
    digest = F.when(revisit, F.when(F.col("n").isNotNull(), F.col("stated"))).otherwise(F.col("payload_digest"))
    intact = F.when(revisit, F.col("n").isNotNull()).otherwise(F.col("stated").isNull() | (F.col("stated") == F.col("payload_digest")))
    more = [c for c in records.columns if c not in _FIELDS]
    return joined.select("page_id", "url", "kind", "refers_to", size.alias("payload_bytes"), digest.alias("payload_digest"), intact.alias("intact"), *more)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives below ``path``.

    Returns page_id, url, kind, refers_to, payload_bytes, payload_digest (both of
    the full payload, computed; for a revisit those of the response it refers
    to) and intact; with ``payloads`` also payload (null for a revisit).  A record
    is intact if its stated digest is that of its payload or, for a revisit, of
    the response it refers to; bytes and digest of a revisit without such a
    response are null.  Raises ValueError if the records of a file do not reach
    to its end; an empty file has none.
    """
    parsed = materialize(_candidates(spark, path, False), "warc-candidates")
    ends = parsed.groupBy("file", "block").agg(F.max(F.col("here") + F.col("length")).alias("bytes"))
    # a file has few blocks; here counts from a version line before the first body
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("file", "block", F.coalesce(F.sum(F.col("bytes") + len(VERSION)).over(before), F.lit(0)).alias("base"), "bytes")
    base = materialize(base, "warc-blocks")
    placed = parsed.join(base.hint("merge"), ["file", "block"]).withColumn("start", F.col("here") + F.col("base")).withColumn("succ", F.col("succ") + F.col("base"))
    links = placed.where("start >= 0 and succ is not null and succ <= size").select("file", "block", "start", "succ", (F.col("base") + F.col("bytes")).alias("end"))
    links = materialize(links, "warc-links")
    exits = materialize(_exits(links), "warc-exits")
    entries = _reachable(exits)
    chain = materialize(_walked(links, entries), "warc-chain")
    for old in (links, exits, entries):
        discard(old)
    _check_ends(parsed, chain)
    known = chain.select("file", "start")
    small = placed.join(known.hint("merge"), ["file", "start"])
    whole = small.where("complete").select(*_FIELDS)
    parts = materialize((small if payloads else small.where("not complete")).select("file", "start"), "warc-parts")
    if not payloads and not parts.limit(1).count():
        return _resolved(whole)
    # give unreachable pieces to the record before them; a record's pieces are one group, bounded by its payload
    files = parts.select("file").distinct()
    marked = placed.where("start >= 0").select("file", "start").join(files, "file", "left_semi").join(known.withColumn("own", F.col("start")), ["file", "start"], "left")
    owned = marked.select("file", "start", F.last("own", True).over(Window.partitionBy("file").orderBy("start")).alias("owner"))
    owned = owned.join(parts.select("file", F.col("start").alias("owner")), ["file", "owner"], "left_semi")
    bodies = _candidates(spark, path, True).join(files, "file", "left_semi").join(base, ["file", "block"])
    pieces = bodies.select("file", (F.col("here") + F.col("base")).alias("start"), "body").join(owned, ["file", "start"]).repartition("file", "owner").sortWithinPartitions("file", "owner", "start").select("file", "owner", "body")
    kinds = _FIELDS | ({"payload": pa.binary()} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(batches, 2):
            body = VERSION.encode().join(t.column(2).to_pylist())
            _, fields = parse_record(body)
            row = (*_field_values(body, fields), *([payload_of(body, fields)] if payloads else []))
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds.values(), strict=True)], names=list(kinds))

    found = pieces.mapInArrow(run, _FIELDS_SQL + (", payload binary" if payloads else ""))
    return _resolved(materialize(found if payloads else whole.unionAll(found), "warc-records"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives to the shared folder and read them back.

    Returns one row per page: page_id, payload_bytes, payload_digest,
    record_type and refers_to.  Edge cases are those of ``write_archives``.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    records = read_archives(pages.sparkSession, path)
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
