"""WARC archives: a deduplicating writer, and a reader that salvages what follows damage.

Archives are .warc.gz files, one gzip member a record, in the shared folder. A member that fails a check (gzip's CRC and
length, the version line, the header block, Content-Length, block and payload digests) doesn't end the reading: the reader looks for the next
gzip magic (or, in uncompressed archives, the next version line) at which a whole valid record starts, goes on from
there, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.scratch import remove

from .common import forget, scratch_path, ship, written

#: Fixed values of the format.
VERSION, MAGIC, RESPONSE, REVISIT = b"WARC/1.1", b"\x1f\x8b\x08", "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of every record: archives of the same pages are the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are stored again each time. Archives are closed at about ROLL compressed bytes. Most tasks that read archives.
LEAST_SHARED, ROLL, MOST_READERS = 100, 32 << 20, 10_000
#: A digest is heavy if more than a HEAVY-th of all pages (and more than LEAST_HEAVY) have it.
HEAVY, LEAST_HEAVY = 1000, 64
#: Bytes fed to the decompressor at a time; what lies beyond a member is copied at most once.
STEP = 1 << 14
RECORD_SCHEMA = "archive string, start long, page_key string, record_type string, refers_to_key string, payload_digest string, payload_bytes long, payload binary, gap_end long, gap_reason string"


class Damaged(ValueError):
    """Bytes that are not a whole valid record."""


@dataclass(frozen=True)
class Record:
    page_key: str
    record_type: str
    refers_to_key: str | None
    payload_digest: str
    payload_bytes: int
    payload: bytes


def record_id(key: str) -> str:
    """A record's id: the page's key, in which anything but letters, digits and a few marks is written as %XX."""
    return f"<urn:x-page:{quote(key, safe='')}>"


def key_of(record_id: str) -> str:
    return unquote(record_id.removeprefix("<urn:x-page:").removesuffix(">"))


def clean_header(value: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in value or "urn:x-none:")


def encode_record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A record, uncompressed. A revisit holds the HTTP header only; digest and length are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {REVISIT if refers_to is not None else RESPONSE}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_header(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def decode_record(data: bytes, start: int = 0) -> tuple[Record, int]:
    """The record at start and the offset after it; Damaged if any check fails."""
    if data[start : start + 5] != b"WARC/" or (head_end := data.find(b"\r\n\r\n", start)) < 0:
        raise Damaged("no version line or header block")
    fields = {}
    for line in data[start:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        size = int(fields["content-length"])
        block_digest, payload_digest = (fields[k].removeprefix("sha256:") for k in ("warc-block-digest", "warc-payload-digest"))
        key, kind = key_of(fields["warc-record-id"]), fields["warc-type"]
    except (KeyError, ValueError) as e:
        raise Damaged(f"header field missing or wrong: {e}") from None
    body, end = head_end + 4, head_end + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("Content-Length doesn't lead to the end of a record")
    block = data[body:end]
    if hashlib.sha256(block).hexdigest() != block_digest:
        raise Damaged("block digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise Damaged("no HTTP header")
    if kind == REVISIT:
        length = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x[15:].strip().isdigit()), -1)
        return Record(key, kind, key_of(fields.get("warc-refers-to", "")), payload_digest, length, b""), end + 4
    if hashlib.sha256(payload).hexdigest() != payload_digest:
        raise Damaged("payload digest differs")
    return Record(key, kind, None, payload_digest, len(payload), payload), end + 4


def record_at(data: bytes, start: int) -> tuple[Record, int]:
    """The record whose gzip member or version line is at start, and the offset after it."""
    if data[start : start + 3] != MAGIC:
        return decode_record(data, start)
    coder, view, parts, at = zlib.decompressobj(31), memoryview(data), [], start
    try:
        while not coder.eof and at < len(data):
            parts.append(coder.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data))
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not coder.eof:
        raise Damaged("gzip member cut short")
    plain = b"".join(parts)
    record, used = decode_record(plain)
    if used != len(plain):
        raise Damaged("more than a record in a gzip member")
    return record, at - len(coder.unused_data)


def next_start(data: bytes, after: int) -> int:
    """The next offset at which a record may start; the end of the data if there is none."""
    found = [k for k in (data.find(MAGIC, after), data.find(b"WARC/", after)) if k >= 0]
    return min(found, default=len(data))


def read_archive(data: bytes) -> Iterator[tuple[int, Record | None, int, str]]:
    """(start, record, end, reason) for each record, and with None for each quarantined gap, in order of place.

    A place that only looks like a start is part of the gap: one gap runs up to the next record that passes every check.
    """
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            record, end = record_at(data, at)
        except Damaged as damage:
            gap, reason = (at, str(damage)) if gap < 0 else (gap, reason)
            at = next_start(data, at + 1)
            continue
        if gap >= 0:
            yield gap, None, at, reason
            gap = -1
        yield at, record, end, ""
        at = end
    if gap >= 0:
        yield gap, None, len(data), reason


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write a record for each row of (page_key, url, html, digest, refers_to_key) and return the archives as (archive, records, bytes).

    A task writes under names of its own, so a task that runs again leaves files that the returned table doesn't name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done = None, []

        def close():
            out[0].close()
            done.append((out[1], out[2], out[3]))

        for batch in batches:
            for key, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_key", "url", "html", "digest", "refers_to_key")), strict=True):
                member = gzip_member(encode_record(key.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), digest.as_py(), refers_to.as_py()))
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = [store.open_output_stream(f"{root}/{name}", compression=None), name, 0, 0]
                out[0].write(member)
                out[2] += 1
                out[3] += len(member)
                if out[3] >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return written(pages.select("page_key", "url", "html", "digest", "refers_to_key").mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD_SCHEMA rows of the named archives: records, and gaps (those with gap_reason). Damage is logged, never raised.

    Each task reads the archives that its rows name, one at a time. A stated number of partitions keeps adaptive execution
    from putting the names, which are few and short, into one task.
    """
    parts = min(max(archives.count(), 1), MOST_READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for start, r, end, reason in read_archive(data):
                    if r is None:
                        rows.append((name, start, None, None, None, None, None, None, end, reason))
                    else:
                        held += len(r.payload)
                        rows.append((name, start, r.page_key, r.record_type, r.refers_to_key, r.payload_digest, r.payload_bytes, r.payload if payloads else None, None, None))
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield records_batch(rows)
                        rows, held = [], 0
                yield records_batch(rows)

    spread = archives.select("archive").repartition(parts, "archive")
    return spread.mapInArrow(run, RECORD_SCHEMA)


def records_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_key, url, html, digest, refers_to_key) for each row of pages. A key is the id's text after =, and empty for null.

    Digests are counted without html, and those that stand more than once are written, so that Spark knows their size:
    within its bound for broadcasts (spark.sql.autoBroadcastJoinThreshold) no html moves, beyond it pages are joined by
    merging. Heavy digests, fewer than HEAVY by their definition, are always broadcast and their pages spread at random,
    so no task gets all copies of one. Rows with the same, smallest id and equal payloads are all responses. Among payloads
    whose ids are all null, none is a revisit.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest, n = F.sha2(html.cast("binary"), 256), F.octet_length(html)
    first = pages.where(n >= least).select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    shared = written(first.where((F.col("copies") > 1) & F.col("first_id").isNotNull()), "warc-shared")
    most = max((shared.agg(F.sum("copies")).first()[0] or 0) // HEAVY, LEAST_HEAVY)
    hot = shared.where(F.col("copies") > most).select("digest", F.col("first_id").alias("hot_id"))
    cold = shared.where(F.col("copies") <= most).select(F.col("digest").alias("cold_digest"), F.col("first_id").alias("cold_id"))
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("digest")).join(F.broadcast(hot), "digest", "left")
    # A page that needs no look-up gets a key that meets nothing and is as good as random.
    asked = F.when(F.col("hot_id").isNull() & (F.octet_length("html") >= least), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("asked", asked).join(cold, F.col("asked") == F.col("cold_digest"), "left")
    key = lambda c: F.concat(F.lit("="), c.cast("string"))
    first_id = F.coalesce("hot_id", "cold_id")
    refers = F.when(~F.col("page_id").eqNullSafe(first_id), key(first_id))
    return joined.select(F.coalesce(key(F.col("page_id")), F.lit("")).alias("page_key"), "url", "html", "digest", refers.alias("refers_to_key"))


def store_uri(folder: str) -> str:
    """A folder of Spark's as a URI that pyarrow opens."""
    if "://" in folder:
        return folder
    return "file://" + folder.removeprefix("file:")


def salvage(archives: DataFrame, folder: str, payloads: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the archives, both written: RECORD_SCHEMA rows, and (archive, start, gap_end, gap_reason) of what is quarantined."""
    read = written(read_archives(archives, folder, payloads), "warc-read")
    return read.where(F.col("gap_reason").isNull()), read.where(F.col("gap_reason").isNotNull()).select("archive", "start", "gap_end", "gap_reason")


def check_whole(archives: DataFrame, records: DataFrame, gaps: DataFrame) -> None:
    """Raise Damaged if an archive gave another number of records than the manifest states. The message names the first archives and gaps."""
    found = records.groupBy("archive").agg(F.count(F.lit(1)).alias("found"))
    wrong = archives.join(found, "archive", "left").where(F.coalesce("found", F.lit(0)) != F.col("records"))
    some = wrong.orderBy("archive").limit(5).collect()
    if some:
        lost = gaps.orderBy("archive", "start").limit(5).collect()
        told = ", ".join(f"{r['archive']}: {r['found'] or 0} of {r['records']} records" for r in some)
        raise Damaged(f"{told}; gaps: " + ", ".join(f"{g['archive']} {g['start']}-{g['gap_end']} ({g['gap_reason']})" for g in lost))


def read_back(archives: DataFrame, folder: str, id_type: str = "bigint", strict: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives' records.

    strict: a record that can't be read raises, as its page would be missing; else the records that can be read are
    returned, and salvage() tells the gaps.
    """
    records, gaps = salvage(archives, folder)
    if strict:
        check_whole(archives, records, gaps)
    as_id = lambda c: F.when(F.col(c) != "", F.col(c).substr(F.lit(2), F.length(c))).cast(id_type)
    return records.select(as_id("page_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to_key").alias("refers_to"))


def warc_table(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, read them back, and return page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; pages with a null id are read back with a null id, ids of any type with that type.
    Repeated rows are written each; of equal ids and payloads all are responses. A very long payload is one record in an
    archive of its own size. An empty table gives no rows. A record that can't be read back raises, with the gaps in the
    message. Only page_id, url and html are read, so other columns can't clash.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(with_revisits(pages), store_uri(folder))
    back = read_back(archives, store_uri(folder), pages.schema["page_id"].dataType.simpleString())
    remove(pages.sparkSession, folder)
    forget(archives)
    return back


ship(__name__)
