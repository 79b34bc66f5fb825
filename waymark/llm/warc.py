"""WARC archives: a writer with revisit records, and a salvage reader.

Writer. A page becomes a record in a gzip member of its own. Of pages with equal payloads (of at
least ``min_bytes``) the one with the largest page_id is the ``response``; the others are ``revisit`` records
that name it and carry the HTTP header only. Each task rolls over to a new archive beyond
``roll_bytes``; names are unique to the attempt, and only archives in the returned manifest, which
comes from successful tasks, are ever read, so a retried task leaves no doubles.

Salvage reader. Every record is checked: the gzip member's length and CRC, the version line, the
header, Content-Length, and the payload digest. After a failed check the reader searches from the
next byte for the next gzip member, or in plain archives version line, that passes all checks; the
bytes in between become one quarantined gap with offset, length and reason, and reading goes on.
Members are inflated as a stream: first through to their end, for their own checks, then record by record, so that
what is held is a record and not a member. Within a member that holds several records the reader goes on at the next version line
after a failed check; such a gap has the member's offset and length, and its own place among the inflated bytes
(inner_offset, inner_length). Of a damaged member, records whose payload digest is stated and right are
recovered (offset of the member, length null), and the member's bytes are a gap all the same. A record of more
than ``MAX_RECORD`` bytes, which no row could hold, is a gap.

Edge cases: a null payload is empty, and empty payloads count as equal (``min_bytes`` 0); a null page_id is
written as such and is smaller than any number; rows tied on the largest page_id of a payload are all
responses; payloads are whole whatever their length; an empty table writes no archive and reads
back no rows. Only named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import arrow_map, hot_join, materialize, scratch_path

ROLL_BYTES = 32 << 20
BROADCAST_ROWS = 50_000
CHUNK = 1 << 16
WINDOW = 1 << 20
MAX_RECORD = (1 << 31) - (1 << 20)
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("kind", T.StringType()),  # record or gap
        T.StructField("reason", T.StringType()),  # of a gap
        T.StructField("inner_offset", T.LongType()),  # of a gap within a member, among its inflated bytes
        T.StructField("inner_length", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def build_record(record_id: str, uri: str, payload: bytes, refers_to: str | None = None, length: int | None = None, digest: str | None = None) -> bytes:
    """One WARC record. With ``refers_to`` it is a revisit: ``payload`` isn't stored, only its
    length and digest."""
    digest = digest or base32_sha1(payload)
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Damaged(Exception):
    """A failed check; the message is the reason logged with the gap."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int, bool]:
    """The record that starts at ``at`` (anything missing at the end of data is damage), the position after it,
    and whether its payload has a digest, which is right."""
    start, size, head = _header(data, at)
    stop = start + size
    if len(data) < stop + 4 or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length doesn't match")
    block = bytes(data[start:stop])
    payload, stated = block, None
    if head.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("no HTTP header")
        payload = block[cut + 4 :]
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", block[:cut])
        stated = int(found[1]) if found else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = head.get("warc-type")
    revisit = kind == "revisit"
    if not revisit and digest and digest != base32_sha1(payload):
        raise Damaged("digest doesn't match")
    record = {
        "record_type": kind,
        "record_id": head.get("warc-record-id", "").strip("<>") or None,
        "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
        "payload_bytes": stated if revisit else len(payload),
        "payload_digest": digest or base32_sha1(payload),
        "payload": None if revisit else payload,
    }
    return record, stop + 4, bool(digest) and not revisit


def _header(data: bytes, at: int) -> tuple[int, int, dict[str, str]]:
    """Start of the block, its stated length, and the header of the record at ``at``."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    head: dict[str, str] = {}
    for line in bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().lower()] = value.strip()
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    if size < 0:
        raise Damaged("length doesn't match")
    if size > MAX_RECORD:
        raise Damaged("record too long")
    return end + 4, size, head


class _Source:
    """Bytes of an archive by position, through one window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.window)):
            self.file.seek(at)
            self.at, self.window = at, self.file.read(max(n, WINDOW))
        return self.window[at - self.at : at - self.at + n]

    def find(self, magic: bytes, at: int) -> int:
        """Position of the next ``magic`` from ``at``, or -1."""
        while at < self.size:
            data = self.read(at, min(WINDOW, self.size - at))
            found = data.find(magic)
            if found >= 0:
                return at + found
            if at + len(data) >= self.size:
                return -1
            at += len(data) - len(magic) + 1
        return -1


def _inflated(src: _Source, at: int, step: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Inflated bytes of the gzip member at ``at``, a little at a time, each with the position after the member or,
    before its end, -1. What a step of input inflates to before an error in it is lost."""
    inflate, pos, rest = zlib.decompressobj(31), at, b""
    while not inflate.eof:
        if not rest:
            rest = src.read(pos, min(step, src.size - pos))
            pos += len(rest)
            if not rest:
                raise Damaged("member cut off")
        try:
            out = inflate.decompress(rest, WINDOW)
        except zlib.error as e:
            raise Damaged("gzip: " + re.sub(r".*?: ", "", str(e))) from None
        rest = inflate.unconsumed_tail
        yield out, pos - len(inflate.unused_data) if inflate.eof else -1


def _member_end(src: _Source, at: int) -> int:
    """Position after the member at ``at``, which is sound and isn't empty."""
    some, end = False, -1
    for out, end in _inflated(src, at):
        some = some or bool(out)
    if not some:
        raise Damaged("empty member")
    return end


def _in_member(src: _Source, at: int, sound: bool) -> Iterator[dict]:
    """Records and inner gaps of the member at ``at``. Of one that isn't ``sound``: the records that their digests bear out."""
    stream = _inflated(src, at, CHUNK if sound else 16)
    held, base, over = bytearray(), 0, False  # inflated bytes from position ``base``

    def more(n: int) -> bool:
        """Whether ``held`` now has n bytes."""
        nonlocal over
        while len(held) < n and not over:
            try:
                held.extend(next(stream)[0])
            except StopIteration:
                over = True
            except Damaged:
                if sound:
                    raise
                over = True
        return len(held) >= n

    bad = why = None
    while more(1):
        try:
            if not more(len(VERSION)) or not held.startswith(VERSION):
                raise Damaged("no version line")
            need = 4096
            while held.find(b"\r\n\r\n") < 0 and need <= WINDOW and more(need):
                need *= 2
            start, size, _ = _header(held, 0)
            more(start + size + 4)
            record, n, proven = parse_record(held)
        except Damaged as e:
            if bad is None:
                bad, why = base, str(e)
            # on to the next version line at the start of a line
            n = 1
            while (found := held.find(b"\n" + VERSION, n - 1)) < 0:
                n = max(n, len(held) - len(VERSION))
                if not more(len(held) + 1):
                    n = len(held)
                    break
                if n > WINDOW:
                    del held[:n]
                    base, n = base + n, 1
            else:
                n = found + 1
            del held[:n]
            base += n
            continue
        if bad is not None and sound:
            yield {"kind": "gap", "reason": why, "inner_offset": bad, "inner_length": base - bad}
        bad = None
        if sound or proven:
            yield record | {"kind": "record"}
        del held[:n]
        base += n
    if bad is not None and sound:
        yield {"kind": "gap", "reason": why, "inner_offset": bad, "inner_length": base - bad}


def _plain(src: _Source, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and the position after it."""
    size = CHUNK
    while True:
        data = src.read(at, min(size, src.size - at))
        try:
            record, end, _ = parse_record(data)
            return record, at + end
        except Damaged:
            end = data.find(b"\r\n\r\n")
            found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", data[: max(end, 0)])
            need = end + 8 + int(found[1]) if found else 0
            if not data.startswith(VERSION) or at + len(data) >= src.size or (found and need <= len(data)) or (end < 0 and size > WINDOW) or need > MAX_RECORD:
                raise
            size = max(2 * size, need)


def salvage(file, size: int) -> Iterator[dict]:
    """Records and gaps of one archive (gzip members or plain, told by each record's first bytes), in
    order of offset."""
    src, at, bad, why = _Source(file, size), 0, None, None
    ahead = {GZIP: 0, VERSION: 0}  # where each was last found, so that no stretch is searched twice
    while at < size:
        head = src.read(at, min(8, size - at))
        try:
            if head.startswith(GZIP):
                record, end = None, _member_end(src, at)
            elif head.startswith(VERSION):
                record, end = _plain(src, at)
            else:
                raise Damaged("no member or version line")
            if record is None:
                inner = _in_member(src, at, True)
                first = next(inner, None)
                rest = next(inner, None) if first is not None else None
                if first is None or first["kind"] == "gap" and rest is None:  # nothing in it is a record
                    raise Damaged(first["reason"] if first else "empty member")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            if head.startswith(GZIP):
                for r in _in_member(src, at, False):
                    yield r | {"offset": at, "length": None}
            for magic, found in ahead.items():
                if 0 <= found <= at:
                    ahead[magic] = src.find(magic, at + 1)
            at = min((p for p in ahead.values() if p >= 0), default=size)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": why}
            bad = None
        for r in ([record | {"kind": "record"}] if record else itertools.chain([first], [rest] if rest else [], inner)):
            yield r | {"offset": at, "length": end - at}
        at = end
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": size - bad, "reason": why}


def with_duplicates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, n, keep): the payload's length, and for a revisit the page_id
    it refers to, else null with ``revisit`` false."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    body = src.withColumns({"sha": F.sha1(F.encode("html", "utf-8")), "n": F.octet_length("html").cast("long")})
    groups = body.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    groups = materialize(groups, "payloads")
    # Few payloads have copies in most crawls. A hot payload is one row here, however many its pages.
    if groups.count() <= BROADCAST_ROWS:
        joined = body.join(F.broadcast(groups.select("sha", "keep")), "sha", "left")
    else:
        # only keys and ids are shuffled for the match, a hot payload's over salts; then each page meets its own row
        named = materialize(body.select("sha", "page_id"), "digests")
        keeps = materialize(hot_join(named, groups.select("sha", "keep"), "sha", counts=groups.select("sha", F.col("copies").alias("n"))).select("page_id", "sha", "keep").distinct(), "keeps")
        joined = body.join(keeps, (body.sha == keeps.sha) & body.page_id.eqNullSafe(keeps.page_id), "left").select(body["*"], "keep")
    later = F.col("keep").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keep")))
    return joined.select("page_id", "url", "html", "n", F.coalesce(later, F.lit(False)).alias("revisit"), F.when(later, F.col("keep")).alias("keep"))


def write_archives(marked: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives; returns their manifest (archive, bytes, records), stored."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        made, out, path, n = [], None, None, 0

        def close():
            size = out.tell()
            out.close()
            made.append((path, size, n))

        for b in batches:
            for page, url, html, size, revisit, keep in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "n", "revisit", "keep"))):
                if out is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                raw = html.encode("utf-8", "surrogatepass")
                record = build_record(f"urn:page:{page}", url or "", raw, f"urn:page:{keep}" if revisit else None, size)
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(deflate.compress(record) + deflate.flush())
                n += 1
                if out.tell() >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["archive", "bytes", "records"])

    return materialize(arrow_map(marked, run, "archive string, bytes bigint, records bigint"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """Every record and gap of the archives named in ``manifest``: see ``RECORD``."""
    names = [f.name for f in RECORD.fields]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 2, *[pa.int64()] * 2, *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("archive").to_pylist():
                size, rows, held = fs.get_file_info(path).size, [], 0
                with fs.open_input_file(path) as file:
                    for r in salvage(file, size):
                        r["archive"] = path
                        held += 200 + len(r.get("payload") or b"")
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in rows], t) for c, t in zip(names, types)], names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in rows], t) for c, t in zip(names, types)], names)

    spread = manifest.select("archive").repartition(tasks or max(1, manifest.count()), "archive")
    return arrow_map(spread, run, RECORD)


def page_number(col: str):
    """The page_id in one of our record ids; null for the null id."""
    return F.expr(f"try_cast(regexp_extract({col}, '^urn:page:(-?[0-9]+)$', 1) as bigint)")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch_path(spark, "warc")
    read = read_archives(write_archives(with_duplicates(pages), folder), folder, payloads=False)
    return read.where("kind = 'record'").select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"),
    )


#: Base 32 of a hex SHA-1: four characters for each five hex digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || substr(h, 5 * cast(i // 4 as int) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) + 1]), '')"
SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h from p),
k as (select *, max(page_id) over (partition by h) as keep from d)
select page_id, n as payload_bytes, {_BASE32} as payload_digest, case when keep is not null and (page_id is null or page_id < keep) then 'revisit' else 'response' end as record_type,
       case when page_id is null or page_id < keep then keep end as refers_to
from k
"""
