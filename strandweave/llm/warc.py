"""WARC records in ZIP-packaged archives: a writer, and a reader that never unpacks.

An archive is a ZIP file with stored members: WARC files under `archive/` (one gzip member a
record) and indexes under `indexes/` (lines of URL key, time and JSON, which has each record's file,
offset and length).  The writer makes one of each, its index sorted by key and time.  The reader
takes any such archive: it parses the end record, the ZIP64 records and the central directory, finds
where each stored member's bytes lie, reads the indexes, plain or gzipped, and fetches runs of
records by range; WARC members that no index names are walked record by record.  `page_id` and
`refers_to` are read from this module's record ids and are null for any other.

Nulls: a null payload is empty, a null url is an empty URI, and a null id is written as `null`
and read back as null; such a record is always a response.  Rows that repeat an id and its
payload are all responses, or all revisits of the same response; of an id that repeats with several
payloads each row is judged by its own payload.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches, open_folder, read_table, shared_folder

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
URN = "urn:strandweave:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
#: What is read or unpacked at once where a length isn't known.
PIECE_BYTES = 64 << 10

#: ZIP's record marks and fixed lengths.
END_MARK, END_LENGTH = b"PK\x05\x06", 22
LOCATOR_MARK, LOCATOR_LENGTH = b"PK\x06\x07", 20
END64_MARK = b"PK\x06\x06"
ENTRY_MARK, ENTRY_LENGTH = b"PK\x01\x02", 46
LOCAL_MARK, LOCAL_LENGTH = b"PK\x03\x04", 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipDirectory:
    """The members of a ZIP file: name to (method, packed size, size, place of the local header)."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - END_LENGTH - FULL16)
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(END_MARK)
        # A mark inside a comment isn't the end record: the comment's length must fit.
        while at >= 0 and at + END_LENGTH + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(END_MARK, 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        entries, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if entries == FULL16 or FULL32 in (length, start):
            entries, length, start = self._zip64(tail_at + at)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        listing, pos = self._read(start, length), 0
        for _ in range(entries):
            if listing[pos : pos + 4] != ENTRY_MARK:
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", listing[pos + 8 : pos + 12])
            packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", listing[pos + 20 : pos + 34])
            (header,) = struct.unpack("<I", listing[pos + 42 : pos + 46])
            name_at = pos + ENTRY_LENGTH
            name = listing[name_at : name_at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = listing[name_at + n_name : name_at + n_name + n_extra]
            plain, packed, header = self._wide(extra, plain, packed, header)
            self.members[name] = (method, packed, plain, header)
            pos = name_at + n_name + n_extra + n_comment

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("the ZIP file is cut short")
        return got

    def _zip64(self, end_at: int) -> tuple[int, int, int]:
        locator = self._read(end_at - LOCATOR_LENGTH, LOCATOR_LENGTH)
        if locator[:4] != LOCATOR_MARK:
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack("<Q", locator[8:16])
        record = self._read(at, 56)
        if record[:4] != END64_MARK:
            raise ValueError("no ZIP64 end record")
        return struct.unpack("<QQQ", record[32:56])

    @staticmethod
    def _wide(extra: bytes, *fields: int) -> list[int]:
        """Puts in the 64-bit values, which the ZIP64 extra field holds for full 32-bit ones, in order."""
        values, pos = list(fields), 0
        while pos + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[pos : pos + 4])
            if kind == 1:
                at = pos + 4
                for i, v in enumerate(values):
                    if v == FULL32:
                        (values[i],) = struct.unpack("<Q", extra[at : at + 8])
                        at += 8
            pos += 4 + n
        return values

    def place(self, name: str, stored: bool = True) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        method, packed, _, header = self.members[name]
        if method != 0 and stored:
            raise ValueError(f"{name} is compressed: only stored members can be read by range")
        local = self._read(header, LOCAL_LENGTH)
        if local[:4] != LOCAL_MARK:
            raise ValueError("no local header")
        n_name, n_extra = struct.unpack("<HH", local[26:30])
        return header + LOCAL_LENGTH + n_name + n_extra, packed

    def pieces(self, name: str) -> Iterator[bytes]:
        """A member's bytes, which may be deflated, piece by piece."""
        at, size = self.place(name, stored=False)
        raw = read_pieces(self.file, at, size)
        return inflated(raw, -15) if self.members[name][0] == 8 else raw

    def read(self, name: str) -> bytes:
        return b"".join(self.pieces(name))


def read_pieces(file, at: int, size: int) -> Iterator[bytes]:
    file.seek(at)
    while size > 0:
        got = file.read(min(PIECE_BYTES, size))
        if not got:
            raise ValueError("the file is cut short")
        size -= len(got)
        yield got


def inflated(pieces: Iterator[bytes], kind: int) -> Iterator[bytes]:
    """What deflated (-15) or gzip (31) data holds, in bounded pieces; gzip members may follow each other."""
    coder = zlib.decompressobj(kind)
    fed = False
    for piece in pieces:
        while piece:
            if coder.eof:
                coder = zlib.decompressobj(kind)
            fed = True
            yield coder.decompress(piece, PIECE_BYTES)
            piece = coder.unused_data if coder.eof else coder.unconsumed_tail
    while fed and not coder.eof:
        more = coder.decompress(b"", PIECE_BYTES)
        if not more and not coder.eof:
            raise ValueError("compressed data ends in its midst")
        yield more


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit (`refers_to` set) keeps the payload's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """The index's key of a URL: the host's parts reversed, then port, path and query; no spaces, one case."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        scheme, rest = "", url or ""
    host, slash, path = rest.partition("/")
    host, colon, port = host.rpartition("@")[2].partition(":")
    key = f"{','.join(reversed(host.split('.')))}{colon}{port}){slash or '/'}{path.partition('#')[0]}"
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02x}", key.lower())


_LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*(\d+)", re.I)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The WARC records that follow each other in `pieces`; what isn't a whole record is an error."""
    held, more = b"", iter(pieces)
    while True:
        held = held.lstrip(b"\r\n")
        while (head := held.find(b"\r\n\r\n")) < 0:
            if (piece := next(more, None)) is None:
                if held.strip(b"\r\n"):
                    raise ValueError("data ends inside a WARC record's header")
                return
            held = (held + piece).lstrip(b"\r\n")
        if not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        told = _LENGTH.search(held, 0, head)
        if not told:
            raise ValueError("a WARC record without a length")
        size = head + 4 + int(told[1])
        if len(held) < size:
            parts = [held]
            n = len(held)
            while n < size:
                if (piece := next(more, None)) is None:
                    raise ValueError("data ends inside a WARC record")
                parts.append(piece)
                n += len(piece)
            held = b"".join(parts)
        yield held[:size]
        held = held[size:]


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(headers with lower-case names, payload's length, payload) of a WARC record.

    The length is the HTTP header's, which a revisit still has; without one it is the payload's own.
    Records of other content than HTTP messages have their block as payload.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines:
        if line[:1] in (" ", "\t") and headers:  # a folded line goes on with the header before
            headers[name] += " " + line.strip(" \t")
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip(" \t")
    block = rest[: int(headers.get("content-length", len(rest)))]
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return headers, len(block), block
    http, _, payload = block.partition(b"\r\n\r\n")
    told = (x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    size = next((int(x) for x in told if x.isdigit()), len(payload))
    return headers, size, payload


class ArchiveWriter:
    """Writes records to one archive as a stream; needs no seeking."""

    def __init__(self, uri: str, level: int, date: str):
        fs, path = open_folder(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.level, self.date = uri, level, date
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA_MEMBER, "w", force_zip64=True)
        self.at, self.lines = 0, []
        self.time = re.sub(r"\D", "", date)[:14]

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        coder = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        raw = record_bytes(page_id, url, payload, digest, refers_to, self.date)
        packed = coder.compress(raw) + coder.flush()
        self.data.write(packed)
        about = {"url": url or "", "offset": self.at, "length": len(packed), "digest": f"sha256:{digest}", "filename": DATA_MEMBER.rpartition("/")[2]}
        self.lines.append(f"{url_key(url)} {self.time} {json.dumps(about)}\n")
        self.at += len(packed)

    def close(self) -> int:
        self.data.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as index:
            index.write("".join(sorted(self.lines)).encode())
        self.zip.close()
        self.out.close()
        return len(self.lines)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, refers_to.

    Only ids and digests are grouped and joined on the digest, whose groups may be large; the
    payloads move once, by id, so a much copied payload spreads over all tasks.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select("page_id", "url", "html", F.sha2(body.cast("binary"), 256).alias("digest"))
    keys = named.where((F.octet_length(body) >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
    later = (
        keys.join(first.where("first_id < last_id"), "digest")
        .where("page_id > first_id")
        .select("page_id", "digest", F.col("first_id").alias("refers_to"))
        .distinct()
    )
    return named.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(
    records: DataFrame, folder: str, level: int = 1, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes page_id, url, html, digest, refers_to to archives in `folder`; returns path, records of each.

    A task attempt writes under a name of its own and only the names of attempts that ended are
    returned, so a lost executor leaves nothing but files that no manifest lists.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for part in parts:
            cols = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*cols):
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz", level, date)
                writer.add(page_id, url, (html or "").encode(), digest, refers_to)
                if writer.at >= archive_bytes:
                    done.append((writer.uri, writer.close()))
                    writer = None
        if writer is not None:
            done.append((writer.uri, writer.close()))
        yield from batches({"path": ([d[0] for d in done], pa.string()), "records": ([d[1] for d in done], pa.int64())})

    made = records.mapInArrow(write, "path string, records long")
    manifest = f"{folder}/manifest"
    made.write.parquet(manifest)
    return records.sparkSession.read.schema(made.schema).parquet(manifest)


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def indexed(zipped: ZipDirectory) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records in each WARC member, by the archive's indexes; each record once."""
    members = [m for m in zipped.members if m.startswith("archive/") and m.endswith((".warc.gz", ".warc"))]
    known = {m.rpartition("/")[2]: m for m in members} | {m: m for m in members}
    found: dict[str, set[tuple[int, int]]] = {m: set() for m in members}
    for index in zipped.members:
        if not index.startswith("indexes/") or not index.endswith((".cdxj", ".cdx", ".cdx.gz", ".cdxj.gz")):
            continue
        raw = zipped.pieces(index)
        for line in _lines(inflated(raw, 31) if index.endswith(".gz") else raw):
            if (at := line.find("{")) >= 0 and not line.startswith("!"):
                about = json.loads(line[at:])
                if (member := known.get(about.get("filename", ""))) and "length" in about:
                    found[member].add((int(about["offset"]), int(about["length"])))
    return {m: sorted(places) for m, places in found.items()}


def walked(zipped: ZipDirectory, member: str) -> list[tuple[int, int]]:
    """(offset, length) of the gzip members, or plain records, of a WARC member, found by reading it in pieces."""
    base, size = zipped.place(member)
    places, at = [], 0
    if not member.endswith(".gz"):
        while at < size:
            head = b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                more = zipped._read(base + at + len(head), min(4096, size - at - len(head)))
                if not more:
                    break
                head += more
            told = _LENGTH.search(head, 0, end) if end >= 0 else None
            if not told:
                if head.strip(b"\r\n"):
                    raise ValueError(f"{member} has no whole record at {at}")
                break
            length = end + 4 + int(told[1])
            if at + length > size:
                raise ValueError(f"{member} ends inside a record")
            after = zipped._read(base + at + length, min(4, size - at - length))
            length += len(after) - len(after.lstrip(b"\r\n"))
            places.append((at, length))
            at += length
        return places
    coder, pos = zlib.decompressobj(31), 0
    for piece in read_pieces(zipped.file, base, size):
        pos += len(piece)
        while piece:
            # The data themselves aren't kept, only where they end.
            coder.decompress(piece, PIECE_BYTES)
            piece = coder.unused_data if coder.eof else coder.unconsumed_tail
            if coder.eof:
                end = pos - len(piece)
                places.append((at, end - at))
                at, coder = end, zlib.decompressobj(31)
    if at < size:
        raise ValueError(f"{member} ends inside a record")
    return places


def places_of(zipped: ZipDirectory, member: str, told: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The index's places if they are all of the member, one after another; else what a walk finds."""
    at = 0
    for offset, length in told:
        if offset != at or length <= 0:
            break
        at += length
    return told if told and at == zipped.place(member)[1] else walked(zipped, member)


RANGES = "path string, at long, lengths array<long>, packed boolean"


def _ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for uri in part.column("path").to_pylist():
            fs, path = open_folder(uri)
            rows: list[tuple[str, int, list[int], bool]] = []
            try:
                with fs.open_input_file(path) as file:
                    zipped = ZipDirectory(file, file.size())
                    for member, told in indexed(zipped).items():
                        base, _ = zipped.place(member)
                        end, full = None, 0
                        for offset, length in places_of(zipped, member, told):
                            if offset != end or full >= RANGE_BYTES:
                                rows.append((uri, base + offset, [], member.endswith(".gz")))
                                full = 0
                            rows[-1][2].append(length)
                            full += length
                            end = offset + length
            except ValueError as wrong:
                raise ValueError(f"{uri}: {wrong}") from wrong
            yield from batches(
                {
                    "path": ([r[0] for r in rows], pa.string()),
                    "at": ([r[1] for r in rows], pa.int64()),
                    "lengths": ([r[2] for r in rows], pa.list_(pa.int64())),
                    "packed": ([r[3] for r in rows], pa.bool_()),
                }
            )


def _raw_records(file, at: int, lengths: list[int], packed: bool) -> Iterator[bytes]:
    """The records of a run of gzip members, of one or several records each, or of plain records."""
    small = sum(lengths) <= 2 * RANGE_BYTES
    if small:
        file.seek(at)
        run = memoryview(file.read(sum(lengths)))
    pos = 0
    for n in lengths:
        if small and packed:
            yield from split_records(iter((zlib.decompress(run[pos : pos + n], 31),)))
        elif small:
            yield from split_records(iter((bytes(run[pos : pos + n]),)))
        else:  # a member of very many records, or a very long record
            raw = read_pieces(file, at + pos, n)
            yield from split_records(inflated(raw, 31) if packed else raw)
        pos += n


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _records(keep_payload: bool):
    def number(urn: str | None) -> int | None:
        own = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
        return int(own[1]) if own else None

    def bare(told: str) -> str:
        return told[1:-1] if told.startswith("<") and told.endswith(">") else told

    def values(raw: bytes) -> tuple:
        headers, size, payload = parse_record(raw)
        told = headers.get("warc-payload-digest", "")
        # Digests of other kinds are passed on as they stand, and so is a revisit's, which has no payload to try.
        digest = told.removeprefix("sha256:")
        if headers.get("warc-type") != "revisit" and (not told or told != digest):
            own = hashlib.sha256(payload).hexdigest()
            if told and len(digest) == 64 and (len(payload) != size or own != digest.lower()):
                raise ValueError(f"{headers.get('warc-record-id')}: the payload isn't what its header says")
            digest = digest if told and len(digest) != 64 else own
        return (
            number(headers.get("warc-record-id")), bare(headers.get("warc-target-uri", "")), size, digest,
            headers.get("warc-type"), number(headers.get("warc-refers-to")), payload if keep_payload else None,
        )

    def given(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        yield from batches({n: (list(v), t) for n, v, t in zip(names, zip(*rows), kinds)}, rows=1024)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for uri, at, lengths, packed in zip(*(part.column(c).to_pylist() for c in ("path", "at", "lengths", "packed"))):
                fs, path = open_folder(uri)
                rows, size = [], 0
                try:
                    with fs.open_input_file(path) as file:
                        for raw in _raw_records(file, at, lengths, packed):
                            rows.append(values(raw))
                            size += len(raw)
                            if size > 4 * RANGE_BYTES:
                                yield from given(rows)
                                rows, size = [], 0
                except (ValueError, zlib.error) as wrong:
                    raise ValueError(f"{uri}: {wrong}") from wrong
                if rows:
                    yield from given(rows)

    return read


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Every record of the archives in column `path`: READ's columns; a revisit's payload is empty.

    record_type is the record's own type, whatever it is; records without a digest get their payload's.
    Large archives are read by many tasks, each a run of records of a few MB.  WARC members may be plain or gzipped, by record or as
    a whole; an index that doesn't name all of a member is set aside for a walk through it.  What isn't a whole record is
    an error that names the archive.
    """
    # Fixed counts: names and offsets are too few bytes for AQE to see the work behind them.
    files = max(1, archives.count())
    tasks = max(files, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = archives.select("path").repartitionByRange(files, "path").mapInArrow(_ranges, RANGES).repartition(tasks, "path", "at")
    return ranges.mapInArrow(_records(keep_payload), READ)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: writes `pages` to archives and reads them back."""
    pages = read_table(spark, sf_dir, "pages")
    archives = write_archives(with_revisits(pages), shared_folder(spark, "warc"))
    return read_archives(archives, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE octet_length(body) >= 100 GROUP BY payload_digest
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to, coalesce(url, '') AS url
FROM p LEFT JOIN f USING (payload_digest)
"""
