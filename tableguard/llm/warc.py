"""WARC archives with dictionary-compressed records.

``write`` lays pages out as WARC/1.1 records in archives: a leading skippable
frame (magic 0x184D2A5D) holds a Zstandard dictionary built from the archive's
own records, and each record is a Zstandard frame of its own that uses it, so
that records can be read one by one. Payloads that come more than once are
written once; the other records revisit it.

Archives go to the folder that driver and executors share, through a file
system that the folder's own scheme names. Every task attempt writes names of
its own, and only those of the attempt whose result the driver takes are in the
manifest that ``write`` returns; files of lost attempts are never read. The
manifest alone goes through the driver: a row for each archive, that is for
each ``ARCHIVE_BYTES`` and for each partition.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table

MAGIC = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def _open(path: str, mode: str):
    from pyarrow import fs

    # The name ends in .zst, but these streams are the compressed bytes themselves.
    system, inner = fs.FileSystem.from_uri(path)
    if mode == "rb":
        return system.open_input_stream(inner, compression=None)
    system.create_dir(inner.rpartition("/")[0])
    return system.open_output_stream(inner, compression=None)


def _record(page, url, payload: bytes, digest: str, first, size: int) -> bytes:
    """One WARC record; first: the page it revisits, or None."""
    name = lambda p: f"<urn:page:{quote(str(p), safe='')}>" if p is not None else f"<urn:uuid:{uuid.uuid4()}>"
    target = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if first is None else "revisit"),
        f"WARC-Record-ID: {name(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {PROFILE}"] if first is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Writes records to one archive; the first ones wait for the dictionary."""

    def __init__(self, path: str):
        self.path, self.waiting, self.held, self.size, self.records = path, [], 0, 0, 0
        self.out = self.packer = None

    def _start(self) -> None:
        import zstandard as z

        samples = [r[: 128 << 10] for r in self.waiting]
        try:
            trained = z.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.held // 8)), samples).as_bytes()
        except z.ZstdError:  # too few or too short records: they are the dictionary, as raw content
            trained = b"".join(samples)[:DICTIONARY_BYTES]
        self.packer = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(trained), write_content_size=True)
        self.out = _open(self.path, "wb")
        self.out.write(MAGIC + len(trained).to_bytes(4, "little") + trained)
        for r in self.waiting:
            self.out.write(self.packer.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.records += 1
        if self.out is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._start()
        else:
            self.out.write(self.packer.compress(record))

    def close(self) -> tuple[str, int]:
        if self.out is None:
            self._start()
        self.out.close()
        return self.path, self.records


def deduplicated(pages: DataFrame, key: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """(page, url, payload, size, sha1, first): first is the page to revisit.

    Among equal payloads of at least ``least`` bytes, the smallest page is the
    response. Digests alone are grouped; payloads move once, to their group's
    first page, and a payload with very many copies makes a join that splits.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), body.alias("payload"))
    sized = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    firsts = sized.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page").alias("least"))
    joined = sized.join(firsts, "sha1", "left")
    other = F.col("least").isNotNull() & ~F.col("page").eqNullSafe(F.col("least"))
    return joined.select("page", "url", F.when(~other, F.col("payload")).alias("payload"), "size", "sha1", F.when(other, F.col("least")).alias("first"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives under folder; return their manifest (path, records).

    Null payloads are empty. A page whose key is null gets a random record id;
    rows repeated with key and payload are all responses.
    """
    import pyarrow as pa

    def run(batches):
        archive = None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                page, link, body, size, sha1, first = row
                if archive is None or archive.size >= ARCHIVE_BYTES:
                    if archive is not None:
                        yield pa.RecordBatch.from_pydict(dict(zip(("path", "records"), ([x] for x in archive.close()))))
                    archive = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                archive.add(_record(page, link, body or b"", base64.b32encode(bytes.fromhex(sha1)).decode(), first, size))
        if archive is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records"), ([x] for x in archive.close()))))

    done = deduplicated(pages, key, url, payload, least).mapInArrow(run, "path string, records long").collect()
    return pages.sparkSession.createDataFrame(done, "path string, records long")


def records(path: str):
    """The records of an archive, in order, as bytes; one is held at a time."""
    import zstandard as z

    with _open(path, "rb") as file:
        if file.read(4) != MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        size = int.from_bytes(file.read(4), "little")
        trained = file.read(size)
        if len(trained) != size:
            raise ValueError(f"{path}: the dictionary is cut off")
        unpacker = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(trained))
        rest = file.read(1 << 20)
        while rest:
            frame, parts = unpacker.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := file.read(1 << 20)):
                    raise ValueError(f"{path}: the last record is cut off")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data
            yield b"".join(parts)
            rest = rest or file.read(1 << 20)


def parse(record: bytes) -> tuple:
    """(page, url, payload or None, size, digest, type, page it revisits); pages as text."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda x: unquote(x[10:-1]) if x and x.startswith("<urn:page:") else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if kind == "response" else None, size, digest, kind, page(fields.get("WARC-Refers-To"))


READ_SCHEMA = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read(manifest: DataFrame, payloads: bool = True, kind: str = "long") -> DataFrame:
    """The records of the archives in a manifest; payloads are verified.

    Each archive is a task's work: there are as many partitions as archives,
    which ``ARCHIVE_BYTES`` bounds. ``kind`` is the type of the pages' keys. No
    archives, no records; a record without a page has a null key.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    schema = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()))))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for record in records(path):
                    row = parse(record)
                    rows.append(row if payloads else (*row[:2], None, *row[3:]))
                    held += len(record) if payloads else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    # A partition for each path, which no exchange deals anew: paths are tiny, archives are not.
    spark, paths = manifest.sparkSession, [(r.path,) for r in manifest.select("path").collect()]
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(paths, max(1, len(paths))), "path string")
    found = dealt.mapInArrow(run, READ_SCHEMA)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Each page as the archives have it."""
    manifest = write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(manifest, payloads=False).drop("url", "payload")


def oracle() -> str:
    nibbles = ", ".join(f"'{k:04b}'" for k in range(16))
    bits = f"array_to_string(list_transform(range(1, 41), lambda k: [{nibbles}][instr('0123456789abcdef', substr(h, k, 1))]), '')"
    value = " + ".join(f"{1 << (4 - k)} * substr(b, 5 * k5 + {k + 1}, 1)::INT" for k in range(5))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, {bits} AS b FROM p)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda k5: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
