"""WARC archives in Zstandard frames with a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every
record after it is one Zstandard frame.  ``write_archives`` writes pages with
Spark: each task rolls archives of about ARCHIVE_BYTES into the shared folder
under a temporary name and renames them when they are complete; the manifest it
returns lists only archives of finished tasks, so a repeated task leaves
nothing that is read.  ``read_archives`` reads the files that a manifest lists
from the shared folder, an archive at a time, loads the dictionary from the leading frame, decodes frame
after frame and validates: the version line, required headers, the content
length against the block, the HTTP length against the payload and the payload
digest.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the
least page id is the response, the others are revisits: they keep the HTTP
headers (with the payload's length) and refer to the response.  Digests are
grouped with a map-side minimum; only digests met twice are joined back, as a
skewed join that Spark can split.

Edge cases: a null html is an empty payload.  Pages with a null id are
responses and take no part in revisits.  Rows that repeat the least id are each
a response.  A null url is an empty header and read back as null.  Line breaks
in urls are percent-encoded in the header and restored.  An empty table writes
no archive and gives an empty result.  Extra columns are ignored.  A damaged
frame, header or length raises ``ValueError`` with the archive and the offset.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import checkpoint_dir, materialize

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
LEVEL = 5
#: pages that the dictionary is trained on, at most, and bytes taken of each
DICTIONARY_PAGES = 400
DICTIONARY_BYTES = 64 << 10

#: fixed value: magic number of the skippable frame that holds the dictionary
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"

_TYPES = ("response", "revisit")


def _filesystem(uri: str):
    """A file system that driver and executors share, and the path in it."""
    if "://" not in uri:
        uri = "file://" + uri if not uri.startswith("file:") else "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _fold(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfold(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            .encode())
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_fold(url)}")
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record; ``ValueError`` if a header or length is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(": ")
        if not colon:
            k, colon, v = line.partition(":")
        if not colon or k.lower() in h:
            raise ValueError(f"bad header line {line[:80]!r}")
        h[k.lower()] = v
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]
    if missing or h["warc-type"] not in _TYPES or not h["content-length"].isdigit():
        raise ValueError(f"missing or bad headers {missing}")
    n = int(h["content-length"])
    block = rest[:n]
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content length {n}, block {len(rest) - 4}")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = [x[16:] for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length: ")]
    if not sep or not http.startswith(b"HTTP/") or len(length) != 1 or not length[0].isdigit():
        raise ValueError("bad HTTP header")
    digest = h.get("warc-payload-digest", "")
    revisit = h["warc-type"] == "revisit"
    if revisit and (payload or "warc-refers-to" not in h):
        raise ValueError("bad revisit")
    if not revisit and (len(payload) != int(length[0])
                        or digest != "sha256:" + hashlib.sha256(payload).hexdigest()):
        raise ValueError("payload differs from its length or digest")

    def page(name):
        name = name.removeprefix("<urn:page:").removesuffix(">")
        return None if name == "null" else int(name)

    return {"page_id": page(h["warc-record-id"]), "url": _unfold(h["warc-target-uri"]) if "warc-target-uri" in h else None,
            "payload_bytes": int(length[0]), "payload_digest": digest.removeprefix("sha256:"),
            "record_type": h["warc-type"], "refers_to": page(h["warc-refers-to"]) if revisit else None,
            "payload": None if revisit else payload}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(archive: bytes):
    """(dictionary or None, iterator of (offset, record bytes)) of an archive."""
    import zstandard

    at, dictionary = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        if len(archive) < 8 + size:
            raise ValueError("dictionary frame is cut")
        dictionary = archive[8:8 + size]
        if dictionary[:4] == ZSTD_MAGIC:  # a dictionary may itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        at = 8 + size

    def records(at):
        loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompressor = zstandard.ZstdDecompressor(dict_data=loaded)
        view = memoryview(archive)
        while at < len(archive):
            if view[at:at + 4] != ZSTD_MAGIC:
                raise ValueError(f"no frame at offset {at}")
            one = decompressor.decompressobj()
            out = one.decompress(view[at:])
            if not one.eof:
                raise ValueError(f"frame at offset {at} is cut")
            yield at, out
            at = len(archive) - len(one.unused_data)
    return dictionary, records(at)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; empty if there are too few."""
    import zstandard

    rows = pages.select(F.substring(F.col("html").cast("string"), 1, 8192).alias("html")).where("html is not null") \
        .take(DICTIONARY_PAGES)
    samples = [r["html"].encode("utf-8") for r in rows if r["html"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): what each page's record says."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = materialize(
        rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_revisit)).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last").select("digest", "first"), "repeated-payloads")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def _writer(folder: str, dictionary: bytes, archive_bytes: int):
    def task(batches):
        import zstandard

        fs, path = _filesystem(folder)
        loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded)
        buf, records = io.BytesIO(), 0

        def close():
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name + ".part", compression=None) as out:
                out.write(dictionary_frame(dictionary))
                out.write(buf.getbuffer())
            fs.move(name + ".part", name)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([records], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(5)]):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                buf.write(compressor.compress(record_bytes(page_id, url, html.encode("utf-8"), digest, refers_to)))
                records += 1
                if buf.tell() >= archive_bytes:
                    yield close()
                    buf, records = io.BytesIO(), 0
        if records:
            yield close()
    return task


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' records; the manifest (archive, records), itself stored."""
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    done = plan_records(pages).mapInArrow(
        _writer(folder, train_dictionary(pages), archive_bytes), "archive string, records long")
    return materialize(done, "archives")


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "payload binary")


def _reader(with_payload: bool):
    def task(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _filesystem(name)
                with fs.open_input_stream(path, compression=None) as f:
                    content = f.read()
                rows, size = [], 0
                _, records = frames(content)
                for at, raw in records:
                    try:
                        row = parse_record(raw)
                    except ValueError as error:
                        raise ValueError(f"{name} at offset {at}: {error}") from error
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(raw)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return task


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The validated records of the archives (full paths) that ``manifest`` lists,
    about one archive of bounded size a task."""
    return (manifest.select("archive").repartition(max(1, manifest.count()), "archive")
            .mapInArrow(_reader(with_payload), _READ))


def archive_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
