"""Web archives (WARC/1.1) in per-record Zstandard frames with a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every
record is one frame of its own, so records can be read one by one. The writer
makes a record per page and a revisit record for all but one of the pages with equal
payloads. The reader takes whole archives from Spark's binary source (any store
Spark reads), loads the dictionary, walks the frames, decodes each and checks
headers, lengths and digests; anything wrong raises ValueError with file and place.

Tasks write archives of about ARCHIVE_BYTES in a fixed order under fixed names, first
to a temporary name: a repeated task replaces its own files.

Defined results: null html is an empty payload; null urls have no target header; null
ids none either and stay null; of equal payloads the largest id (all rows with it) is the
response; without pages there is no archive and reading gives no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordergate.llm.common import new_folder, new_path, store

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_PAGES, SAMPLE_BYTES = 400, 16 << 10  # what the dictionary is trained on
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit holds the HTTP head only."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        # Header values hold no control characters or white space.
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    head += [("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("Content-Type", "application/http; msgtype=response"),
             ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a name: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]
    if missing:
        raise ValueError(f"missing headers {missing}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {headers['content-length']}, but the block has {len(rest) - 4} bytes")
    block = rest[:-4]
    if headers["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if headers.get("warc-payload-digest") not in (None, "sha1:" + base32_sha1(payload)):
            raise ValueError("the payload does not have the digest of its header")
    return headers, block


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at ``at``, by its block headers."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            header = int.from_bytes(data[end:end + 3], "little")
            if end + 3 > len(data) or header >> 1 & 3 == 3:
                raise IndexError
            end += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)  # a run is stored as one byte
            if header & 1:
                break
        end += 4 * (flags >> 2 & 1)
    except IndexError:
        end = len(data) + 1
    if end > len(data):
        raise ValueError("the archive ends within a frame")
    return end


def load_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of a leading frame; it may itself be compressed."""
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompress(data)
    return zstandard.ZstdCompressionDict(data) if data else None


def read_archive(content: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record."""
    data, at, decoder = memoryview(content), 0, None
    try:
        while at < len(data):
            if at + 8 > len(data):
                raise ValueError("the archive ends within a frame")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                if at + 8 + size > len(data):
                    raise ValueError("the archive ends within a skippable frame")
                if magic == DICTIONARY_MAGIC and at == 0:
                    dictionary = load_dictionary(bytes(data[8:8 + size]))
                    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else None
                at += 8 + size
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("no Zstandard frame here")
            decoder = decoder or zstandard.ZstdDecompressor()
            end = frame_end(data, at)
            yield parse_record(decoder.decompress(data[at:end]))
            at = end
    except (ValueError, zstandard.ZstdError) as e:
        raise ValueError(f"{name} at byte {at}: {e}") from e


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample pages; with too few to train on, their plain bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _samples(rows: DataFrame) -> list[bytes]:
    """The heads of the SAMPLE_PAGES pages with the smallest id hashes: the hashes are
    picked first, so no task sends more than that many numbers or heads."""
    rank = F.xxhash64("page_id")
    last = rows.select(rank.alias("h")).orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return []
    found = rows.where(rank <= F.lit(last)).select(F.substring("payload", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()
    return sorted(bytes(r[0]) for r in found if r[0])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages below ``folder`` (a URI that all executors reach); returns
    (archive, records). Payloads from ``least_bytes`` on are stored once."""
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    copies = store(rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
                   .agg(F.count("*").alias("k"), F.max("page_id").alias("refers_to")).where("k > 1").drop("k"), "copies")
    dictionary = train(_samples(rows))

    def run(batches):
        from pyarrow.fs import FileSystem
        fs, path = FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        loaded = load_dictionary(dictionary)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_checksum=True, write_content_size=True)
        made, out, count, names = [], None, 0, None

        def close():
            nonlocal out
            if out:
                out.close()
                fs.move(names[1], names[0])
                made.append((names[0], count))
            out = None

        for batch in batches:
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    final = f"{path}/part-{part:06d}-{len(made):04d}.warc.zst"
                    names, count = (final, f"{path}/_attempt-{attempt}-{len(made)}"), 0
                    out = fs.open_output_stream(names[1], compression=None)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                revisit = refers_to is not None and refers_to != page_id
                out.write(coder.compress(record(page_id, url, body, refers_to, revisit)))
                count += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"archive": [m[0] for m in made], "records": [m[1] for m in made]},
                                         pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    folder = new_folder(pages.sparkSession, folder)
    joined = (rows.join(copies, "digest", "left").sortWithinPartitions("page_id", "digest")
              .select("page_id", "url", "payload", "refers_to"))
    return store(joined.mapInArrow(run, "archive string, records bigint"), "manifest")


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, with ``with_payload``, the payload (null for revisits)."""
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for h, block in read_archive(content.as_buffer(), path.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    response = h["warc-type"] == "response"
                    rows.append((h.get("x-page-id"), h.get("warc-target-uri"),
                                 len(payload) if response else int(h["x-payload-length"]),
                                 h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], h.get("x-refers-to-page-id"),
                                 payload if response and with_payload else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    out = files.mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, "
                                "refers_to string, payload binary")
    out = out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    return out if with_payload else out.drop("payload")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back (no payloads)."""
    folder = new_path(pages.sparkSession, "warc")
    write_archives(pages, folder, id_col, url_col, html_col)
    return read_archives(pages.sparkSession, folder, pages.schema[id_col].dataType.simpleString(), with_payload=False)
