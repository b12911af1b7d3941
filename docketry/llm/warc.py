"""Dictionary-compressed WARC archives: a writer and a reader.

A file starts with a skippable frame that holds a Zstandard dictionary, as the
format for compressed WARC files has it; then each record is a frame of its
own, compressed with that dictionary. The dictionary is trained on a bounded
sample of records as they are archived, headers included. Of records with equal
payloads of some length the one with the smallest id is written whole, the
others as revisits of it.

Every record has an id of its own: that of a row whose page id and payload
occur once follows from both, so that revisits can name it; any other is
random. A revisit of a page that occurs several times names the page alone.

Writers are tasks: each writes files of its own to the shared folder and hands
on their paths, so files of a lost or repeated task are never read.

Defined cases: a null payload counts as empty; a null URL gives a record
without target; line breaks in a URL are escaped; rows that repeat an id get
records of their own, of the same kind if their payloads are equal; a row
without an id is written whole; further columns are ignored; an empty table
gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import common, storage

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own: the page of a record, and the page whose payload a revisit repeats.
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
NAMES = uuid.UUID("8b8f6f0e-3f0c-5d43-9a55-0f5c2f0a7a11")

#: Bytes of a dictionary; records of the sample it is trained on and bytes of each.
DICTIONARY_SIZE, SAMPLE_ROWS, SAMPLE_BYTES = 64 << 10, 1000, 8 << 10
#: Smallest payload that is written once only; bytes of payload for each file.
REVISIT_FROM, FILE_BYTES = 100, 1 << 30
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def train(pages: DataFrame, payload_col: str = "html", id_col: str = "page_id", url_col: str | None = "url") -> bytes:
    """A dictionary from a sample of bounded size: records of the rows with the smallest hashes of their ids.

    A record of the sample has the beginning of a long payload only. Empty
    where the sample is too small to train on.
    """
    filled = pages.where(F.length(payload_col) > 0).withColumn("_hash", F.xxhash64(id_col))
    # The threshold comes from the ids alone; only rows below it bring their payloads.
    top = filled.select("_hash").orderBy("_hash").limit(SAMPLE_ROWS).agg(F.max("_hash")).first()[0]
    if top is None:
        return b""
    sample = filled.where(F.col("_hash") <= top).limit(SAMPLE_ROWS)
    cut = F.substring(payload_col, 1, SAMPLE_BYTES)
    url = F.substring(url_col, 1, SAMPLE_BYTES) if url_col else F.lit(None).cast("string")
    taken = sample.select(F.col(id_col).cast("long"), url, cut, F.sha2(payload_col, 256)).collect()
    records = [record("response", name, url, text.encode(), digest, None) for name, url, text, digest in taken]
    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def http_head(length: int) -> bytes:
    """The HTTP head of an archived page."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record_id(name: int, digest: str) -> str:
    """The id of the record of a page and payload that occur once."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{name} {digest}')}>"


def record(kind: str, name: int | None, url: str | None, payload: bytes, digest: str, original: int | None, single: bool = True, original_single: bool = True) -> bytes:
    """One WARC record; a revisit has the HTTP head alone.

    ``single``: page and payload occur once; ``original_single``: those of the record that is revisited do.
    """
    block = http_head(len(payload)) + (payload if kind == "response" else b"")
    own = record_id(name, digest) if single and name is not None else f"<urn:uuid:{uuid.uuid4()}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if name is not None:
        lines.append(f"{PAGE}: {name}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"{REFERS}: {original}"]
        if original_single:
            lines.append(f"WARC-Refers-To: {record_id(original, digest)}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """A compressed WARC file."""

    def __init__(self, path: str, dictionary: bytes, level: int = LEVEL):
        self.path, self.records, self.payload = path, 0, 0
        self.out = storage.create(path)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        if dictionary:
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def add(self, raw: bytes, payload: int) -> None:
        self.out.write(self.frames.compress(raw))
        self.records += 1
        self.payload += payload

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.path, self.records


def frames(source, known: zstandard.ZstdCompressionDict | None, held: bytes = b"") -> Iterator[bytes]:
    """The content of each frame of a stream that begins with ``held``."""
    context = zstandard.ZstdDecompressor(dict_data=known)
    while held := held or source.read(1 << 16):
        frame, pieces = context.decompressobj(), []
        while True:
            pieces.append(frame.decompress(held))
            if frame.eof:
                break
            held = source.read(1 << 16)
            if not held:
                raise ValueError("a frame is cut off")
        held = frame.unused_data
        yield b"".join(pieces)


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file; a frame holds one."""
    with storage.open_stream(path) as source:
        head, known = source.read(8), None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            known = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0]))
            head = b""
        for raw in frames(source, known, head):
            end = raw.index(b"\r\n\r\n")
            first, *lines = raw[:end].decode().split("\r\n")
            headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
            if not first.startswith("WARC/") or len(raw) != end + 8 + int(headers["content-length"]):
                raise ValueError(f"{path}: a frame that is not one record")
            yield headers, raw[end + 4 : -4]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dictionary: bytes | None = None, level: int = LEVEL, revisit_from: int = REVISIT_FROM, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row below ``folder``; (path, records) of every file."""
    common.scratch(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    known = train(rows, "payload", "id") if dictionary is None else dictionary
    digest = F.sha2("payload", 256).alias("digest")
    light = rows.where(F.col("id").isNotNull()).select("id", digest, (F.octet_length("payload") >= revisit_from).alias("large"))
    # One row for each page and payload, and how often they occur together.
    paired = common.cut(light.groupBy("digest", "id").agg(F.first("large").alias("large"), F.count(F.lit(1)).alias("n")), "warc-pages")
    first = paired.where("large").groupBy("digest").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    first = common.cut(first.select(F.col("digest").alias("_digest"), "first", "_k"), "warc-first")
    total = first.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    again = common.join_counted(paired.where("large"), first, {"digest": "_digest"}, "_k", total).where("id <> first.id")
    alone = F.lit(None).cast("long"), F.lit(None).cast("long")
    known_first = again.select("id", "digest", "n", F.col("first.id").alias("first"), F.col("first.n").alias("first_n"))
    # By id, not by payload: however many copies a payload has, their rows stay spread.
    noted = known_first.union(paired.where("n > 1").join(known_first.select("id", "digest").hint("merge"), ["id", "digest"], "left_anti").select("id", "digest", "n", *alone))
    noted = noted.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "n", "first", "first_n")
    planned = rows.withColumn("digest", F.sha2("payload", 256)).join(noted.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    planned = planned.select("id", "url", "payload", "digest", "first", F.coalesce(F.col("n") == 1, F.lit(True)).alias("single"), F.coalesce(F.col("first_n") == 1, F.lit(True)).alias("first_single"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in common.parts(batches, "payload"):
            for name, url, payload, digest, original, single, first_single in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None or writer.payload >= file_bytes:
                    if writer:
                        done.append(writer.close())
                    writer = Writer(f"{folder}/{uuid.uuid4().hex}.warc.zst", known, level)
                raw = payload.encode()
                writer.add(record("response" if original is None else "revisit", name, url, raw, digest, original, single, first_single), len(raw))
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    files = common.cut(planned.mapInArrow(run, "path string, records long"), "warc-files")
    for done in (paired, first):
        common.forget(files.sparkSession, done.cut_path)
    return files


def read(files: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of archives.

    A response's digest is computed from what was read and held against its
    header; a revisit's payload is null, its length and digest are of the full
    payload.
    """
    tasks = max(1, files.count())

    def number(field: str | None) -> int | None:
        return None if field is None else int(field)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                out: list[list] = [[] for _ in names]
                size = found = 0

                def made() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

                for headers, block in records(path):
                    end = block.index(b"\r\n\r\n") + 4
                    length = next(int(line[16:]) for line in block[:end].split(b"\r\n") if line.lower().startswith(b"content-length: "))
                    kind, digest, payload = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), None
                    if kind == "response":
                        payload = block[end:]
                        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    for column, value in zip(out, (number(headers.get(PAGE.lower())), headers.get("warc-target-uri"), length, digest, kind, number(headers.get(REFERS.lower())), payload and payload.decode())):
                        column.append(value)
                    size += len(block)
                    found += 1
                    if size > 4 << 20:
                        yield made()
                        out, size = [[] for _ in names], 0
                if found != expected:
                    raise ValueError(f"{path}: {found} records, not {expected}")
                if out[0]:
                    yield made()

    return files.select("path", "records").repartition(tasks).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
