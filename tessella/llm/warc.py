"""WARC archives with embedded Zstandard dictionaries, written and read back.

Of pages with equal payloads of at least MIN_REVISIT bytes the one with the
smallest id becomes a response record and the others revisit it; smaller
payloads are all responses. Digests are grouped and joined as digests; only
then does a payload move, once.

Each task writes archives of its own: the first records, up to SAMPLE_BYTES,
train a Zstandard dictionary, which stands uncompressed in a leading skippable
frame (magic 0x184D2A5D), and every record is a frame of its own compressed with
it, so one record can be read without the rest. An archive is closed at
FILE_BYTES. Archives are written under a name of the attempt and then moved to
their final name, so a task that runs again replaces its own file.

Defined cases: a null page is an empty payload; a null url becomes urn:page:ID;
a null id is a record without one, never revisited by others unless all ids of
its group are null; repeated ids with equal payloads name each other's id, and
the rows of the smallest id are all responses; an empty table writes no
archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path, written

MIN_REVISIT = 100
DICT_BYTES, SAMPLE_BYTES, FILE_BYTES, LEVEL = 64 << 10, 4 << 20, 64 << 20, 3
# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the full payload's digest and length in its headers and no payload."""
    uri = url if url else f"urn:page:{page_id}"
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    own = hashlib.sha256(f"{page_id}|{uri}|{digest}".encode()).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:32]}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *[f"X-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)]
    head.append(f"Content-Length: {len(block)}")
    return CRLF.join(x.encode() for x in head) + 2 * CRLF + block + 2 * CRLF


def parsed(data: bytes) -> dict:
    """Headers of a record in lower case, and its payload."""
    head, _, rest = data.partition(2 * CRLF)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != 2 * CRLF or len(block) != int(fields["content-length"]):
        raise ValueError("a record's length doesn't hold")
    return fields | {"payload": block.partition(2 * CRLF)[2]}


def trained(samples: list[bytes]) -> bytes:
    """A dictionary from the samples; without enough of them, their raw bytes, which serve as one too."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def compressor(dictionary: bytes):
    import zstandard

    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **extra)


def writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        waiting: list[bytes] = []
        state = {"bytes": 0, "out": None, "packer": None, "records": 0, "size": 0, "raw": 0}

        def name(final: bool) -> str:
            return f"{root}/part-{task.partitionId():05d}-{len(done):04d}.warc.zst" + ("" if final else f".{task.taskAttemptId()}.tmp")

        def begin() -> None:
            dictionary = trained(waiting)
            state["out"], state["packer"] = store.open_output_stream(name(False), compression=None), compressor(dictionary)
            state["out"].write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            state["size"] = 8 + len(dictionary)
            for x in waiting:
                put(x)
            waiting.clear()
            state["bytes"] = 0

        def put(x: bytes) -> None:
            frame = state["packer"].compress(x)
            state["out"].write(frame)
            state["size"] += len(frame)
            state["records"] += 1
            state["raw"] += len(x)

        def end() -> None:
            if state["out"] is None and waiting:
                begin()
            if state["out"] is not None:
                state["out"].close()
                store.move(name(False), name(True))
                done.append((f"{folder}/{name(True).rsplit('/', 1)[1]}", state["records"], state["raw"]))
                state.update(out=None, records=0, size=0, raw=0)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                page_id, url, html, digest, kind, refers_to = row
                x = record(page_id, url, html.encode(), digest, kind, refers_to, date)
                if state["out"] is None:
                    waiting.append(x)
                    state["bytes"] += len(x)
                    if state["bytes"] >= SAMPLE_BYTES:
                        begin()
                else:
                    put(x)
                if state["size"] >= FILE_BYTES:
                    end()
        end()
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "records", "raw_bytes"])

    return run


def frames(stream) -> Iterator[bytes]:
    """The records of one archive, one at a time: the dictionary from the first frame, then a frame for each."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    dictionary = stream.read(size)
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    unpacker = zstandard.ZstdDecompressor(**extra)
    rest = b""
    while rest or (rest := stream.read(1 << 20)):
        one, out = unpacker.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def read(archives: DataFrame) -> DataFrame:
    """archives: a column path. One row per record; payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                out, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for data in frames(stream):
                        x = parsed(data)
                        kind, digest = x["warc-type"], x["warc-payload-digest"].removeprefix("sha256:")
                        payload = x["payload"] if kind == "response" else None
                        if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(x["x-payload-length"])):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        out.append((whole(x.get("x-page-id")), x["warc-target-uri"], kind, whole(x.get("x-refers-to-page-id")), int(x["x-payload-length"]), digest, payload))
                        size += len(data)
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    files = archives.select("path").distinct()
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def write(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives (at once) and returns their list: path, records, raw_bytes. folder: a URI that all executors share."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    folder = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    # digests that repeat, few and light; written, so that the join shuffles both sides anew and Spark can split a hot digest
    first = own.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = written(first, "digests")
    marked = own.join(first, "digest", "left")
    kind = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    rows = marked.select("page_id", "url", "html", "digest", kind.alias("kind"), "first")
    return written(rows.mapInArrow(writer(folder, date), "path string, records long, raw_bytes long"), "archives")
