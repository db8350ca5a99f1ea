"""Operator 4: WARC archives compressed record by record with a Zstandard dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, so that it
can be read alone; then each record is a frame of its own. A page whose payload another page has
too becomes a ``revisit`` record that refers to the page with the smallest id. A task closes an
archive at ``ARCHIVE_BYTES`` and starts the next, each with a dictionary of its own records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.shared import broadcast_if_small, filesystem, new_folder, written

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An archive is closed once it has this many bytes of records; so much of them is held in memory.
ARCHIVE_BYTES = 32 << 20
#: The most bytes of a dictionary, at most a sixteenth of its archive; the slices of records that it is trained on,
#: evenly over the whole archive, and how many times its size they have in sum.
DICTIONARY_BYTES, SLICE_BYTES, TIMES = 65_536, 4_096, 100
#: Lengths of the segments that training looks for and of those that it hashes.
SEGMENT, HASHED = 200, 8
#: Most payloads with copies that are sent to all executors, and the number of copies from which a payload is hot.
MOST_SENT, HOT = 250_000, 10_000
LEVEL = 3
MANIFEST = "archive string, records long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record; a revisit has no payload but its digest and size."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = HTTP if revisit else HTTP + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like ``samples``; their raw end if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=HASHED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Pieces:
    """Reads a stream up to a mark or by a number of bytes; what is left over waits for the next call."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.waiting = stream, bytearray()

    def upto(self, mark: bytes) -> bytes | None:
        """What is before the next mark, which is dropped; None at the end of the stream."""
        seen = 0
        while (end := self.waiting.find(mark, seen)) < 0:
            seen = max(0, len(self.waiting) - len(mark) + 1)
            if not (data := self.stream.read(1 << 16)):
                if self.waiting:
                    raise ValueError("a record's headers don't end")
                return None
            self.waiting += data
        return self.exactly(end + len(mark))[:end]

    def exactly(self, size: int) -> bytes:
        while len(self.waiting) < size:
            if not (data := self.stream.read(1 << 20)):
                raise ValueError("a record is cut off")
            self.waiting += data
        out = bytes(self.waiting[:size])
        del self.waiting[:size]
        return out


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; one record at a time is in memory."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't start with its dictionary")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    plain = Pieces(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True))
    while (head := plain.upto(b"\r\n\r\n")) is not None:
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, plain.exactly(int(headers["Content-Length"]) + 4)[:-4]


def samples(records: list[bytes], most: int) -> list[bytes]:
    """Slices of all ``records`` of an archive, evenly apart, of about ``most`` bytes in sum."""
    places = [(i, at) for i, r in enumerate(records) for at in range(0, len(r), SLICE_BYTES)]
    step = max(1, -(-sum(map(len, records)) // max(most, 1)))
    return [records[i][at : at + SLICE_BYTES] for i, at in places[::step]]


def pack(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> Iterator[bytes]:
    """The parts of an archive: its dictionary in a skippable frame, then a frame for each record."""
    size = min(dictionary_bytes, max(256, sum(map(len, records)) // 16))
    dictionary = build_dictionary(samples(records, TIMES * size), size)
    yield struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
    digested = zstandard.ZstdCompressionDict(dictionary)
    digested.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=digested)
    yield from map(packer.compress, records)


def with_first(pages: DataFrame, copied: DataFrame, most_sent: int = MOST_SENT, hot: int = HOT) -> DataFrame:
    """``pages`` with the smallest page_id of their payload (``first``) and whether others have it (``has_copies``).

    ``copied`` (_copied, first, _n), a written table, has the payloads with copies. It is sent to the pages if it has
    at most ``most_sent`` rows. Else only its hot payloads are, of which there is at most one in ``hot`` pages; pages
    of the others meet by a shuffle in groups of at most ``hot``, and pages of hot ones are dealt by their id.
    """
    sent = broadcast_if_small(copied, most_sent)
    if sent is not copied:
        return pages.join(sent, F.col("_sha1") == F.col("_copied"), "left").withColumn("has_copies", F.col("_copied").isNotNull()).drop("_copied", "_n")
    hot_ones = broadcast_if_small(copied.where(F.col("_n") > hot).select(F.col("_copied").alias("_hot"), F.col("first").alias("_hot_first")), most_sent)
    others = copied.where(F.col("_n") <= hot).select("_copied", "first")
    told = pages.join(hot_ones, F.col("_sha1") == F.col("_hot"), "left")
    own = F.concat_ws(" ", F.lit("hot"), F.col("page_id").cast("string"), F.rand(7).cast("string"))
    told = told.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_sha1")).otherwise(own))
    told = told.join(others, F.col("_key") == F.col("_copied"), "left")
    has_copies = F.col("_hot").isNotNull() | F.col("_copied").isNotNull()
    first = F.when(F.col("_hot").isNotNull(), F.col("_hot_first")).otherwise(F.col("first"))
    return told.select("page_id", "url", "html", "_sha1", first.alias("first"), has_copies.alias("has_copies"))


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, dictionary_bytes: int = DICTIONARY_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of about ``archive_bytes`` below ``folder``; return the manifest (archive, records), read back.

    Null html is an empty payload; null page_ids come after all others; rows repeated with the same
    page_id and payload are each written as that page's response. Payloads are equal if their SHA-1 is,
    as the format has it. A page may be of any length; columns other than page_id, url and html are
    ignored. An archive's name has the attempt that wrote it, and it is renamed to it when whole: the
    manifest, of finished attempts only, says which archives count. Payloads aren't shuffled unless so many have
    copies that not even the list of these can be sent (see ``with_first``).
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("_sha1", F.sha1(F.col("html").cast("binary")))
    copied = pages.where(F.octet_length("html") >= min_revisit_bytes).groupBy(F.col("_sha1").alias("_copied")).agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    joined = with_first(pages, written(copied, "copied"))
    revisit = F.col("has_copies") & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        done: list[tuple[str, int]] = []

        def close(records: list[bytes]) -> None:
            name = f"pages-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}.warc.zst"
            with fs.open_output_stream(f"{path}/.{name}", compression=None) as out:
                for part in pack(records, dictionary_bytes):
                    out.write(part)
            fs.move(f"{path}/.{name}", f"{path}/{name}")
            done.append((name, len(records)))

        records, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to, again in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                records.append(record(page_id, url, html.encode(), refers_to, again))
                size += len(records[-1])
                if size >= archive_bytes:
                    close(records)
                    records, size = [], 0
        if records:
            close(records)
        yield pd.DataFrame(done, columns=["archive", "records"]).astype({"archive": object, "records": "int64"})

    marked.mapInPandas(archive, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of all archives that the manifest names, each payload checked against its digest."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, count in zip(batch["archive"], batch["records"], strict=True):
                fs, path = filesystem(folder)
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in records_of(stream):
                        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head["X-Payload-Bytes"])
                        payload = block[len(HTTP) :]
                        if kind == "response" and (digest(payload) != said or len(payload) != size):
                            raise ValueError(f"a payload of {name} doesn't have its digest")
                        ids = [head.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        rows.append((int(ids[0]) if ids[0] else None, size, said, kind, int(ids[1]) if ids[1] else None))
                if len(rows) != count:
                    raise ValueError(f"{name} has {len(rows)} records, its manifest {count}")
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return manifest.repartition(spark.sparkContext.defaultParallelism * 4, "archive").mapInPandas(pages, PAGES)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in a new folder of the shared store and return what the archives hold."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
