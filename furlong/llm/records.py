"""Operator 7: token ids as length-delimited binary records with an offset index.

A shard is a sequence of records. Each is framed as

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

all little-endian, where mask(c) = ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32 of zlib's crc32.
A payload is: int64 document id, uint8 width of an id in bytes (2 if all ids of the vocabulary fit
in 16 bits, else 4), then the ids. The index, a Parquet table, has a row for each record with its
shard, offset and number of ids, so that a reader can take records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from furlong.llm.shared import filesystem, new_folder
from furlong.llm.tokenize import encoder

INDEX = "doc_id long, shard long, record long, offset long, n_tokens long"
#: Stands for a null doc_id in a payload.
NO_ID = -(2**63)


def masked(data: bytes) -> int:
    """The masked checksum of ``data``."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the next record's place; ValueError if a checksum fails."""
    (size,), (crc,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    if masked(data[at : at + 8]) != crc:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + size


def serialize(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qB", doc_id, width) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def width_of(tokenizer: str, end_id: int) -> int:
    """Bytes that every id of the tokenizer's vocabulary, and ``end_id``, fits in."""
    return 2 if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write all documents in ascending doc_id order below ``folder``; return the index, read back.

    A shard is one range of doc_id. A task writes under a name of its own and renames when done, so a
    repeated or killed task leaves no half shard. Null texts are empty (only the end id); documents
    with a null doc_id come first; rows with equal doc_id keep a fixed order by text. A text may be
    of any length: a record's length has 64 bits. Columns other than doc_id and text are ignored.
    """
    width = width_of(tokenizer, end_id)

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, encode = TaskContext.get(), encoder(tokenizer).encode
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        number = context.partitionId()
        own, record, at = f"{path}/.shard-{number:06d}-{context.taskAttemptId()}", 0, 0
        out = None
        for batch in batches:
            out = out or fs.open_output_stream(own)
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encode([t or "" for t in batch["text"]]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                data = frame(serialize(NO_ID if pd.isna(doc_id) else int(doc_id), ids, width))
                out.write(data)
                rows.append((doc_id, number, record, at, len(ids)))
                record, at = record + 1, at + len(data)
            frame_ = pd.DataFrame(rows, columns=["doc_id", "shard", "record", "offset", "n_tokens"])
            yield frame_.astype({"doc_id": "Int64"})
        if out:
            out.close()
            fs.move(own, f"{path}/shard-{number:06d}.rec")

    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(shard, INDEX)
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Read every record of the shards: doc_id, start (ids before it in the whole corpus), ids' count and crc32.

    The index gives each shard's number of ids; their running sum (a row a shard) is where it starts.
    """
    shards = spark.read.schema(INDEX).parquet(f"{folder}/index").groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("records"))
    shards = shards.withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, count, start in zip(batch["shard"], batch["records"], batch["base"], strict=True):
                fs, path = filesystem(folder)
                rows = []
                with fs.open_input_stream(f"{path}/shard-{number:06d}.rec") as f:
                    for _ in range(count):
                        head = f.read(12)
                        rest = f.read(struct.unpack_from("<Q", head)[0] + 4)
                        doc_id, ids = deserialize(unframe(head + rest, 0)[0])
                        rows.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                    if f.read(1):
                        raise ValueError(f"shard {number} has more records than its index")
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    spread = spark.sparkContext.defaultParallelism * 4
    return shards.repartition(spread, "shard").mapInPandas(records, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """The records of some rows of the index (shard, offset, any others), in whatever order and tasks they are in.

    This is how a shuffled epoch is read: ``read_at(index.repartition(n, F.rand(seed)), folder)``.
    Returns shard, offset, doc_id and ids. Each task keeps one shard open and reads its rows of a
    batch by ascending offset; a damaged record raises ValueError.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        for batch in batches:
            rows = {}
            for number, part in batch.groupby("shard"):
                with fs.open_input_file(f"{path}/shard-{number:06d}.rec") as f:
                    for i, offset in part["offset"].sort_values().items():
                        f.seek(offset)
                        head = f.read(12)
                        doc_id, ids = deserialize(unframe(head + f.read(struct.unpack_from("<Q", head)[0] + 4), 0)[0])
                        rows[i] = (number, offset, None if doc_id == NO_ID else doc_id, ids.astype("int64"))
            out = pd.DataFrame([rows[i] for i in batch.index], columns=["shard", "offset", "doc_id", "ids"])
            yield out.astype({"doc_id": "Int64"})

    return index.select("shard", "offset").mapInPandas(fetch, "shard long, offset long, doc_id long, ids array<long>")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and return what the files hold."""
    folder = new_folder(docs.sparkSession, "records")
    write(docs, tokenizer, end_id, folder)
    return read(docs.sparkSession, folder)
