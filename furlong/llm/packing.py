"""Operator 9: packs tokenized documents into fixed windows by minimum bin slack.

A document is cut into pieces of the window's size and a remainder. The histogram of piece lengths
(at most ``window`` numbers, whatever the corpus) is what the packing plan needs: a subset-sum
dynamic program over bitsets picks the multiset of lengths that fills a window closest to its
capacity, backtracking gives the count of each length, and the pattern is repeated as often as the
counts allow. Executors then give each piece the next place of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from furlong.llm.shared import broadcast_if_small, written
from furlong.llm.tokenize import encoder

WINDOW = 4096
#: Pieces of one length that are numbered together; more of them are dealt to several tasks.
SHARE = 2_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (with ``end_id`` last) into pieces of at most ``window`` ids.

    A null text is an empty one: its only id is ``end_id``. ``with_ids`` adds the piece's ids as an
    array, for writing sequences. Columns other than doc_id and text are ignored.
    """
    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encode([t or "" for t in batch["text"]]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype("int64")] if with_ids else [])))
            out = pd.DataFrame(rows, columns=schema.names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths, the longest one included, whose sum is nearest to ``window`` from below.

    Bit s of the bitset says that some choice sums to s. A length's count is split into powers of
    two, so that each step is one shift; the bitsets before each step allow backtracking.
    """
    longest = max(counts)
    room = window - longest
    chosen = {longest: 1}
    reach, steps, mask, full = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length if length <= room else 0)
        times = 1
        while left and not reach & full:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> pd.DataFrame:
    """Patterns for all pieces: for each length of each pattern the ranks it takes and where they go.

    A pattern uses up at least one length, so the plan's size is bounded by the window's, not by the
    number of pieces.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        chosen = best_fill(counts, window)
        times = min(counts[k] // c for k, c in chosen.items())
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * times
            counts[length] -= each * times
            if not counts[length]:
                del counts[length]
            offset += length * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "each", "sequence_id", "offset"]).sort_values(["length", "first_rank"])


def place(cut: DataFrame, window: int = WINDOW, planned: Callable[[dict[int, int], int], pd.DataFrame] = plan) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``, as ``planned`` lays the lengths out. Sequences are gapless from offset 0.

    Pieces of one length are numbered in salted shares, one for each ``SHARE`` pieces, whose offsets
    come from the shares' sizes; so a length that a third of all pieces have is spread over as many
    tasks as it needs. Which share has how many is a table of at most ``window`` rows and one for
    each ``SHARE`` pieces.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    spark = cut.sparkSession
    salts = spark.createDataFrame([(k, 1 + n // SHARE) for k, n in counts.items()], "length long, _salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), "_salts"))
    shares = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    shares = broadcast_if_small(written(shares.select("length", "_salt", "_before"), "shares"))
    todo = planned(counts, window)
    by = {k: g.drop(columns="length").to_numpy() for k, g in todo.groupby("length")}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, rows in batch.groupby("length").indices.items():
                rank, (first, each, base, at) = batch["_rank"].to_numpy()[rows], by[length].T
                k = np.searchsorted(first, rank, "right") - 1
                nth = rank - first[k]
                sequence[rows] = base[k] + nth // each[k]
                offset[rows] = at[k] + nth % each[k] * length
            yield batch.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    ranked = (
        salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")))
        .join(shares, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .select(*cut.columns, "_rank")
    )
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "_rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(assign, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row a piece, each id in exactly one piece.

    Nulls: a null text packs as its end id alone; a null doc_id is kept. Rows with the same doc_id
    are packed each on its own. A text of any length is cut into as many pieces as it needs; columns
    other than doc_id and text are ignored. An empty table gives no rows. Texts are encoded once; the pieces'
    table is written to the shared folder before it is counted and placed.
    """
    return place(written(pieces(docs, tokenizer, end_id, window, with_ids), "pieces"), window)
