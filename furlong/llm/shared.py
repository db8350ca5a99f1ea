"""What several text operators need: the shared folder, the held-out split, word caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most words that a Python worker remembers in a table; beyond it the table starts anew.
CACHE_WORDS = 150_000
#: Most ids (of 8 bytes) that are sent to all executors; some 30 MB as a hash table.
MAX_BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, if the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='furlong-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of short rows, marked for broadcast if it has at most ``most`` of them.

    With more rows it stays as it is, and Spark shuffles both sides of its joins.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of all documents that no model learns from: crc32(id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


#: The table of the latest model in a Python worker; workers outlive the tasks of a query.
_CACHES: dict[str, WordTable] = {}


def worker_table(key: str, make: Callable[[], WordTable]) -> WordTable:
    """The worker's table under ``key``; one of another key is forgotten."""
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = make()
    return _CACHES[key]


class WordTable:
    """A row of numbers for each word, computed once a word; sums of the rows over texts.

    Bounded: when more than ``limit`` words are known, all are forgotten.
    """

    def __init__(self, values: Callable[[list[str]], np.ndarray], columns: int, limit: int = CACHE_WORDS):
        self.values, self.columns, self.limit = values, columns, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, self.columns))

    def index(self, texts: list[list[str]]) -> np.ndarray:
        """Where the rows of all words of ``texts`` are, one after the other."""
        words = list(chain.from_iterable(texts))
        index = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            new = {words[i] for i in missing}
            if len(self.at) + len(new) > self.limit and self.at:
                self._clear()
                new, missing = set(words), range(len(words))
            new, first = list(new), len(self.at)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.values(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            index[missing] = np.fromiter((self.at[words[i]] for i in missing), np.int64, len(missing))
        return index

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """The sum of the rows of each text's words; zeros for a text without words."""
        out = np.zeros((len(texts), self.columns))
        sizes = np.array([len(words) for words in texts])
        if sizes.sum():
            full = np.flatnonzero(sizes)
            index = self.index(texts)
            out[full] = np.add.reduceat(self.rows[index], (np.cumsum(sizes) - sizes)[full])
        return out


def in_blocks(texts: Iterable[str], most: int = 1_000_000) -> Iterable[list[str]]:
    """``texts`` in lists of about ``most`` characters, in order."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block
