"""Encoding whole texts with a public tokenizer, one encoding for each distinct chunk of text."""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np

#: Most chunks that a Python worker remembers.
CHUNKS = 800_000


class ChunkEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those
    of its chunks between blanks and line ends. Each distinct chunk is encoded once and kept (at
    most ``limit`` chunks; then the table starts anew).
    """

    def __init__(self, path: str, limit: int = CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.words = Tokenizer(self.tokenizer.model)
        # For lower-case words between blanks the normalizer and the splitting pattern have nothing to do.
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ids = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(ids.values()) + 1, bool)
        self.is_end[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used, self.rows = np.zeros(1 << 18, np.uint32), 0, 1

    def _learn(self, new: list[str]) -> None:
        """Encode chunks. Plain words, with or without a last stop or comma, go many at a time."""
        plain, spelled, ends, other = [], [], [], []
        for chunk in new:
            stem = chunk[:-1] if chunk[-1] in ".," else chunk
            low = stem.lower()
            if low.isalpha() and (chunk.isascii() or ("\u03a3" not in chunk and is_normalized("NFC", chunk))):
                plain.append(chunk)
                spelled.append(low if stem is chunk else f"{low} {chunk[-1]}")
                ends.append(1 if stem is chunk else 2)
            else:
                other.append(chunk)
        if plain:
            joined = [" ".join(spelled[i : i + 500]) for i in range(0, len(spelled), 500)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.words.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
            last = np.flatnonzero(self.is_end[ids]) + 1
            upto = np.cumsum(ends)
            if len(last) == upto[-1]:
                self._add(plain, np.diff(last[upto - 1], prepend=0), ids)
            else:
                other = new
        if other:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self._add(other, np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), np.uint32))

    def _add(self, chunks: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = self.rows
        while first + len(chunks) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.start[first : first + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(chunks)] = sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.at.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.used, self.rows = self.used + len(ids), first + len(chunks)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        batch: list[list[str]] = []
        n = 0
        for text in texts:
            batch.append(text.replace("\n", " ").split(" "))
            n += len(batch[-1])
            if n > 200_000:
                out += self._encode(batch, n)
                batch, n = [], 0
        return out + (self._encode(batch, n) if batch else [])

    def _encode(self, batch: list[list[str]], n: int) -> list[np.ndarray]:
        chunks = list(chain.from_iterable(batch))
        index = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, n)
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            new = {chunks[i] for i in missing}
            if len(self.at) + len(new) > self.limit and len(self.at) > 1:
                self._clear()
                new, missing = set(chunks) - {""}, range(n)
            self._learn(list(new))
            index[missing] = np.fromiter((self.at[chunks[i]] for i in missing), np.int64, len(missing))
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        ids = self.pool[np.repeat(self.start[index] - (ends - sizes), sizes) + np.arange(total)]
        texts = np.cumsum([len(words) for words in batch])
        return np.split(ids, ends[texts - 1][:-1])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The Python worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
