"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A text is cut at the added special tokens, then by the pre-tokenizer's pattern; the symbols of each piece form a
doubly linked list and a heap gives the lowest-rank adjacent pair (leftmost on ties) until none is left. The count is
the number of initial symbols minus the number of merges. Pieces repeat a lot, so their counts are kept in a bounded
table per worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks

#: The pre-tokenizer's pattern of byte-level vocabularies (a fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 400_000
#: Longer pieces are merged anew each time, so that the tables stay small.
KEPT_LENGTH = 48

_COUNTERS: dict[str, "MergeCounter"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of texts for one byte-level vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer or prefix space are handled")
        symbols = byte_symbols()
        vocab = model["vocab"]
        self.first = [vocab.get(symbols[b], -1) for b in range(256)]
        # pair of ids -> rank and merged id, both packed in one integer
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges of one piece."""
        first = self.first
        ids = [first[b] for b in piece]
        n = left = len(ids)
        if n < 2:
            return n
        get = self.pairs.get
        # heap entries are rank and position of the left symbol in one integer: lowest rank first, then leftmost
        heap = [(found >> 32) << 32 | i for i in range(n - 1) if (found := get(ids[i] << 32 | ids[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            found = get(ids[i] << 32 | ids[j])
            if found is None or found >> 32 != entry >> 32:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, _ = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (found := get(new << 32 | ids[k])) is not None:
                    push(heap, (found >> 32) << 32 | i)
            h = before[i]
            if h >= 0 and (found := get(ids[h] << 32 | new)) is not None:
                push(heap, (found >> 32) << 32 | h)
        return left

    def _new(self, piece: str) -> int:
        """The count of a piece that the young table lacks; what is in use moves over from the older one."""
        n = self.older.get(piece)
        if n is None:
            n = self.count_piece(piece.encode())
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.older, self.kept = self.kept, {}
            self.kept[piece] = n
        return n

    def _plain(self, text: str) -> int:
        total = 0
        for piece in self.pieces.findall(text):
            n = self.kept.get(piece)
            total += self._new(piece) if n is None else n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it counts as one token, as the library has it by default."""
        if self.special is None:
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


def counter(path: str) -> MergeCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def vocabulary_path(name: str) -> str:
    """Where this machine holds a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. Null text is empty: no bytes, no tokens.

    ``vocabulary`` is a public file's name, or a path where it holds a slash. Each executor opens its own copy. Rows
    stay where they are read: no shuffle, memory by batch, repeated ids give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary)).count
        for batch in batches:
            for rows, _, offsets in chunks(batch):
                n = np.array([count(t) if t else 0 for t in rows.column(1).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
