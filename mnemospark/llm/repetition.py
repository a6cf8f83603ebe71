"""Quality rules by suffix-array repetition inside each document.

The words of a batch of documents become integers; one suffix array covers the batch, documents first, by prefix
doubling that goes on only for suffixes that still tie. The ranks of each doubling step give the longest common prefix
(LCP) of neighbours. A word is covered by a repeat of at least L words exactly if some suffix that starts at or before
it has an LCP of at least L with a neighbour and reaches it: the union of all LCP intervals' spans, and so of all
maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, span_hashes, word_spans

#: Characters counted as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The method's limits: repeats of at least so many words count; share of words they cover; longest repeat in words.
MIN_REPEAT = 10
MAX_COVERED = 0.15
MAX_LONGEST = 100

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def neighbour_lcp(words: np.ndarray, doc: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix that its suffix shares with another suffix of its document.

    ``words``: integer per position; ``doc``: its document; ``doc_end``: where that document ends.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    order = np.lexsort((words, doc))
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    at = np.flatnonzero(new)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels = [rank.copy()]
    tied = np.ones(n, bool)
    tied[at[np.diff(np.append(at, n)) == 1]] = False
    active, step = order[tied], 1
    while len(active):
        ahead = active + step
        inside = ahead < doc_end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        head = np.ones(len(active), bool)
        head[1:] = first[1:] != first[:-1]
        split = head.copy()
        split[1:] |= second[1:] != second[:-1]
        heads, splits = np.flatnonzero(head), np.flatnonzero(split)
        base = np.repeat(heads, np.diff(np.append(heads, len(active))))
        sizes = np.diff(np.append(splits, len(active)))
        rank[active] = first + (np.repeat(splits, sizes) - base)
        active = active[np.repeat(sizes, sizes) > 1]
        levels.append(rank.copy())
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    keep = levels[0][left] == levels[0][right]
    left, right, slot = left[keep], right[keep], np.flatnonzero(keep)
    length = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        fits = (a < doc_end[left]) & (b < doc_end[right])
        same = fits & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        # a rank of level k stands for 2^k words, or for all that is left of a document, which only one suffix has
        length += same.astype(np.int64) << k
    between = np.zeros(n + 1, np.int64)
    between[slot + 1] = length
    out = np.empty(n, np.int64)
    out[order] = np.maximum(between[:-1], between[1:])
    return out


def covered_words(lengths: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Per document, the number of words in spans [i, i + lengths[i]) with lengths[i] >= least."""
    n = len(lengths)
    long = np.flatnonzero(lengths >= least)
    change = np.zeros(n + 1, np.int64)
    change[long] = 1
    np.add.at(change, long + lengths[long], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:n]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def rule_counts(data: np.ndarray, offsets: np.ndarray, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of a batch of texts, one value per text."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    lead = (data & 0xC0) != 0x80
    spaces = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    # lines: cut at \n and at the ends of texts; those with a word count, copies within a text are duplicates
    cut = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_row + 1])
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10))
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[wordy], line_end[wordy], line_row[wordy]
    hashed = span_hashes(data, line_start, line_end)
    by = np.lexsort((hashed, line_row))
    again = np.zeros(len(by), bool)
    again[1:] = (hashed[by[1:]] == hashed[by[:-1]]) & (line_row[by[1:]] == line_row[by[:-1]])
    # repeats
    words = np.unique(span_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64)
    doc = np.repeat(np.arange(rows), n_words)
    lengths = neighbour_lcp(words, doc, first[1:][doc] if len(doc) else doc)
    longest = np.zeros(rows, np.int64)
    full = n_words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(lengths, first[:-1][full])
    return {
        "n_words": n_words,
        "word_chars": per_row(lead & ~spaces),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[by[again]], minlength=rows),
        "n_repeat_words": covered_words(np.where(lengths >= WINDOW, WINDOW, 0), first, WINDOW),
        "n_covered": covered_words(lengths, first, least),
        "longest_repeat": longest,
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


def judge_repetition(docs: DataFrame, least: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Per document the counts, ``base_failed`` and ``kept``.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed,
    repeats of at least ``least`` words cover at most ``max_covered`` of the words, and none is longer than
    ``max_longest`` words. Null text is empty (and fails). Rows stay in place: no shuffle, whole texts, one at least
    per step of about 2 MB; other columns are not read, repeated ids give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                c = rule_counts(data, offsets, least)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                kept = ~failed & (c["n_covered"] <= max_covered * c["n_words"]) & (c["longest_repeat"] <= max_longest)
                arrays = [pa.array(v.astype(np.int64)) for v in c.values()] + [pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *arrays], names=["doc_id", *c, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
