"""Substring deduplication with compressed FM-indexes over shards.

Every window of L consecutive words has a smallest k-gram hash; equal windows have equal ones, so windows are dealt to
shards by it, as runs of consecutive windows that share one. Runs whose k-gram occurs once in the corpus cannot hold a
repeated window and go no further. Equal runs are kept once, with their number. Each shard builds an FM-index over its
runs and streams them through it: backward search over the wavelet matrix gives the matching statistics cut at L, and
a window is a repeat if the rows of its interval stand for two or more occurrences. A k-gram in very many contexts
would make one shard too large; the windows of its runs are single runs of their own, so equal ones still meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, chunks, gram_hashes, joined_words, materialize, sequence_hashes, span_hashes, text_buffers, word_count, word_spans
from .fmindex import FMIndex

WINDOW = 35
GRAM = 8
#: Runs are cut at so many windows, which bounds the steps of a search.
MOST_WINDOWS = 256
SHARD_WORDS = 150_000
#: A k-gram with more different runs than this is dealt to shards window by window, by the window's own hash.
HOT_RUNS = 20_000

KEYS = ["tkey", "tkey2"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with null texts emptied and a 96-bit key of the text: rows with one text share all decisions."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"text": text, "tkey": F.xxhash64(text), "tkey2": F.hash(text)})


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    now, size = x, 1
    while size * 2 <= width:
        now = np.minimum(now[: len(now) - size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def window_runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of consecutive windows with one smallest k-gram: row, start (word), windows, m, f (content), grams."""
    starts, ends, first = word_spans(data, offsets)
    n_windows = np.maximum(np.diff(first) - window + 1, 0)
    total = int(n_windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "windows": none, "m": none.view(np.uint64), "f": none.view(np.uint64), "grams": none}
    words = span_hashes(data, starts, ends)
    at = np.arange(len(words) - gram + 1)
    grams = gram_hashes(words, gram) if gram & (gram - 1) == 0 else sequence_hashes(words, at, at + gram)
    least = sliding_min(grams, window - gram + 1)
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    place = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    pos = place + first[:-1][row]
    m = least[pos]
    head = np.ones(total, bool)
    head[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    inside = np.arange(total) - np.repeat(heads, np.diff(np.append(heads, total)))
    heads = np.flatnonzero(inside % MOST_WINDOWS == 0)
    windows = np.diff(np.append(heads, total))
    begin = pos[heads]
    m = m[heads]
    span = windows + window - gram
    each = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span) + np.repeat(begin, span)
    same = np.add.reduceat((grams[each] == np.repeat(m, span)).astype(np.int64), np.cumsum(span) - span)
    f = sequence_hashes(words, begin, begin + windows + window - 1)
    return {"row": row[heads], "start": place[heads], "windows": windows, "m": m, "f": f, "grams": same}


def _emit_runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                r = window_runs(data, offsets, window, gram)
                who = pa.array(r["row"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1).take(who), rows.column(2).take(who), pa.array(r["start"].astype(np.int32)), pa.array(r["windows"].astype(np.int32)), pa.array(as_long(r["m"])), pa.array(as_long(r["f"])), pa.array(r["grams"].astype(np.int32))],
                    names=["tkey", "tkey2", "start", "windows", "m", "f", "grams"],
                )

    return run


def _cut_runs(window: int):
    """Rows (text, list of wanted runs) to one row for each run with its words; of hot runs to one for each window, with
    the run that it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                starts, ends, first = word_spans(data, offsets)
                joined, to, till = joined_words(data, starts, ends)
                raw = joined.tobytes()
                wanted = rows.column(1)
                held = wanted.flatten()
                row = np.repeat(np.arange(rows.num_rows), np.diff(wanted.offsets.to_numpy()))
                start, windows, m, f, times, hot = (held.field(k).to_numpy(zero_copy_only=False) for k in ("start", "windows", "m", "f", "times", "hot"))
                begin = first[:-1][row] + start
                # one entry for each run, or for each window of a hot one
                n = np.where(hot, windows, 1)
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                a = begin[of] + at
                b = a + np.where(hot[of], 1, windows[of]) + window - 1
                own = as_long(sequence_hashes(span_hashes(data, starts, ends), a, b)) if hot.any() else f[of]
                from_hot = hot[of]
                words = [raw[s:e].decode() for s, e in zip(to[a].tolist(), till[b - 1].tolist())]

                def only_hot(x: np.ndarray) -> pa.Array:
                    return pa.array(x, mask=~from_hot)

                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(from_hot, own, m[of])), pa.array(np.where(from_hot, own, f[of])), pa.array(times[of]), pa.array(words, pa.string()), only_hot(m[of]), only_hot(f[of]), only_hot(at.astype(np.int32))],
                    names=["m", "f", "times", "words", "hot_m", "hot_f", "at"],
                )

    return run


def repeated_windows(words: pa.ChunkedArray | pa.Array, times: np.ndarray, window: int) -> list[list[int]]:
    """For each run of a shard, [from, to, from, to, ...]: its word ranges that repeated windows cover.

    ``times`` is how often each run stands in the corpus.
    """
    data, offsets = text_buffers(words)
    starts, ends, first = word_spans(data, offsets)
    symbols = np.unique(span_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64) + 1
    sizes = np.diff(first)
    n = len(sizes)
    run = np.repeat(np.arange(n), sizes)
    text = np.zeros(len(symbols) + n, np.int64)
    text[np.arange(len(symbols)) + run] = symbols
    begin = first[:-1] + np.arange(n)
    index = FMIndex(text, int(symbols.max(initial=0)), window)
    owner = np.repeat(np.arange(n), sizes + 1)
    weight = np.concatenate([[0], np.cumsum(times[owner[index.release()]])])
    repeat = np.zeros(len(text) + 1, np.int64)
    for _, at, lo, hi in index.statistics(text, begin, begin + sizes):
        hit = at[weight[hi] - weight[lo] >= 2]
        np.add.at(repeat, hit, 1)
        np.add.at(repeat, hit + window, -1)
    inside = np.cumsum(repeat)[: len(text)] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    out: list[list[int]] = [[] for _ in range(n)]
    for k, x, y in zip(owner[a].tolist(), (a - begin[owner[a]]).tolist(), (b - begin[owner[a]]).tolist()):
        out[k] += [x, y]
    return out


def _search_shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        found = repeated_windows(table.column("words"), table.column("times").to_numpy(), window)
        hit = np.flatnonzero([bool(x) for x in found])
        return pa.table({"m": table.column("m").take(hit), "f": table.column("f").take(hit), "spans": pa.array([found[k] for k in hit], pa.list_(pa.int32()))})

    return run


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> tuple[DataFrame, DataFrame]:
    """``(tkey, tkey2, spans)`` for each distinct text of ``texts (text, tkey, tkey2)`` with a repeated window, and
    ``(tkey, tkey2, text)`` of all distinct texts that may hold one, these among them.

    spans is [from, to, from, to, ...] in words of that text; ranges may overlap.
    """
    runs = materialize(texts.select("text", *KEYS).mapInArrow(_emit_runs(window, gram), "tkey long, tkey2 int, start int, windows int, m long, f long, grams int"), "sub-runs")
    again = runs.groupBy("m").agg(F.sum("grams").alias("n")).filter("n >= 2").select("m")
    likely = materialize(runs.join(again, "m", "left_semi"), "sub-likely")
    distinct = likely.groupBy("m", "f").agg(F.count("*").alias("times"), F.min(F.struct(*KEYS, "start", "windows")).alias("at"))
    distinct = materialize(distinct.select("m", "f", "times", "at.*"), "sub-distinct")
    facts = distinct.agg(F.sum(F.col("windows") + (window - 1)), F.count("*")).first()
    shards = max(1, -(-int(facts[0] or 0) // SHARD_WORDS))
    hot = distinct.groupBy("m").count().filter(F.col("count") > hot_runs).select("m", F.lit(True).alias("hot"))
    any_hot = (facts[1] or 0) > hot_runs and hot.limit(1).count() > 0
    distinct = distinct.join(hot, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else distinct.withColumn("hot", F.lit(False))
    wanted = distinct.groupBy(*KEYS).agg(F.collect_list(F.struct("m", "f", "times", "start", "windows", "hot")).alias("runs"))
    # a text all of whose runs are cut out of other texts has no run of its own here; all its windows are repeats
    wanted = likely.select(*KEYS).distinct().join(wanted, KEYS, "left")
    # one copy of each text suffices to cut its runs out; this is the only time that all texts are shuffled
    single = texts.select("text", *KEYS).dropDuplicates(KEYS)
    searched = materialize(single.join(wanted, KEYS).select("text", "runs", *KEYS), "sub-searched")
    cut = searched.filter("runs is not null").select("text", "runs").mapInArrow(_cut_runs(window), "m long, f long, times long, words string, hot_m long, hot_f long, at int")
    pieces = cut.select("m", "f", "times", "words")
    if any_hot:
        cut = materialize(cut, "sub-cut")
        pieces = cut.groupBy("m", "f").agg(F.sum("times").alias("times"), F.first("words").alias("words"))
        # a single window that stands once is no repeat
        alone = F.col("m") == F.col("f")
        pieces = pieces.filter(~alone | (F.col("times") > 1))
    marked = pieces.groupBy(F.pmod("m", F.lit(shards)).alias("shard")).applyInArrow(_search_shard(window), "m long, f long, spans array<int>")
    marked = materialize(marked, "sub-marked")
    if any_hot:
        # back from windows to the runs that hold them
        back = cut.filter("at is not null").select("m", "f", "hot_m", "hot_f", "at").join(marked.select("m", "f"), ["m", "f"], "left_semi")
        spans = back.groupBy("hot_m", "hot_f").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + window))).alias("spans"))
        marked = marked.union(spans.select(F.col("hot_m").alias("m"), F.col("hot_f").alias("f"), "spans"))
    placed = likely.join(marked, ["m", "f"]).groupBy(*KEYS, "start").agg(F.first("spans").alias("spans"))
    placed = placed.select(*KEYS, F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
    return placed.groupBy(*KEYS).agg(F.flatten(F.collect_list("spans")).alias("spans")), searched.select("text", *KEYS)


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, spans, ...) with n_words, n_removed and kept_words instead of the spans."""
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            starts, ends, first = word_spans(data, offsets)
            spans = rows.column("spans")
            counts = np.zeros(rows.num_rows, np.int64)
            counts[:] = np.diff(spans.offsets.to_numpy())
            if spans.null_count:
                counts[spans.is_null().to_numpy(zero_copy_only=False)] = 0
            flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(first[:-1], counts)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, (base + flat)[::2], 1)
            np.add.at(change, (base + flat)[1::2], -1)
            keep = np.cumsum(change)[: len(starts)] == 0
            left = np.concatenate([[0], np.cumsum(keep)])
            n_words = np.diff(first)
            n_kept = left[first[1:]] - left[first[:-1]]
            joined, to, till = joined_words(data, starts[keep], ends[keep])
            raw = joined.tobytes()
            begin = left[first[:-1]]
            kept = [raw[to[a] : till[a + n - 1]].decode() if n else "" for a, n in zip(begin.tolist(), n_kept.tolist())]
            others = [c for c in rows.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in others], pa.array(n_words), pa.array(n_words - n_kept), pa.array(kept, pa.large_string()).cast(pa.string())], names=[*others, *CUT])


CUT = ("n_words", "n_removed", "kept_words")


def cut_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``(doc, n_words, n_removed, kept_words)``: each row of ``docs`` as a struct, whatever its columns' names, with its
    words that no repeated window covers, joined by single spaces.

    A window is ``window`` consecutive words of one text; it is a repeat if its word sequence also starts anywhere
    else, in the same text or another row. Null text counts as empty and stays null; texts shorter than a window
    lose nothing; copies lose all their windows. Ids play no part, so null and repeated ids are fine.
    """
    names = docs.columns
    other = F.struct(F.col("text").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != "text"])
    rows = keyed(docs.select("text", other.alias("other")))
    spans, _ = repeated_spans(rows.select("text", *KEYS), window, gram, hot_runs)
    joined = rows.join(spans, KEYS, "left").select("text", "other", "spans")
    schema = T.StructType([rows.schema["text"], rows.schema["other"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType())])
    cut = joined.mapInArrow(_cut_spans, schema)
    text = F.when(~F.col("other.none"), F.col("text"))
    return cut.select(F.struct(*[text.alias("text") if c == "text" else F.col(f"other.c{k}").alias(c) for k, c in enumerate(names)]).alias("doc"), *CUT)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Rows of ``docs`` (all its columns) with n_words, n_removed and kept_words, as ``cut_documents`` gives them; columns of
    these names in ``docs``, if any, are replaced."""
    cut = cut_documents(docs, window, gram, hot_runs)
    return cut.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in CUT], *CUT)


def repeat_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of the kept words.

    Only texts with repeats are cut, one copy of each; all rows get their counts and digests by a join of narrow rows, so
    a text in very many rows is no heavier there than others.
    """
    rows = keyed(docs.select("doc_id", "text"))
    spans, searched = repeated_spans(rows.select("text", *KEYS), window)
    schema = T.StructType([*[rows.schema[c] for c in ("text", *KEYS)], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType())])
    cut = searched.join(spans, KEYS).select("text", *KEYS, "spans").mapInArrow(_cut_spans, schema)

    def digest(words: Column) -> Column:
        return F.sha2(words.cast("binary"), 256)

    found = cut.select(*KEYS, "n_removed", digest(F.col("kept_words")).alias("cut_sha256"))
    plain = F.trim(F.regexp_replace(F.translate("text", "\t\n\x0b\x0c\r", "     "), " +", " "))
    narrow = rows.select("doc_id", *KEYS, word_count(F.col("text")).alias("n_words"), digest(plain).alias("sha256"))
    return narrow.join(found, KEYS, "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))
