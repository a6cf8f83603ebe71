"""Shared pieces of the training-data operators: tables in the shared folder, word arrays over Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of characters other than space and U+0009..U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 2 << 20

_U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = _U64(0x9E3779B97F4A7C15)
#: Spans beyond this many bytes are hashed one by one.
_BLOCKWISE = 64
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of
    its own; a cluster has no folder that all machines share by chance, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, f"{tempfile.gettempdir()}/mnemospark-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemospark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and the n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive slices of a batch with about ``most`` bytes of text each (one row at least), with their buffers."""
    if batch.num_rows == 0:
        return
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (and the end) the index of its first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[1:n] = word[1:] != word[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    is_word = word[cuts[:-1]]
    starts, ends = cuts[:-1][is_word], cuts[1:][is_word]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans of bytes at once: mixed blocks of eight bytes, or XXH64 for long
    spans. Equal spans have equal hashes wherever they stand."""
    sizes = ends - starts
    out = mix(sizes.astype(_U64) * _STEP + _U64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position
    at, left, live = starts, sizes, np.flatnonzero((sizes > 0) & (sizes <= _BLOCKWISE))
    at, left = at[live], left[live]
    while len(live):
        spare = (np.maximum(8 - left, 0) * 8).astype(_U64)
        out[live] = mix((out[live] ^ ((blocks[at] << spare) >> spare)) * _STEP)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(sizes > _BLOCKWISE)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = np.fromiter((xxhash.xxh64_intdigest(view[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())), _U64, len(long))
    return out


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` (a power of two) consecutive 64-bit values, by doubling."""
    now, step = values, 1
    while step < size:
        now = mix(now[: max(len(now) - step, 0)] * _STEP + now[step:])
        step *= 2
    return now


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans of 64-bit values, in steps of 64, 8 and 1."""
    out = mix((ends - starts).astype(_U64) + _STEP)
    at = starts.copy()
    longest = int((ends - starts).max(initial=0))
    for size in (64, 8, 1):
        if size > longest:
            continue
        grams = gram_hashes(values, size)
        live = np.flatnonzero(at + size <= ends)
        while len(live):
            out[live] = mix(out[live] * _STEP + grams[at[live]])
            at[live] += size
            live = live[at[live] + size <= ends[live]]
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed longs that Spark stores."""
    return x.view(np.int64) if x.dtype == _U64 else x.astype(np.int64)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words with one space after each, and where each begins and ends in that."""
    sizes = ends - starts
    upto = np.cumsum(sizes + 1)
    to = upto - sizes - 1
    joined = np.full(int(upto[-1]) if len(upto) else 0, 32, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[inner + np.repeat(to, sizes)] = data[inner + np.repeat(starts, sizes)]
    return joined, to, to + sizes
