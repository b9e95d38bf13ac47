"""What the operators of this subpackage share: keys of rows, and words as numpy arrays.

Words are maximal runs of bytes outside space and 0x09-0x0D. These bytes never occur inside a multi-byte
UTF-8 character, so words are cut on the UTF-8 bytes of a whole Arrow column at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, new_path, shared_dir, staged  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step works on; a longer single document makes a step of its own.
STEP_BYTES = 1 << 20


#: Type of a row's key.
KEY = "struct<a: long, b: long>"


def row_key(*columns: Column) -> Column:
    """128 bits of the values: two hashes of different seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k): k tells rows apart whose ids repeat or are null; only wholly equal rows share it."""
    return docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k"))


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of docs has it."""
    there, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        found.append(name)
        there.add(name.lower())
    return found


def one_of_each(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of docs for each of keys (k), with all columns of docs as they are; of rows that share a key one is left."""
    own, there = fresh(docs, "row_key", "kept_key")
    rows = docs.withColumn(own, row_key(named(id_col), named(text_col)))
    return rows.join(keys.select(F.col("k").alias(there)), F.col(own) == F.col(there), "left_semi").dropDuplicates([own]).drop(own)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at a task's end its worker, which is kept for later tasks, gives the memory that is free in it back to the system."""

    def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return emptied


# --- words of an Arrow column ---------------------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: The bits of a lane of eight bytes that so many bytes fill.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
#: Odd, so that it has an inverse modulo 2**64.
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """r**0 .. r**(n-1) modulo 2**64, or those of its inverse."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, _R_INV if inverse else _R, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 << 20:
            _powers[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; space tells which bytes are between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a little-endian number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; fold: A-Z count as a-z. Seeds give hashes that have nothing to do with each other.

    Eight bytes at a time are mixed into all words that have as many; long words have XXH64. Neither is a sum over the
    bytes, so no rule for making words makes equal hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if fold:
        data = _FOLDED[data]
    length = ends - starts
    here, left = lanes(data), length
    out = np.full(len(starts), (seed + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    live = slice(None)
    for at in range(0, LONG_WORD, 8):
        out[live] = mix(out[live] ^ (here[starts[live] + at] & _FILLED[np.minimum(left, 8)]))
        if at == 0:
            live = np.flatnonzero((length > 8) & (length <= LONG_WORD))
        else:
            live = live[left > 8]
        if not len(live):
            break
        left = length[live] - (at + 8)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return mix(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of the word others[i]."""
    length = ends - starts
    same = length == length[others]
    here = lanes(data)
    live = np.flatnonzero(same & (others != np.arange(len(others))))
    for i in live[length[live] > LONG_WORD].tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[others[i]] : ends[others[i]]])
    live = live[length[live] <= LONG_WORD]
    for at in range(0, LONG_WORD, 8):
        if not len(live):
            break
        fill = _FILLED[np.minimum(length[live] - at, 8)]
        same[live] &= (here[starts[live] + at] & fill) == (here[starts[others[live]] + at] & fill)
        live = live[length[live] > at + 8]
    return same


def hash_runs(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` words, as many as fit."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * powers(n, inverse=True))


def first_words(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Index of the first word of each row, and at the end the number of words."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


# --- crc32 in DuckDB's SQL, for the queries' SQL --------------------------------------------------------------------

#: A CTE `tab` of one row: t, the crc32 of each byte.
CRC_TABLE = "tab AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t FROM range(256) AS r(i))"


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, in a row that has `t` of CRC_TABLE."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, len({digits}), 2), lambda p: ('0x' || substr({digits}, p, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295)"
