"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document is its ids and an end id. One that fits into a sequence stays whole; a longer one is cut from its end, so all of
its pieces are full but the first, which has the rest. Full pieces are sequences of their own. The others are placed one by
one, longest first: with N(g) open sequences that have room for g more tokens, a piece goes where the sum of N(g)^2 over
all g becomes smallest, be it an open sequence or a new one; equal sums prefer the least room. So no gap becomes common
that later pieces can't fill.

Only lengths are packed, never texts. Pieces are dealt by their places into parts of some PART_PIECES, whatever their
number; a part is streamed through one task in its order of lengths, with a count and a stack of open sequences for each
room left, and ends with a few of them open. The cost of the parts is those.

Defined cases: a null or empty text has the end id alone; null and repeated ids, and wholly equal rows, are packed row by row;
very long texts are encoded whole; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import named, staged, text_steps
from .token_output import byte_bpe_path, encoder

CAPACITY = 2048
PART_PIECES = 20_000


class OpenSequences:
    """Open sequences by the room they have left, and where the next piece goes."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, np.int64)  # of each room; a full sequence isn't open, nor is an empty one
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.begun = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece shorter than the capacity."""
        top, n = self.capacity, self.n
        # Moving a sequence from room g to g - length changes the sum of squares by 2 (N(g - length) - N(g)) + 2; to room 0 by 1 - 2 N(g).
        change = 2 * (n[: top - length] - n[length:top]) + 2
        change[0] -= 1
        change[n[length:top] == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        if change[at] <= 2 * n[top - length] + 1:
            room = length + at
            sequence = self.by_room[room].pop()
            n[room] -= 1
        else:
            room, sequence = top, self.begun
            self.begun += 1
        if room > length:
            self.by_room[room - length].append(sequence)
            n[room - length] += 1
        return sequence, top - room


def cut(n_tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of each piece of documents of n_tokens."""
    first = (n_tokens - 1) % capacity + 1
    counts = (n_tokens - first) // capacity + 1
    row = np.repeat(np.arange(len(n_tokens)), counts)
    piece = np.arange(len(row)) - np.repeat(counts.cumsum() - counts, counts)
    start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
    return row, piece, start, np.where(piece > 0, capacity, first[row])


def _pieces(tokenizer: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                ids, counts = known.encode(data, offsets)
                ids = np.insert(ids, counts.cumsum(), end_id).astype("<u4")
                counts = counts + 1
                row, piece, start, length = cut(counts, capacity)
                begin = (counts.cumsum() - counts)[row] + start
                raw = memoryview(ids).cast("B")
                parts = [raw[a:b] for a, b in zip((begin * 4).tolist(), ((begin + length) * 4).tolist())]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _place(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), OpenSequences(capacity)
        for batch in batches:
            found = [known.place(n) for n in batch.column("length").to_pylist()]
            columns = [pa.array([part << 32 | s for s, _ in found], pa.int64()), pa.array([at for _, at in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """pieces, staged rows with a `place` of their own and a `length` of 1 to capacity, with sequence_id and offset."""
    short = pieces.filter(F.col("length") < capacity)
    parts = max(1, -(-short.count() // part_pieces))
    dealt = short.repartition(parts, "place").sortWithinPartitions(F.desc("length"), "place")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    packed = dealt.mapInArrow(_place(capacity), schema)
    full = pieces.filter(F.col("length") >= capacity).select("*", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, part_pieces: int = PART_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece; with keep_ids also ids, as little-endian unsigned 32-bit integers."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long{', ids binary' if keep_ids else ''}"
    found = rows.mapInArrow(_pieces(tokenizer or byte_bpe_path(), capacity, end_id, keep_ids), schema)
    # Written with their places, so that all that follows sees the same.
    pieces = staged(found.withColumn("place", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, capacity, part_pieces).drop("place")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, pieces, ids): whole sequences of pack_documents(..., keep_ids=True); each has at most the capacity."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("pieces"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("pieces", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return rows.select("sequence_id", "n_tokens", F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"), joined.alias("ids"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
