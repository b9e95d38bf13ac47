"""Token ids as binary output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format: a Parquet dataset in ascending id order, written by Spark's committer (so retried tasks leave no halves, on any
file system), one row a document: doc_id, part and local_start (its place), n_tokens, `control` (a byte for four ids,
two bits each: bytes - 1) and `data` (1 to 4 little-endian bytes an id, the last four padded with zeros). What is coded is
the id's rank by frequency over all documents, so common ids take one byte. `ranks` beside it has the id of each rank, at
most one row for each id of the vocabulary, and `parts` the first position of each part.
Decoding looks the four lengths of each control byte up in a table of 256 rows and gathers the ids with numpy.

A text is cut where no token of a byte-level BPE can cross: mostly into words and runs of signs, so that a word is one piece whatever follows it.
Pieces of a step are told apart by 64-bit hashes and then by their bytes, and each distinct piece is encoded by the tokenizers library and kept in a
bounded cache.

Defined cases: a null text is empty; an empty text has the end id alone; repeated rows and ids are written in order of
their ids, then of a hash of their bytes; null ids come first; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, hash_words, lean, named, new_path, same_words, staged, text_steps

#: Ids handled in one numpy step.
STEP_IDS = 1 << 19
CACHE_PIECES = 500_000
CACHE_PIECE_BYTES = 40

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_GROUP_BYTES = _LENGTHS.sum(1)
_WITHIN = np.hstack([np.zeros((256, 1), np.int64), _LENGTHS.cumsum(1)[:, :3]])
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of documents of counts[i] ranks each, their ranks one after the other."""
    padded = -(-counts // 4) * 4
    starts = np.concatenate([[0], padded.cumsum()])
    values = np.zeros(starts[-1], np.uint32)
    values[np.arange(len(ranks)) + np.repeat(starts[:-1] - np.concatenate([[0], counts.cumsum()[:-1]]), counts)] = ranks
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    at = np.concatenate([[0], (extra.astype(np.int64) + 1).cumsum()])
    data = np.zeros(at[-1], np.uint8)
    data[at[:-1]] = values & 0xFF
    for k in (1, 2, 3):
        longer = np.flatnonzero(extra >= k)
        data[at[longer] + k] = (values[longer] >> np.uint32(8 * k)) & np.uint32(0xFF)
    c, d = control.tobytes(), data.tobytes()
    edges = at[starts]
    return [c[a // 4 : b // 4] for a, b in zip(starts[:-1], starts[1:])], [d[a:b] for a, b in zip(edges[:-1], edges[1:])]


def decode_ranks(control: bytes, data: bytes) -> np.ndarray:
    """The ranks of whole documents, padding included."""
    c = np.frombuffer(control, np.uint8)
    base = np.concatenate([[0], _GROUP_BYTES[c].cumsum()])[:-1]
    at = (base[:, None] + _WITHIN[c]).ravel()
    d = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    value = d[at] | d[at + 1] << np.uint32(8) | d[at + 2] << np.uint32(16) | d[at + 3] << np.uint32(24)
    return value & _MASKS[_LENGTHS[c].ravel() - 1]


_encoders: dict[str, Encoder] = {}

# A byte-level vocabulary writes each byte as a letter: printable ones as themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = np.arange(256, dtype="<u2")
_LETTERS[sorted({*range(256)} - {*_PLAIN})] = 256 + np.arange(256 - len(_PLAIN))
_ALPHA = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([chr(b) in string.punctuation for b in range(256)])
#: Which characters of two bytes are letters, up to Cyrillic.
_ALPHA_2 = np.array([i >= 128 and i < 0x530 and chr(i).isalpha() for i in range(2048)])


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are letters or halves of letters: ASCII, and those of two bytes up to Cyrillic. Others count as no letters."""
    found = _ALPHA[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xD4))
    if len(lead):
        is_letter = _ALPHA_2[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
        found[lead] = is_letter
        found[lead + 1] = is_letter
    return found


def pieces(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray, whole: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): where a text is cut, and each text's first piece. All cuts lie between units of a byte-level BPE.

    It is cut before a space or line feed after a character that is not white space, before a sign after a letter, and before
    a letter after a sign that begins no contraction or after a line feed that is a unit; never within a text of `whole`.
    """
    cut = np.zeros(len(data), bool)
    if len(data):
        before = np.concatenate([[np.uint8(0)], data[:-1]])
        feed = data == 10
        cut = ((data == 32) | feed) & (before > 32)
        # After the last byte of white space outside ASCII (U+0085, U+00A0, U+1680 to U+3000) nothing is cut; it may spare more.
        two, three = np.concatenate([np.zeros(2, np.uint8), data[:-2]]), np.concatenate([np.zeros(3, np.uint8), data[:-3]])
        cut &= ~((two == 0xC2) & ((before == 0x85) | (before == 0xA0)))
        cut &= ~((three >= 0xE1) & (three <= 0xE3) & (two >= 0x80) & (two <= 0xA0) & (before >= 0x80))
        sign = _SIGN[data]
        cut[1:] |= letter[1:] & (cut & feed | sign & (data != 39))[:-1] | sign[1:] & letter[:-1]
        if whole:
            raw = data.tobytes()
            for word in whole:
                at = raw.find(word)
                while at >= 0:
                    cut[at + 1 : at + len(word)] = False
                    at = raw.find(word, at + 1)
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[full] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """A tokenizer with its cache of pieces; one for each worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"  # 16 or 32 bits
        self.known: dict[bytes, bytes] = {}

    def _ids(self, new: list[bytes], plain: list[bool]) -> tuple[array, list[int]]:
        """The ids of pieces, one after the other, and how many each has. Those of letters alone, a space before them at most, are plain: a unit each."""
        joined = np.frombuffer(b"".join([piece for piece, is_plain in zip(new, plain) if is_plain]), np.uint8)
        text, at, units, tokenize = _LETTERS[joined].tobytes().decode("utf-16-le"), 0, [], self.tokenizer.model.tokenize
        others = iter(self.tokenizer.encode_batch_fast([piece.decode() for piece, is_plain in zip(new, plain) if not is_plain], add_special_tokens=False))
        for piece, is_plain in zip(new, plain):
            if is_plain:
                end = at + len(piece)
                units.append([t.id for t in tokenize(text[at:end])])
                at = end
            else:
                units.append(next(others).ids)
        return array(self.kind, chain.from_iterable(units)), list(map(len, units))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of texts, one after the other, and how many each has. Equal pieces are looked up once."""
        letter = letters(data)
        starts, first = pieces(data, offsets, letter, self.added)
        ends = np.append(starts[1:], len(data))
        hashes = hash_words(data, starts, ends)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        at = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = new.cumsum() - 1
        other = np.flatnonzero(~same_words(data, starts, ends, at[of]))
        # Pieces that share a hash with another one are each taken by themselves.
        of[other] = len(at) + np.arange(len(other))
        at = np.concatenate([at, other])
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        found = list(map(self.known.get, distinct))
        known = [ids for ids in found if ids is not None]
        missing = [i for i, ids in enumerate(found) if ids is None]
        upto = np.concatenate([[0], letter.cumsum()])
        begin, end = starts[at[missing]], ends[at[missing]]
        begin = begin + (data[begin] == 32) if len(missing) else begin
        plain = (upto[end] - upto[begin] == end - begin) & (end > begin)
        texts = [distinct[i] for i in missing]
        more, sizes_more = self._ids(texts, plain.tolist())
        kind = np.dtype(f"<u{more.itemsize}")
        # Frequent pieces come early: a full cache stays as it is.
        if (room := CACHE_PIECES - len(self.known)) > 0:
            raw_more, done = more.tobytes(), 0
            for piece, n in zip(texts[:room], sizes_more):
                if len(piece) <= CACHE_PIECE_BYTES:
                    self.known[piece] = raw_more[done * more.itemsize : (done + n) * more.itemsize]
                done += n
        flat = np.concatenate([np.frombuffer(b"".join(known), kind), np.frombuffer(more, kind)])
        is_known = np.ones(len(at), bool)
        is_known[missing] = False
        sizes, begins = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for of_them, n, shift in ((is_known, np.array(list(map(len, known)), np.int64) // more.itemsize, 0), (~is_known, np.array(sizes_more, np.int64), len(flat) - len(more))):
            sizes[of_them], begins[of_them] = n, shift + n.cumsum() - n
        counts = sizes[of]
        ends_at = counts.cumsum()
        ids = flat[np.arange(int(counts.sum())) + np.repeat(begins[of] - (ends_at - counts), counts)]
        upto = np.concatenate([[0], ends_at])
        return ids, np.diff(upto[first])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                ids, counts = e.encode(data, offsets)
                ids = np.insert(ids, counts.cumsum(), end_id)
                counts = counts + 1
                edges = np.concatenate([[0], counts.cumsum()]) * ids.itemsize
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), raw], ["doc_id", "n_tokens", "ids"])

    return run


def _flat_ids(raw: list[bytes], n: int) -> np.ndarray:
    """All ids of some documents, n in number; their width follows from it."""
    joined = b"".join(raw)
    return np.frombuffer(joined, "<u2" if len(joined) == 2 * n else "<u4")


def _by_ids(batch: pa.RecordBatch, column: str = "n_tokens") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_IDS ids each."""
    sums = batch.column(column).to_numpy(zero_copy_only=False).cumsum()
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + STEP_IDS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part in _by_ids(batch):
            seen = np.bincount(_flat_ids(part.column(1).to_pylist(), int(part.column(0).to_numpy().sum())))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


def _write(rank_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank_of.value
        for batch in batches:
            for part in _by_ids(batch):
                counts = part.column(1).to_numpy()
                control, data = encode_ranks(table[_flat_ids(part.column(2).to_pylist(), int(counts.sum()))], counts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "control", "data"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place in the part, for rows in their final order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        starts = at + n.cumsum() - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(starts, pa.int64()), *batch.columns[1:]], ["doc_id", "part", "local_start", "n_tokens", "control", "data"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the documents' ids under path; gives path back."""
    spark = docs.sparkSession
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ids = staged(rows.mapInArrow(lean(_tokenize(tokenizer, end_id)), f"doc_id {id_type}, n_tokens long, ids binary"), "token-ids")
    counted = ids.select("n_tokens", "ids").mapInArrow(lean(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = [(r["id"], i) for i, r in enumerate(sorted(counted.collect(), key=lambda r: (-r["n"], r["id"])))]  # at most the vocabulary
    table = np.zeros(max((i for i, _ in ranks), default=0) + 1, np.uint32)
    for token, rank in ranks:
        table[token] = rank
    spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in ranks], pa.int64()), "rank": pa.array([r for _, r in ranks], pa.int64())})).coalesce(1).write.parquet(f"{path}/ranks")
    known = spark.sparkContext.broadcast(table)
    schema = f"doc_id {id_type}, n_tokens long, control binary, data binary"
    # Written, since the ranges are sampled from it before it is dealt out; a hash splits the rows of an id that very many have.
    coded = staged(ids.mapInArrow(lean(_write(known)), schema), "token-codes")
    discard(ids)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("control", "data")]
    (
        coded.repartitionByRange(*order)
        .sortWithinPartitions(*order, "n_tokens", "control", "data")
        .mapInArrow(lean(_number), schema.replace("n_tokens", "part int, local_start long, n_tokens"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/documents")
    )
    discard(coded)
    files = spark.read.parquet(f"{path}/documents")
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", start.alias("start")).write.parquet(f"{path}/parts")
    return path


def _read(id_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_of.value
        for batch in batches:
            for part in _by_ids(batch):
                n = part.column(2).to_numpy()
                ids = table[decode_ranks(b"".join(part.column(3).to_pylist()), b"".join(part.column(4).to_pylist()))]
                edges = np.concatenate([[0], (-(-n // 4) * 4).cumsum()])
                raw = [ids[a : a + k].tobytes() for a, k in zip(edges[:-1], n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from files of write_tokens; ids as little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    table = np.zeros(len(ranks), "<u4")
    for r in ranks:
        table[r["rank"]] = r["id"]
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))  # one row for each part of the files
    files = spark.read.parquet(f"{path}/documents").join(parts, "part")
    id_type = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "control", "data")
    return rows.mapInArrow(lean(_read(spark.sparkContext.broadcast(table))), f"doc_id {id_type}, start long, n_tokens long, ids binary")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of docs in the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = write_tokens(docs, new_path(spark, "token-files"), tokenizer or byte_bpe_path())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
