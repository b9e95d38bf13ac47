"""SimHash near-duplicates: fingerprints of 64 bits, linked at 3 or fewer differing bits, and their components.

Fingerprints are pre-aggregated, so copies of a text are one row from there on. Candidates: the 64 bits are cut into
six blocks; 3 differing bits leave at least three blocks equal, so each fingerprint goes out under its 20 choices of
three blocks, and fingerprints meet under an equal choice. That misses no pair. A meeting of more than 2,048
fingerprints is dealt anew by each quarter of its other bits, one of which is equal too; what is still larger is cut into
chunks that are compared chunk by chunk, so no task gets it whole.

Comparison is bit-sliced: 64 bit planes hold one fingerprint a lane. For each distance d in the sort order, the planes
are set against themselves d lanes further, and all lanes' differences are counted together by carry-save adders; words
of lanes that have all exceeded the radius are abandoned on the way. Each meeting gives the edges found as a spanning
forest, never all pairs.

Components: alternating large-star and small-star rounds over the edges, each written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; of null ids the component is the
smallest id that is not null, or null; repeated rows give a row each; an empty table gives an empty result; extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEY, discard, first_words, keyed, lean, one_of_each, staged, text_steps, word_spans

RADIUS = 3
CHUNK = 2048
#: Rows compared in one numpy step, at least.
STEP_ROWS = 1 << 16
_EDGES = (0, 11, 22, 33, 44, 54, 64)
_CHOICES = list(combinations(range(6), 3))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _fingerprints(words_per_shingle: int):
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                starts, ends, rows = word_spans(data, offsets)
                n_rows = hi - lo
                # The words, folded and joined by one space.
                keep = np.zeros(len(data) + 1, np.int64)
                keep[starts] += 1
                keep[ends] -= 1
                inside = keep.cumsum()[:-1].astype(bool)
                lengths = ends - starts
                at = np.concatenate([[0], (lengths + 1).cumsum()])
                joined = np.full(at[-1], 32, np.uint8)
                joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = _FOLD[data[inside]]
                raw = joined.tobytes()
                first = first_words(rows, n_rows)
                n_words = np.diff(first)
                n_shingles = np.where(n_words > 0, np.maximum(n_words - words_per_shingle + 1, 1), 0)
                row = np.repeat(np.arange(n_rows), n_shingles)
                begin = np.arange(len(row)) - np.repeat(n_shingles.cumsum() - n_shingles, n_shingles) + first[row]
                last = np.minimum(begin + words_per_shingle, first[row + 1])
                a, b = at[begin].tolist(), (at[last] - 1).tolist()
                hashes = np.fromiter((xxh64_intdigest(raw[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
                out = np.zeros(n_rows, np.uint64)
                full = np.flatnonzero(n_shingles)
                if len(full):
                    begins = (n_shingles.cumsum() - n_shingles)[full]
                    for bit in range(64):
                        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begins)
                        out[full] |= (2 * ones > n_shingles[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n_rows), batch.column(2).slice(lo, n_rows), pa.array(out.view(np.int64))], ["doc_id", "k", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, k, fp): k is the row's key, fp has the fingerprint's 64 bits as a signed long."""
    rows = keyed(docs, id_col, text_col)
    return rows.mapInArrow(lean(_fingerprints(words_per_shingle)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, k {KEY}, fp long")


# --- bit-sliced comparison ------------------------------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane b is bit b of fingerprint 64 * w + i; a spare word of zeros ends each plane."""
    n = len(fps)
    bits = np.zeros((64, (n + 63) // 64 * 64 + 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def pairs_within(fps: np.ndarray, group_end: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j < group_end[i] whose fingerprints differ in at most `radius` (3 or fewer) bits."""
    n = len(fps)
    if n < 2:
        none = np.zeros(0, np.int64)
        return none, none
    planes = bit_planes(fps)
    n_words = planes.shape[1] - 1
    reach = np.zeros(n_words * 64, np.int64)
    reach[:n] = group_end - np.arange(n) - 1
    most = reach.reshape(-1, 64).max(1)
    left, right = [], []
    words = np.arange(n_words)
    for d in range(1, int(most.max(initial=0)) + 1):
        words = words[most[words] >= d]
        skip, bit = divmod(d, 64)
        live = words
        # Three counter planes: once `over` is set, a lane has at least four differences.
        one = np.zeros(len(live), np.uint64)
        two, over = one.copy(), one.copy()
        todo = np.packbits((reach.reshape(-1, 64)[live] >= d).ravel(), bitorder="little").view("<u8")
        for b in range(64):
            near = np.minimum(live + skip, n_words)
            other = planes[b, near]
            if bit:
                other = other >> np.uint64(bit) | planes[b, np.minimum(near + 1, n_words)] << np.uint64(64 - bit)
            x = planes[b, live] ^ other
            carry = one & x
            one ^= x
            over |= two & carry
            two ^= carry
            if b % 8 == 7 and b < 63:
                alive = (todo & ~over) != 0
                if not alive.any():
                    live = live[:0]
                    break
                if alive.mean() < 0.7:
                    live, one, two, over, todo = live[alive], one[alive], two[alive], over[alive], todo[alive]
        if len(live):
            hit = todo & ~over
            if radius < 3:
                hit &= {0: ~one & ~two, 1: ~two, 2: ~(one & two)}[radius]
            some = np.flatnonzero(hit)
            if len(some):
                w, lane = np.nonzero(np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                i = live[some[w]] * 64 + lane
                left.append(i)
                right.append(i + d)
    if not left:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(left), np.concatenate(right)


def _forest(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The edges that join parts, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the meetings in a sorted partition: columns key, part, fp; a meeting that a batch cuts is carried over."""
    held: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))

    def edges(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        ends = np.repeat(starts + sizes, sizes)
        i, j = pairs_within(fp.view(np.uint64), ends)
        found = np.array(list(_forest(i, j)), np.int64).reshape(-1, 2)
        if len(found):
            return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], ["a", "b"])
        return None

    waiting: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        waiting.append(tuple(batch.column(c).to_numpy().astype(np.int64) for c in range(3)))
        if sum(len(x[0]) for x in waiting) < STEP_ROWS:
            continue
        rows = tuple(np.concatenate(x) for x in zip(held, *waiting))
        waiting = []
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        held = tuple(r[cut:] for r in rows)
        if cut and (out := edges(*(r[:cut] for r in rows))) is not None:
            yield out
    held = tuple(np.concatenate(x) for x in zip(held, *waiting))
    if len(held[0]) and (out := edges(*held)) is not None:
        yield out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks() -> tuple[list[int], list[int]]:
    """The bits of each choice of three blocks; and, for each, a quarter of the other bits four times."""
    chosen, quarters = [], []
    for choice in _CHOICES:
        mask = sum(((1 << (_EDGES[b + 1] - _EDGES[b])) - 1) << _EDGES[b] for b in choice)
        others = [bit for bit in range(64) if not mask >> bit & 1]
        chosen.append(_signed(mask))
        quarters += [_signed(sum(1 << bit for bit in others[j::4])) for j in range(4)]
    return chosen, quarters


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the fingerprints of distinct (fp) that span every component of the links at RADIUS bits."""
    chosen, quarters = _masks()
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(n)) for n, m in enumerate(chosen)])
    met = distinct.select("fp", F.posexplode(keys).alias("choice", "key"))
    count = lambda df: df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    busy = staged(count(met), "simhash-busy")
    parts = [met.join(busy.filter(F.col("n") <= CHUNK), "key").select("key", F.lit(0).cast("long").alias("part"), "fp")]
    crowded = busy.filter(F.col("n") > CHUNK).select("key")
    if not crowded.isEmpty():
        # Of the bits outside the three blocks, three differ at most, so that one quarter of them is equal.
        masks = F.array(*[F.lit(m) for m in quarters])
        quarter = lambda j: F.xxhash64("key", F.lit(j), F.col("fp").bitwiseAND(F.element_at(masks, F.col("choice") * 4 + j + 1)))
        finer = staged(met.join(crowded, "key").select("fp", F.explode(F.array(*[quarter(j) for j in range(4)])).alias("key")), "simhash-finer")
        parts.append(_dealt(finer.join(count(finer), "key")))
    rows = reduce(DataFrame.unionByName, parts).repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "fp")
    return rows.mapInArrow(lean(_compare), "a long, b long").distinct()


def _dealt(met: DataFrame) -> DataFrame:
    """(key, part, fp) of (key, n, fp): a meeting of n above CHUNK is cut into c chunks, and a chunk goes out once for each, c = n / CHUNK."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), "chunks").cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: (F.least(x, F.col("own")) * F.col("chunks") + F.greatest(x, F.col("own"))).cast("long"))
    return met.withColumn("chunks", chunks).withColumn("own", own).select("key", F.explode(parts).alias("part"), "fp")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = staged(edges, name)
    seen = None
    for _ in range(100):
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u")
        small = small.select("m", "v").filter("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).union(lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        before, edges = edges, staged(small, name)
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle in 100 rounds")
    # Stars now: every node but a root has one edge, to its root.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, k, fp, component_id, root): component_id is the smallest id reachable over links, root a fingerprint in common."""
    rows = staged(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash")
    least = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(least.select("fp")), "simhash-cc")
    linked = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = staged(linked.select("fp", "root").join(by_root, "root").select("fp", "root", "component_id"), "simhash-of")
    return rows.join(of_fp, "fp").select("doc_id", "k", "fp", "component_id", "root")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, null ids last, then of the smallest key."""
    found = near_duplicates(docs, id_col, text_col)
    return one_of_each(docs, found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first")).select("first.k"), id_col, text_col)
