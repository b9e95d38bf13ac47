"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their components.

Candidates come from SimHash fingerprints of the shingle sets, linked by `simhash.links`. At its radius these reach few of
such pairs, and at a radius that reaches all its blocks would hold next to no bits; so least hashes add candidates, and
every link is confirmed on the whole shingle sets:

1. Texts of equal sets are one from here on. Each set has a fingerprint, and BANDS * ROWS least hashes; sets meet under an
   equal band.
2. Sets that meet are compared by the low bytes of all least hashes; those with LIKELY or more equal, and those whose
   fingerprints differ in simhash.RADIUS bits at most, are joined, as a spanning forest, into groups.
3. In each group the shingle sets themselves are compared, and links of SIMILAR or more are given as a spanning forest.

A pair of similarity 0.8 is missed with a probability of (1 - 0.8**4)**40 = 7e-10 in step 1 and of 2e-9 in step 2 if the hashes are independent, a
more similar one with less; a link that is not one is never given. Meetings and groups above a slice's size are cut, and
what the slices join is contracted before the rest is compared (`_linked`), so no task gets one whole, and a family of
n copies costs n rows and not its pairs.

Words, folding and defined cases are those of `simhash`; texts under five words have one shingle, and wordless texts are
copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEY, discard, first_words, hash_runs, hash_words, keyed, lean, mix, one_of_each, staged, text_steps, word_spans
from .simhash import components, links

WORDS = 5
#: Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 4
#: Equal least hashes, of BANDS * ROWS, from which sets are compared in full.
LIKELY = 96
#: Rows of a slice or chunk, of a meeting (bytes of least hashes) and of a group (whole texts).
MEETING, GROUP = 2048, 256
PIVOTS = 4

_rng = np.random.default_rng(20250102)
_TIMES = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all distinct shingles of each row, sorted."""
    starts, ends, rows = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    hashed = hash_words(data, starts, ends, fold=True)
    first = first_words(rows, n_rows)
    n = np.diff(first)
    row, found = [], []
    runs = hash_runs(hashed, words)
    at = np.flatnonzero(rows[: len(runs)] == rows[words - 1 : words - 1 + len(runs)])
    row.append(rows[at])
    found.append(runs[at])
    for length in range(1, words):
        short = np.flatnonzero(n == length)
        if len(short):
            row.append(short)
            found.append(hash_runs(hashed, length)[first[short]])
    row, found = np.concatenate(row), np.concatenate(found)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


def least_hashes(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(sets, BANDS * ROWS) least hashes of the sets that begin at `begins`."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        y = (x ^ _FLIP[i]) * _TIMES[i]
        out[:, i] = np.minimum.reduceat(y ^ y >> np.uint32(15), begins)
    return out


def set_keys(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A key of each whole set."""
    return mix(np.add.reduceat(mix(found), begins)) ^ np.diff(np.append(begins, len(found))).astype(np.uint64)


def fingerprints(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SimHash of the sets that begin at `begins`: a bit is 1 if it is in over half of the set's hashes."""
    sizes = np.diff(np.append(begins, len(found)))
    out = np.zeros(len(begins), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((found >> np.uint64(bit)) & np.uint64(1), begins)
        out |= (2 * ones.astype(np.int64) > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, k to doc_id, k, s (the set's key, 0 for no words), fp, sketch and bands."""
    for batch in batches:
        for lo, hi, data, offsets in text_steps(batch.column(1)):
            n = hi - lo
            row, found = shingles(data, offsets)
            full, begins = np.unique(row, return_index=True)
            s, fp, sketch = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, BANDS * ROWS), np.uint8)
            bands = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                s[full], fp[full] = set_keys(found, begins), fingerprints(found, begins)
                least = least_hashes(found, begins)
                sketch[full] = (least & np.uint32(255)).astype(np.uint8)
                for r in range(ROWS):
                    bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
            ends = np.zeros(n + 1, np.int32)
            ends[full + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n),
                    batch.column(2).slice(lo, n),
                    pa.array(s.view(np.int64)),
                    pa.array(fp.view(np.int64)),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends.cumsum(dtype=np.int32)), pa.array(bands.ravel().view(np.int64))),
                ],
                ["doc_id", "k", "s", "fp", "sketch", "bands"],
            )


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of n nodes; near(i, others) tells which of others are linked to i."""
    edges: list[tuple[int, int]] = []
    left, todo = np.arange(n), []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        i = todo.pop()
        hit = near(i, left)
        for j in left[hit].tolist():
            edges.append((i, j))
            todo.append(j)
        left = left[~hit]
    return edges


def likely(sketches: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the sketches that have LIKELY or more bytes in common."""
    return spanning(len(sketches), lambda i, left: (sketches[left] == sketches[i]).sum(1) >= LIKELY)


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of the sets (of distinct values) whose similarity is SIMILAR or more."""
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    begins = np.append(0, sizes.cumsum())
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    state = {"left": len(sets), "of": of, "token": token}

    def near(i: int, left: np.ndarray) -> np.ndarray:
        if len(left) * 2 < state["left"]:
            live = np.zeros(len(sets), bool)
            live[left] = True
            some = live[state["of"]]
            state.update(left=len(left), of=state["of"][some], token=state["token"][some])
        own = token[begins[i] : begins[i + 1]]
        mark[own] = True
        both = np.bincount(state["of"][mark[state["token"]]], minlength=len(sets))[left]
        mark[own] = False
        return SIMILAR[1] * both >= SIMILAR[0] * (sizes[left] + sizes[i] - both)

    return spanning(len(sets), near)


def _by_group(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch], list], forest: Callable[[list], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the groups of a partition sorted by its columns key, part; column s names a row, made gives its value."""
    now, names, values = None, [], []

    def edges() -> Iterator[pa.RecordBatch]:
        if len(names) > 1 and (found := forest(values)):
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], pa.int64()), pa.array([names[i] for i in b], pa.int64())], ["a", "b"])

    for batch in batches:
        keys, parts, s = (batch.column(c).to_pylist() for c in range(3))
        for key, part, name, value in zip(keys, parts, s, made(batch)):
            if (key, part) != now:
                yield from edges()
                now, names, values = (key, part), [], []
            names.append(name)
            values.append(value)
    yield from edges()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda batch: [np.frombuffer(x, np.uint8) for x in batch.column(3).to_pylist()]
    yield from _by_group(batches, made, lambda values: likely(np.stack(values)))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(batch: pa.RecordBatch) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi, data, offsets in text_steps(batch.column(3)):
            row, found = shingles(data, offsets)
            out += np.split(found, np.searchsorted(row, np.arange(1, hi - lo)))
        return out

    yield from _by_group(batches, made, similar)


def _compared(dealt: DataFrame, content: DataFrame, run) -> DataFrame:
    """Edges that run finds in the parts of dealt, with each row's content (s, value)."""
    rows = dealt.join(content, "s").select("key", "part", "s", "value")
    return rows.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "s").mapInArrow(lean(run), "a long, b long").distinct()


def _linked(rows: DataFrame, content: DataFrame, run, most: int, name: str) -> DataFrame:
    """Edges that join what run links among rows (key, s) of one key, each row having its content (s, value).

    A key of more than `most` rows is cut into slices, and PIVOTS of its rows are in each slice, so that a family of copies
    is joined over all slices for its own rows alone. Rows that are joined so are one component: what is left to compare are
    the rows outside a key's largest component, chunk by chunk, with each other and with the largest one. If r of n rows lie
    outside, this sends n * r / most rows, and none where r is 0.
    """
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    large = staged(large, f"{name}-large")
    some_large = not large.isEmpty()
    dealt = rows.withColumn("part", F.lit(0).cast("long"))
    if some_large:
        pivots = F.array_distinct(F.array(*(F.min_by("s", F.xxhash64("s", F.lit(i))) for i in range(PIVOTS))))
        large = staged(rows.join(large, "key").groupBy("key", "slices").agg(pivots.alias("pivots")), f"{name}-pivots")
        part = F.coalesce(F.pmod(F.xxhash64("s", F.lit(2)), "slices"), F.lit(0)).cast("long")
        dealt = rows.join(large, "key", "left").filter(F.col("pivots").isNull() | ~F.array_contains("pivots", F.col("s"))).select("key", part.alias("part"), "s")
        everywhere = large.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("part"), "pivots")
        dealt = dealt.unionByName(everywhere.select("key", "part", F.explode("pivots").alias("s")))
    edges = _compared(dealt, content, run)
    if not some_large:
        return edges
    edges = staged(edges, f"{name}-slices")
    roots = components(edges, f"{name}-joined")
    sides = rows.join(large.select("key"), "key").join(roots, F.col("s") == F.col("node"), "left").select("key", "s", F.coalesce("root", "s").alias("root"))
    sides = staged(sides, f"{name}-sides")
    heaviest = F.max_by("root", F.struct("m", "root")).alias("main")
    main = sides.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(heaviest, F.sum("m").alias("n"), F.max("m").alias("m")).filter("n > m")
    chunks = lambda rows: F.ceil(rows / most).cast("int")
    left = sides.join(main.select("key", "main", chunks(F.col("n") - F.col("m")).alias("outs"), chunks(F.col("m")).alias("ins")), "key").withColumn("inside", F.col("root") == F.col("main"))
    left = left.withColumn("own", F.pmod(F.xxhash64("s", F.lit(3)), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs"))).cast("int"))
    own, outs, ins = F.col("own"), F.col("outs"), F.col("ins")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    # Parts of two chunks outside are numbered from 0 up, those of one outside and one inside from -1 down.
    across = lambda out, inside: (-1 - out.cast("long") * ins - inside).cast("long")
    with_main = F.when(F.col("inside"), F.transform(each(outs), lambda x: across(x, own))).otherwise(F.transform(each(ins), lambda x: across(own, x)))
    outside = F.transform(each(outs), lambda x: F.least(x, own).cast("long") * outs + F.greatest(x, own))
    parts = F.when(F.col("inside"), with_main).otherwise(F.concat(with_main, outside))
    return edges.unionByName(_compared(left.select("key", F.explode(parts).alias("part"), "s"), content, run))


def _near_fingerprints(made: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of equal fingerprints, and between one set each of linked ones."""
    sets = made.filter("s <> 0").select("s", "fp").distinct()
    one = staged(sets.groupBy("fp").agg(F.min("s").alias("one")), "near-fingerprints")
    equal = sets.join(one, "fp").filter("s <> one").select(F.col("one").alias("a"), F.col("s").alias("b"))
    of = lambda end: one.select(F.col("fp").alias(end), F.col("one").alias(f"{end}_set"))
    near = links(one.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    return equal.unionByName(near)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, root) of every row: k is its key, root is common to all rows of a component."""
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    made = staged(rows.mapInArrow(lean(_sketch), f"doc_id {id_type}, k {KEY}, s long, fp long, sketch binary, bands array<long>"), "near-sets")
    met = made.select(F.explode("bands").alias("key"), "s")
    busy = met.groupBy("key").agg(F.min("s").alias("least"), F.max("s").alias("most")).filter("least < most").select("key")
    meetings = staged(met.join(busy, "key").distinct(), "near-meetings")
    candidates = meetings.select("s").distinct()
    sketches = made.join(candidates, "s", "left_semi").groupBy("s").agg(F.min("sketch").alias("value"))
    alike = _linked(meetings, sketches, _likely, MEETING, "near-met").unionByName(_near_fingerprints(made))
    groups = staged(components(alike, "near-likely").select(F.col("node").alias("s"), F.col("root").alias("key")), "near-groups")
    one = made.join(groups.select("s"), "s", "left_semi").groupBy("s").agg(F.min("k").alias("k"))
    # Wholly equal rows share a key: one text of each is enough.
    texts = rows.join(one, "k").select("s", "k", F.col("text").alias("value")).dropDuplicates(["s"]).select("s", "value")
    roots = components(_linked(groups, texts, _similar, GROUP, "near-group"), "near-cc")
    return made.select("doc_id", "k", "s").join(roots, F.col("s") == F.col("node"), "left").select("doc_id", "k", F.coalesce("root", "s").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, null ids last, then of the smallest key."""
    found = near_copies(docs, id_col, text_col)
    return one_of_each(docs, found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first")).select("first.k"), id_col, text_col)
