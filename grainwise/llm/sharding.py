"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Groups are the rows of equal text, and a group lies in one shard; only a group above a shard's capacity (1 / shards of the
bytes, tokens or rows) is dealt over as many shards as it needs. Groups above 1 / (64 * shards) of any total are packed one
by one, of which there are at most 3 * 64 * shards; all others are dealt whole, by hash, into 128 lots for each shard, and
the lots are packed. Those bounds hold at any size, so the sums are packed on the driver and the placing is broadcast.

Packing: in falling order of the largest share; each group or lot goes to the shard with the highest dot product of its
vector with the residual capacity, among those it fits in, else among all.

Slots are counted piece by piece: a lot is a piece, and the rows of a group that is packed by itself are dealt by a hash of
their places in the input, whatever their ids, into pieces of some 1 / (128 * shards), so no task numbers a hot group whole.
Where such a group needs several shards, its pieces go to that many parts, largest first, each to the part that has least.

Defined cases: a null text has 0 bytes and is one group with the empty text; null ids sort first; wholly equal rows are
rows of a group like any other, and dealt by place if it is heavy; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, named, row_key, staged

LOTS_PER_SHARD = 128
PIECES_PER_SHARD = 64


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of vectors (lots x dimensions)."""
    shares = vectors / np.maximum(vectors.sum(0), 1) * shards
    left = np.ones((shards, shares.shape[1]))
    placed = np.zeros(len(shares), np.int64)
    for i in np.lexsort((np.arange(len(shares)), -shares.max(1))):
        score = left @ shares[i]
        fits = (left >= shares[i]).all(1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        placed[i] = int(score.argmax())
        left[placed[i]] -= shares[i]
    return placed


def units(pieces: list[tuple[int, int, int]], group_of: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """What is placed together, for pieces (lot, size, rows): a group's pieces, in as many even parts as it needs shards; other lots by themselves."""
    found = {lot: (lot, 0) for lot, _, _ in pieces}
    loads: dict[int, list[tuple[int, int, int]]] = {}
    for lot, size, n in sorted(pieces, key=lambda p: (-p[1], -p[2], p[0])):
        if lot in group_of:
            group, shares = group_of[lot]
            heap = loads.setdefault(group, [(0, 0, i) for i in range(shares)])
            at_size, at_n, part = heapq.heappop(heap)
            found[lot] = (group, part)
            heapq.heappush(heap, (at_size + size, at_n + n, part))
    return [found[lot] for lot, _, _ in pieces]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot): slots run from 0 without gaps in each shard."""
    spark = docs.sparkSession
    text = F.coalesce(named(text_col), F.lit(""))
    rows = staged(
        docs.select(
            named(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            row_key(text).alias("g"),
            # Written, so that all that follows sees the same.
            F.monotonically_increasing_id().alias("place"),
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    parts = shards * PIECES_PER_SHARD
    share = F.greatest(*[F.col(c) / float(max(total[c] or 0, 1)) for c in ("size", "tokens", "n")])
    # At most 3 * parts groups can be above 1 / parts of a total.
    heavy = rows.groupBy("g").agg(*sums).filter(share > 1.0 / parts).select("g", F.ceil(share * (parts * 2.0)).cast("int").alias("pieces"), F.ceil(share * shards).cast("int").alias("shares")).collect()
    lots, first, group_of = shards * LOTS_PER_SHARD, [], {}
    for row in sorted(heavy, key=lambda r: r["g"]):
        first.append((row["g"], lots, row["pieces"]))
        group_of |= dict.fromkeys(range(lots, lots + row["pieces"]), (lots, row["shares"]))
        lots += row["pieces"]
    own = F.broadcast(spark.createDataFrame(first, "_g struct<a: long, b: long>, _first int, _pieces int"))
    rows = (
        rows.join(own, F.col("g") == F.col("_g"), "left")
        .withColumn(
            "lot",
            F.when(F.col("_g").isNull(), F.pmod("g.a", F.lit(shards * LOTS_PER_SHARD)))
            .otherwise(F.col("_first") + F.pmod(F.xxhash64("place"), F.col("_pieces")))
            .cast("int"),
        )
        .drop("_g", "_first", "_pieces")
    )
    filled = rows.groupBy("lot").agg(*sums).orderBy("lot").collect()  # at most lots rows
    unit_of = units([(r["lot"], r["size"], r["n"]) for r in filled], group_of)
    names = sorted(set(unit_of))
    at = {u: i for i, u in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    np.add.at(vectors, [at[u] for u in unit_of], np.array([[r["size"], r["tokens"], r["n"]] for r in filled], float).reshape(-1, 3))
    placed = pack(vectors, shards)
    slots, place = [0] * shards, []
    for row, unit in zip(filled, unit_of, strict=True):
        shard = int(placed[at[unit]])
        place.append((row["lot"], shard, slots[shard]))
        slots[shard] += row["n"]
    side = F.broadcast(spark.createDataFrame(place, "_lot int, shard int, _slot long"))
    in_lot = F.row_number().over(Window.partitionBy("lot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("_nth", in_lot)
        .join(side, F.col("lot") == F.col("_lot"))
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("_slot") + F.col("_nth")).cast("long").alias("slot"))
    )


def op5_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
