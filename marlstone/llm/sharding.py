"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring of 64-bit hashes; a key belongs to the next point clockwise. Each shard has
a capacity. The keys between two points form an arc; all arcs offer their keys to their point's shard, which accepts in
the order of the ring until it is full; what is left of an arc continues to the next point, and so on until all are placed.

The walk needs only the number of keys of each arc, so it runs on shards * vnodes + 1 numbers, a bound set by parameters.
The rows themselves are ranked within their arcs by DataFrame operations (no task gathers an arc) and look up the interval
of ranks that their arc gave to a shard.

With ``slack`` 0 the capacities are exact quotas, so row counts differ by one at most; with a positive slack each shard
holds up to ceil((1 + slack) * rows / shards) and fewer keys move when shards come or go.

Nulls: a null key hashes like any other and overflows clockwise, so a heap of null keys spreads; a null text has no bytes.
Repeated rows each get a slot of their own. Whole texts are measured, however long. An empty table gives an empty result. Extra columns are kept by ``shard_documents``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, hint_if_small, materialize, running_totals

SHARDS = 40
VNODES = 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Sorted (point, shard) pairs; points are signed 64-bit."""
    digest = lambda s, v: hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest()
    return sorted((int.from_bytes(digest(s, v), "big", signed=True), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def route(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each arc: (first rank, end rank, shard, first slot) of each run of its keys. Arc len(points) lies after the last point."""
    n, filled, placed = len(points), [0] * len(room), {a: [] for a in counts}
    waiting = [(a, 0) for a in sorted(counts, key=lambda a: -1 if a == n else a)]
    for step in range(n + 1):
        left = []
        for arc, start in waiting:
            shard = points[(arc + step) % n][1]
            take = min(counts[arc] - start, room[shard] - filled[shard])
            if take:
                placed[arc].append((start, start + take, shard, filled[shard]))
                filled[shard] += take
            if start + take < counts[arc]:
                left.append((arc, start + take))
        if not left:
            return placed
        waiting = left
    raise ValueError("the shards' capacities are less than the rows")


def _arc(h: Column, points: list[tuple[int, int]]) -> Column:
    """How many points are less than the hash: a binary search in a literal array."""
    known = F.split(F.lit(",".join(str(p) for p, _ in points)), ",").cast("array<bigint>")
    steps = [1 << b for b in range(len(points).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(known, at + step - 1) < h, F.lit(False)), at + step).otherwise(at),
    )


def assign(keyed: DataFrame, key: str, ties: list[str], shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``keyed`` with columns ``home_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``ties`` orders rows whose keys hash alike; rows equal in all of them are interchangeable.
    """
    points = ring(shards, vnodes)
    h, arc, rank, unused = fresh(keyed, "_hash", "_arc", "_rank", "_unused")
    hashed = keyed.withColumn(h, F.xxhash64(F.col(key)))
    hashed = hashed.withColumn(arc, _arc(F.col(h), points))
    ranked = materialize(running_totals(hashed, [arc], [h, *ties], F.lit(0), "ring", (rank, unused)).drop(unused), "ranked")
    counts = {r[0]: r[1] for r in ranked.groupBy(arc).count().collect()}  # at most shards * vnodes + 1
    runs = route(counts, points, capacities(sum(counts.values()), shards, slack))
    rows = [(a, points[a % len(points)][1], [tuple(x) for x in v]) for a, v in sorted(runs.items())]
    table = keyed.sparkSession.createDataFrame(rows, "arc_ int, home_ int, runs_ array<struct<start_: bigint, end_: bigint, shard_: int, slot_: bigint>>")
    run = F.filter("runs_", lambda x: (x["start_"] <= F.col(rank)) & (F.col(rank) < x["end_"])).getItem(0)
    return (
        ranked.join(F.broadcast(table), F.col(arc) == F.col("arc_"), "left").withColumn(unused, run)
        .select(*keyed.columns, F.col("home_").alias("home_shard"), F.col(f"{unused}.shard_").alias("shard"), (F.col(f"{unused}.slot_") + F.col(rank) - F.col(f"{unused}.start_")).alias("slot"))
    )


def place(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot, grown_shard (null: the law is not by key), home_shard."""
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"))
    placed = assign(keyed, "doc_id", ["doc_id", "size", "text_crc32"], shards, vnodes, slack)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``shard``, ``slot`` (renamed with a leading ``_`` if taken)."""
    row, shard, slot, r, k, n = fresh(docs, "_row", "shard", "slot", "_r", "_k", "_n")
    known = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = known.select(F.col(row).alias("row_"), F.col(doc_id).alias("doc_id"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("crc"))
    placed = assign(keyed, "doc_id", ["doc_id", "crc", "row_"], shards, vnodes, slack).select(F.col("row_").alias(r), F.col("shard").alias(k), F.col("slot").alias(n))
    return known.join(hint_if_small(materialize(placed, "placed"), 500_000), F.col(row) == F.col(r)).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(k).alias(shard), F.col(n).alias(slot))
