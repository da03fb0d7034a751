"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring; a key belongs to the first point clockwise of
its own position. A full shard takes no more: what is left of an arc continues clockwise to
the next point whose shard has room. With capacities that add up to the number of keys all
shards end within one key of each other, and a key moves only where its arc overflows.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from maskloom.llm.common import carried, given_back, numbered, saved

VIRTUAL_NODES = 64
ROWS_PER_BUCKET = 50_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Points ``(position, shard)`` in clockwise order; positions are signed 64-bit."""
    points = []
    for shard in range(shards):
        for copy in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{copy}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(points)


def bounded(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go, as ``(arc, low, high, shard, slot)``: the keys of the
    arc with rank ``low`` to ``high - 1`` lie in ``shard`` from ``slot`` on.

    Capacities differ by one at most and add up to the number of keys. Arcs are served in
    synchronous sweeps: in each, a shard takes what has reached its points, nearest travel
    first; the rest goes on to the next point. Works on counts, one per virtual node.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    moves = []
    # what waits at each point: (arc, low, high)
    waiting = [[(a, 0, n)] if n else [] for a, n in enumerate(counts)]
    while any(waiting):
        onward = [[] for _ in waiting]
        for point, groups in enumerate(waiting):
            shard = owners[point]
            for arc, low, high in groups:
                take = min(high - low, room[shard] - filled[shard])
                if take:
                    moves.append((arc, low, low + take, shard, filled[shard]))
                    filled[shard] += take
                if low + take < high:
                    onward[(point + 1) % len(waiting)].append((arc, low + take, high))
        waiting = onward
    return moves


def assign(
    docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", virtual_nodes: int = VIRTUAL_NODES
) -> DataFrame:
    """Adds ``shard`` and ``slot`` (place in the shard, gapless from 0), ``size`` (UTF-8 bytes
    of the text plus 1), ``text_crc32`` and ``law`` (``rows``: counts at most one apart).

    A row's position is a hash of its text, so equal texts are neighbours on the ring and
    share a shard unless it is full; a text that a third of the rows have is spread clockwise
    over as many shards as it needs. Null texts have size 1 and the CRC of the empty text.
    Ties at a position are ordered by a hash of ``key`` and then by a row number. Repeated
    rows and null keys are rows like others. The caller's columns come back but the text; an
    added column replaces one of its name. An empty table gives an empty table. The rows are
    ranked in hash buckets; one count per virtual node reaches the driver.
    """
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("shards and virtual nodes are positive")
    added = ["size", "text_crc32", "law", "shard", "slot"]
    select, _, names = carried(docs, [text, *added])
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        *select,
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(whole).alias("at"),
        F.xxhash64(F.col(f"`{key}`")).alias("mark"),
    )
    base = saved(numbered(base, "row"), "ring")
    points = ring(shards, virtual_nodes)
    places = [p for p, _ in points]
    buckets = max(1, -(-base.count() // ROWS_PER_BUCKET))
    # a position is cut into sub-buckets too, so a hot text fills no single one
    rows = base.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    fine = rows.groupBy("at", "salt").agg(F.count(F.lit(1)).alias("n"))
    fine = with_arc(fine, places).withColumn("part", F.floor(F.col("at") / F.lit(2.0**64 / buckets)))
    inside = Window.partitionBy("arc", "part").orderBy("at", "salt")
    per_part = fine.groupBy("arc", "part").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("arc", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    ranked = (
        fine.withColumn("upto", F.sum("n").over(inside) - F.col("n"))
        .join(starts, ["arc", "part"])
        .select("at", "salt", "arc", (F.col("upto") + F.col("start")).alias("first"))
    )
    counts = {r["arc"]: r["m"] for r in per_part.groupBy("arc").agg(F.sum("m").alias("m")).collect()}
    moves = bounded([counts.get(a, 0) for a in range(len(points))], [s for _, s in points], shards)
    spark = docs.sparkSession
    # at most one move per virtual node and sweep that fills a shard: a small table
    table = spark.createDataFrame(moves, "arc int, low long, high long, shard int, slot_start long")
    within = Window.partitionBy("at", "salt").orderBy("mark", "row")
    placed = (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(ranked, ["at", "salt"])
        .withColumn("rank", F.col("first") + F.col("place"))
    )
    moved = placed.join(
        F.broadcast(table.withColumnRenamed("arc", "_arc")),
        (F.col("arc") == F.col("_arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    moved = moved.withColumn("slot", F.col("slot_start") + F.col("rank") - F.col("low")).withColumn("law", F.lit("rows"))
    return given_back(moved, docs, names, {c: c for c in added})


def with_arc(rows: DataFrame, places: list[int]) -> DataFrame:
    """Adds ``arc``, the index of the first point clockwise of ``at``, by binary search; past
    the last point the ring starts again."""
    edges = [float("-inf"), *map(float, places), float("inf")]
    found = Bucketizer(splits=edges, inputCol="at_value", outputCol="arc").transform(
        rows.withColumn("at_value", F.col("at").cast("double"))
    )
    return found.withColumn("arc", F.col("arc").cast("int") % len(places)).drop("at_value")
