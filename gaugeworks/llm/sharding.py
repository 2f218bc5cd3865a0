"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key belongs to the first virtual node at or after its place on the ring. Keys of one arc all meet the shards in the same order, so where a full
shard sends them is decided for arcs, from one load for each arc; which of an arc's rows go where follows from their order in the arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

SHARDS, NODES = 40, 128
#: Parts that an arc's rows are ranked in, and equal rows that share a place on the ring at most.
CELLS, CHUNK = 16, 10_000
LAWS = ("rows", "bytes")


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in order, and their shards. A shard's nodes lie where they lie for any number of shards."""
    at = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(nodes)]
    at.sort()
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def room(total: int, shards: int, law: str, slack: float) -> np.ndarray:
    """Load that each shard may hold: an equal part, enlarged by the slack. Without slack they add up to the total: counts are one apart at most."""
    if slack > 0:
        return np.full(shards, int(np.ceil(total / shards * (1 + slack))), np.int64)
    return total // shards + (np.arange(shards) < total % shards)


def flows(loads: np.ndarray, owners: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, shard, from, to): the part of an arc's load, in the order of its rows, that each shard takes.

    In hop h, what is left of each arc comes to the h-th shard clockwise; a shard without room for all takes arcs in ring order.
    """
    left, space, arcs = loads.copy(), capacity.copy(), len(owners)
    out = []
    ahead = np.arange(arcs)  # the virtual node that an arc's rest stands before
    tried = np.zeros((arcs, len(capacity)), bool)
    for _ in range(len(capacity)):
        for a in np.flatnonzero(left):
            while tried[a, owners[ahead[a]]]:
                ahead[a] = (ahead[a] + 1) % arcs
            s = owners[ahead[a]]
            tried[a, s] = True
            taken = min(left[a], space[s])
            if taken:
                start = loads[a] - left[a]
                out.append((int(a), int(s), int(start), int(start + taken)))
                left[a] -= taken
                space[s] -= taken
    return out


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "rows", slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """Each document with its shard and its slot there.

    law 'rows': a shard holds at most ceil(rows / shards * (1 + slack)) rows; without slack, counts are one apart at most. law 'bytes': the same of
    sizes, up to the last document of each arc that shards share. Null texts have 16 bytes. A row's place on the ring comes from its id (null: the
    empty text), size and checksum. Equal rows are added up before they meet and have a place for each CHUNK of them, so one key may hold any
    share of the rows. An empty table gives no row. Other columns are ignored.
    """
    if law not in LAWS or shards < 1 or slack < 0:
        raise ValueError(f"law {law}, {shards} shards, slack {slack}")
    places, owners = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for place in batches:
            yield pd.Series((np.searchsorted(places, place.to_numpy(np.int64)) % len(places)).astype(np.int32))

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.groupBy(*key).agg(F.count("*").alias("n"))
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)), lambda c: F.struct(c.alias("chunk"), F.least(F.col("n") - c * CHUNK, F.lit(CHUNK)).alias("n")))
    rows = rows.select(*key, F.inline(chunks)).withColumn("place", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", "chunk"))
    rows = rows.withColumn("arc", arc("place")).withColumn("cell", F.pmod(F.xxhash64("place"), F.lit(CELLS)))
    rows = Written(rows.withColumn("load", F.col("n") * (F.col("size") if law == "bytes" else 1)), "shard-keys").df

    sums = rows.groupBy("arc", "cell").agg(F.sum("n").alias("n"), F.sum("load").alias("load")).toPandas()  # shards * nodes * CELLS rows at most
    sums = sums.sort_values(["arc", "cell"])
    before = sums.groupby("arc")[["n", "load"]].cumsum() - sums[["n", "load"]]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(pd.DataFrame({"arc": sums["arc"].astype("int32"), "cell": sums["cell"].astype("int64"), "n0": before["n"].astype("int64"), "load0": before["load"].astype("int64")}), "arc int, cell long, n0 long, load0 long")
    loads = np.zeros(len(places), np.int64)
    np.add.at(loads, sums["arc"].to_numpy(np.int64), sums["load"].to_numpy(np.int64))
    parts = pd.DataFrame(flows(loads, owners, room(int(loads.sum()), shards, law, slack)), columns=["arc", "shard", "start", "stop"])
    parts = spark.createDataFrame(parts.astype({"arc": "int32", "shard": "int32"}), "arc int, shard int, start long, stop long")
    parts = parts.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "shard"))).alias("parts"))

    order = Window.partitionBy("arc", "cell").orderBy("place", *key, "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(offsets), ["arc", "cell"]).join(F.broadcast(parts), "arc")
    rows = rows.withColumns({"rank": F.col("n0") + F.coalesce(F.sum("n").over(order), F.lit(0)), "at": F.col("load0") + F.coalesce(F.sum("load").over(order), F.lit(0))})
    copies = rows.select(*key, "arc", "parts", "rank", "at", (F.col("load") / F.col("n")).cast("long").alias("each"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    copies = copies.withColumns({"rank": F.col("rank") + F.col("copy"), "at": F.col("at") + F.col("copy") * F.col("each")})
    held = F.filter("parts", lambda p: (p["start"] <= F.col("at")) & (F.col("at") < p["stop"]))
    placed = Written(copies.select(*key, "arc", "rank", F.element_at(held, 1)["shard"].alias("shard")), "shard-rows").df

    pieces = placed.groupBy("shard", "arc").agg(F.count("*").alias("n"), F.min("rank").alias("first"))  # a row for each pair of shard and arc
    base = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("shard", "arc", (base - F.col("first")).alias("shift"))
    slot = (F.col("rank") + F.col("shift")).alias("slot")
    return placed.join(F.broadcast(pieces), ["shard", "arc"]).select(*key, F.lit(law).alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
