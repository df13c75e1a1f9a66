"""Dealing documents to shards of near equal bytes: longest processing time first, through a heap."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash63, number_in_key
from tidemark.session import cut_lineage

SHARDS = 16
#: Light groups are dealt by so many bundles.
BUNDLES = 1 << 16
#: A group above this part of all bytes is dealt on its own; there are at most as many.
HEAVY_PARTS = 1 << 14


def longest_first(sizes: dict[str, int], shards: int) -> dict[str, int]:
    """The shard of each unit: units by falling size, each to the shard with the least load so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def deal_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bundles: int = BUNDLES,
    heavy_parts: int = HEAVY_PARTS,
) -> DataFrame:
    """One row per row of ``docs`` with its shard and its slot there; equal texts share a shard.

    Groups of equal texts are the units that stay together. A group with more than 1 / ``heavy_parts`` of all bytes
    is a unit of its own; the others are hashed into ``bundles`` units. So the heap gets ``heavy_parts + bundles``
    units at most, whatever the table holds, and only their names and sizes reach the driver.

    A null text has no bytes and equals the empty text. Repeated rows and equal ids are dealt row by row; equal ids
    with equal texts take neighbouring slots. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        )
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(bundles)).cast("string"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    heavy = F.col("bytes") * heavy_parts > F.lit(total or 0)
    units = groups.select(F.when(heavy, F.col("key")).otherwise(bundle).alias("unit"), "bytes")
    sizes = {r.unit: r.bytes for r in units.groupBy("unit").agg(F.sum("bytes").alias("bytes")).collect()}
    dealt = longest_first(sizes, shards)
    spark = docs.sparkSession
    of_unit = spark.createDataFrame(list(dealt.items()), "unit string, shard int")
    # both sides of the lookup are bounded by the number of units
    own = of_unit.filter(~F.col("unit").startswith("b") | (F.length("unit") == 64)).select(
        F.col("unit").alias("key"), F.col("shard").alias("own_shard")
    )
    placed = (
        rows.join(F.broadcast(own), "key", "left")
        .withColumn("unit", F.when(F.col("own_shard").isNull(), bundle))
        .join(F.broadcast(of_unit), "unit", "left")
        .withColumn("shard", F.coalesce("own_shard", "shard"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", hash63("doc_id", "key").alias("_order"))
    )
    slotted = number_in_key(placed, ["shard"], [F.col("_order"), F.col("doc_id")], "slot", count)
    return slotted.drop("_order").withColumn("grown_shard", F.lit(None).cast("int"))
