"""Hierarchical weighted hash tree.

Regions hold racks, racks hold shards; a node's weight is the sum of the weights below it. A document draws for each
region: -ln(u) / weight, with u from a hash of its id and the region's number, which is exponential with
the weight as rate, so a region is the least with the share of its weight. Inside the region it draws for the racks, inside
the rack for the shards, each node with a hash of its own. A node's draw depends on its own weight alone: if
a shard's weight changes, only the draws of its region, rack and shard do, and rows move between that region and others,
or inside it. An added shard stands in a region of its own, so rows move only into it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch


def draw(key: Column, level: int, node: Column, weight: Column) -> Column:
    """Exponential draw of a node; 52 bits of the hash make a number in (0, 1). A node without weight never wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 12).cast("double")
    return F.when(weight > 0, -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight).otherwise(F.lit(float("inf")))


@dataclass
class Tree:
    """Shards' weights, filled into racks and regions in order of their numbers; ``added`` shards get a region each."""

    weights: Sequence[float]
    added: Sequence[float] = ()
    shards_per_rack: int = 4
    racks_per_region: int = 2

    def levels(self) -> list[list[tuple[int, ...]]]:
        """Regions as tuples of rack numbers, racks as tuples of shard numbers."""
        n = len(self.weights)
        racks = [tuple(range(i, min(n, i + self.shards_per_rack))) for i in range(0, n, self.shards_per_rack)]
        regions = [tuple(range(i, min(len(racks), i + self.racks_per_region))) for i in range(0, len(racks), self.racks_per_region)]
        for k in range(len(self.added)):
            regions.append((len(racks),))
            racks.append((n + k,))
        return [regions, racks]

    def shard_of(self, docs: DataFrame, key: str, out: str) -> DataFrame:
        """``docs`` with the column ``out``, the shard of ``key``: the least draw on each level below the node chosen before."""
        regions, racks = self.levels()
        shard_weights = [float(w) for w in (*self.weights, *self.added)]
        rack_weights = [sum(shard_weights[s] for s in rack) for rack in racks]
        region_weights = [sum(rack_weights[r] for r in region) for region in regions]
        at = None
        for level, (children, weights) in enumerate((([tuple(range(len(regions)))], region_weights), (regions, rack_weights), (racks, shard_weights))):
            # the j-th child of the node chosen above
            below = [F.lit(c) for c in children[0]] if at is None else [F.get(F.array(*[F.lit(c[j] if j < len(c) else None).cast("int") for c in children]), F.col(at)) for j in range(max(map(len, children)))]
            weight_of = F.array(*map(F.lit, weights))
            drawn = [F.struct(draw(F.col(key), level, node.cast("int"), F.coalesce(F.get(weight_of, node), F.lit(0.0))).alias("draw"), node.cast("int").alias("node")) for node in below]
            docs = docs.withColumn(f"{out}_{level}", (F.least(*drawn) if len(drawn) > 1 else drawn[0])["node"])
            at = f"{out}_{level}"
        return docs.withColumnRenamed(at, out).drop(f"{out}_0", f"{out}_1")


def assign_shards(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 50_000) -> DataFrame:
    """Shard of every document, its place there, and its shard if there were one more of weight 1.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard. Id and shards alone decide;
    a null id is a key like any other, rows that repeat an id share a shard. Null and empty texts count as empty, long ones whole; an
    empty table gives no rows; further columns are ignored. Places are numbered in buckets by row, so that no task holds
    a shard: a bucket's first place is the number of rows in the shard's buckets before it.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    facts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    facts = Tree(weights, [1.0]).shard_of(Tree(weights).shard_of(facts, "doc_id", "shard"), "doc_id", "grown_shard")
    rows = scratch.put("rows", facts.withColumn("rid", F.monotonically_increasing_id()))
    n_buckets = max(1, rows.count() // (len(weights) * per_bucket) + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    placed = rows.selectExpr("*", "row_number() over (partition by shard, bucket order by doc_id, rid) - 1 as place")
    return placed.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")
