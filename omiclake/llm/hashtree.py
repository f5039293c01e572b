"""Operator 8: sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends regions, racks and shards. At each level every child draws -ln(u) / weight, u a hash of the
row's key and the child's path, and the least draw wins, so a child is taken in proportion to its
weight. A child's draws don't depend on its siblings: if a subtree's weight grows, rows move into it and
nowhere else; if it shrinks, rows leave it and no others move. A shard is added as a region of its own, whose subtree
holds nothing else, so that rows move into the new shard only. The law is `key`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omiclake.llm.common import documents

#: Regions, each a list of racks, each a list of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, rack: int = 5, racks: int = 2) -> Tree:
    """Shards 0 to shards - 1 of weight 1, in regions of so many racks of so many shards."""
    every = [(s, 1.0) for s in range(shards)]
    cut = [every[i : i + rack] for i in range(0, shards, rack)]
    return [cut[i : i + racks] for i in range(0, len(cut), racks)]


def grown(old: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, as a region of its own."""
    last = max((s for region in old for rack in region for s, _ in rack), default=-1)
    return [*old, [[(last + 1, weight)]]]


def _least(key: Column, children: Column, *path: Column) -> Column:
    """The number of the child that draws the least; of equals, the least number. children: structs of number c and weight w."""

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(len(path)), *path, child["c"], key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["w"]).alias("d"), child["c"].alias("c"))

    return F.array_min(F.transform(children, draw))["c"]


def _children(pairs: list[tuple[int, float]]) -> Column:
    kind = "array<struct<c:int,w:double>>"
    return F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in pairs]).cast(kind) if pairs else F.array().cast(kind)


def with_shard(df: DataFrame, key: str, t: Tree, name: str) -> DataFrame:
    """df with the shard of column key: the region first, then its rack, then the rack's shard.

    Weights must be positive; a subtree without shards isn't drawn.
    """
    weight = lambda rack: sum(w for _, w in rack)
    regions = _children([(r, sum(map(weight, region))) for r, region in enumerate(t) if any(region)])
    racks = F.array(*[_children([(i, weight(x)) for i, x in enumerate(region) if x]) for region in t])
    shards = F.array(*[F.array(*[_children(rack) for rack in region]) for region in t])
    k, r, i = F.col(key), F.col("_region"), F.col("_rack")
    df = df.withColumn("_region", _least(k, regions)).withColumn("_rack", _least(k, F.get(racks, r), r))
    return df.withColumn(name, _least(k, F.get(F.get(shards, r), i), r, i)).drop("_region", "_rack")


def sharded(docs: DataFrame, t: Tree, more: Tree | None = None, rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null without more).

    Slots number a shard's rows from 0 without gaps: rows are dealt to buckets by a hash, numbered within
    them, and a bucket begins where those before it end. No task holds a shard. rows: of a bucket, about.
    Null texts have size 16 and the crc of no bytes; a null doc_id is keyed by its text's crc; rows that
    repeat a doc_id go to the same shard with slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.xxhash64("doc_id") if docs.schema["doc_id"].dataType.simpleString() == "string" else F.col("doc_id").cast("long"), F.xxhash64("text_crc32"))
    out = with_shard(out.withColumn("_key", key), "_key", t, "shard")
    out = with_shard(out, "_key", more, "grown_shard") if more else out.withColumn("grown_shard", F.lit(None).cast("int"))
    shards = sum(len(rack) for region in t for rack in region)
    buckets = max(16, -(-docs.count() // (rows * shards)))
    out = out.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    before = out.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("_first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    out = out.withColumn("_place", place).join(before, ["shard", "_bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_place")).cast("long").alias("slot"), "grown_shard")


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(40)
    return sharded(documents(spark, sf_dir), t, grown(t))
