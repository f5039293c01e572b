"""Operator 9: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt to shards by a hash and laid end to end in a seeded order within a shard, which
cuts into blocks of equal numbers of words. All blocks of the mix are apportioned to the sources by the
highest quotients target / (2k + 1), a source's blocks to its shards in the same way by their words, which gives
integer quotas; a shard then takes whole passes over its blocks and the rest by a seeded draw. A block may
begin or end within a document, which then gives those words only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.llm.common import documents, fresh, stored, word_count

#: No source's target, and no document's words, exceed so many times its size.
MOST = 3
SEED = 9


def apportion(targets: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest target / (2k + 1), k the seats so far; of equals, to the first."""
    total = sum(targets)
    if not total or seats <= 0:
        return [0] * len(targets)
    # A quota may fall short of its share by rounding; all but the last few seats are certain.
    got = [max(0, int(t * seats / total) - 1) for t in targets]
    left = seats - sum(got)
    heap = [(-t / (2 * k + 1), i) for i, (t, k) in enumerate(zip(targets, got, strict=True)) if t > 0]
    heapq.heapify(heap)
    for _ in range(left):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-targets[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; none above most times its size, the excess reshared by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def mixed_words(docs: DataFrame, block: int = 64, whole: bool = False, shard_rows: int = 4000, seed: int = SEED, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """doc_id, text_crc, source, size, source_size, target and taken: the words of each document that the mix takes.

    whole: documents are taken whole or not, with the block that holds their first word; otherwise a block
    gives its own words only. Sources go by code point, null last, and weigh the given numbers in turn. Only each
    source's and shard's sums reach the driver or one task. Null and wordless texts have size 0 and give nothing,
    a source without words has target 0, rows that repeat are laid out one after another, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc"), F.col("source").cast("string").alias("source"), word_count(text).alias("size")))
    known = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    known.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["words"] for r in known], [weights[i % len(weights)] for i in range(len(known))], most)
    seats = apportion(goal, round(sum(goal) / block))
    plan = spark.createDataFrame(
        [(r["source"], i, r["words"], goal[i], seats[i], -(-r["n"] // shard_rows)) for i, r in enumerate(known)],
        "_named string, _source int, source_size bigint, target double, _seats bigint, _shards int",
    )
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_named"])).drop("_named")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "text_crc", F.lit(seed)), "_shards").cast("int"))
    shards = rows.groupBy("_source", "_shard").agg(F.sum("size").alias("words"), F.first("_seats").alias("seats"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard")
        return pdf.assign(_quota=apportion(pdf["words"].astype(float).tolist(), int(pdf["seats"].iloc[0])))[["_source", "_shard", "_quota"]]

    quota = shards.groupBy("_source").applyInPandas(quotas, "_source int, _shard int, _quota bigint")
    names = ["doc_id", "text_crc", "source", "size", "source_size", "target"]

    def take(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("text_crc", "ascending")])
        size = t["size"].to_numpy()
        one = [t[c][0].as_py() for c in ("_source", "_shard", "_quota")]
        passes, extra = taken(size, one[2] * block, block, np.random.default_rng([seed, *one[:2]]), whole, most)
        return t.select(names).append_column("taken", pa.array(passes * size + extra))

    rows = rows.join(quota, ["_source", "_shard"]).withColumn("_order", F.xxhash64("doc_id", "text_crc", F.lit(seed + 1)))
    rows = rows.select(*names, "_source", "_shard", "_quota", "_order")
    out = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.groupBy("_source", "_shard").applyInArrow(take, out + ", taken bigint")


def taken(size: np.ndarray, want: int, block: int, rng: np.random.Generator, whole: bool, most: int = MOST) -> tuple[int, np.ndarray]:
    """Passes over a shard, and the words beyond them of each of its documents, laid out in the given order."""
    end = np.cumsum(size)
    words = int(end[-1])
    passes, rest = divmod(min(want, most * words), words) if words else (0, 0)
    n = -(-words // block)
    pick = rng.permutation(n)
    if whole:
        rank = np.zeros(n + 1, np.int64)
        rank[pick] = np.arange(n)
        order = np.argsort(rank[np.minimum((end - size) // block, n)], kind="stable")
        upto = np.cumsum(size[order])
        extra = np.zeros(len(size), np.int64)
        extra[order] = np.where(upto - size[order] / 2 <= rest, size[order], 0)
        return passes, extra if rest else 0 * extra
    part = np.zeros(n + 1, np.int64)
    part[pick] = np.diff(np.concatenate([[0], np.minimum(np.cumsum(np.minimum(block, words - pick * block)), rest)]))
    before = np.concatenate([[0], np.cumsum(part)])
    upto = before[end // block] + np.minimum(end % block, part[end // block])
    return passes, np.diff(np.concatenate([[0], upto]))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes its words; texts are never cut.

    Rows without words, null and empty texts among them, go: they add no words to a mix. Rows that repeat doc_id and text are
    taken alike, as often as the one of them that is taken most. Other columns keep their values, whatever their names. An
    empty table gives no rows.
    """
    ident, own, crc, times, copy = (fresh(c, docs.columns) for c in ("id", "own_crc", "crc", "times", "copy"))
    many = mixed_words(docs, block=1024, whole=True, seed=seed).where("taken > 0")
    many = many.groupBy(F.col("doc_id").alias(ident), F.col("text_crc").alias(crc)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(times))
    named = docs.withColumn(own, F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    out = named.join(many, named["doc_id"].eqNullSafe(many[ident]) & (named[own] == many[crc]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
