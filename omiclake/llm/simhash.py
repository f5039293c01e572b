"""Operator 2: SimHash fingerprints, linked at a few differing bits by anchor-point covering.

A fingerprint is cut into three segments of 22, 21 and 21 bits; two that differ in at most 4 bits
differ in at most one bit of some segment. The anchors of a segment are the words of a covering code:
the product of the [15,11] and the [7,4] Hamming codes (covering radius 1 + 1). A segment's home is
its nearest anchor, within the radius 2; a fingerprint is replicated to every anchor within radius plus threshold,
2 + 1, of each segment. So of two that link, one's home holds the other too, and only homes are
compared with the others of an anchor. Anchors yield local groups, joined by their smallest member
(no pairs within a group), and star contraction joins those into components.

Only distinct fingerprints are compared: copies of a text are one. What an anchor holds is bounded by
the number of distinct fingerprints near it, not by rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from omiclake.llm.common import by_text, documents, fresh, mixed, raw, small_batches, stored

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2


def fingerprint(text: bytes, words: int = 4) -> int:
    """Of the lower-cased text's shingles of so many words, repeats included; 0 for a text without words."""
    w = text.lower().split()
    n = len(w)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= words:
        hashes = [h(b" ".join(w), SEED)]
    else:
        joined = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashes = [h(joined[i:j], SEED) for i, j in zip(start[: n - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)]
    planes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(planes[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


#: Bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, a long. A null text counts as empty."""
    return by_text(docs, lambda texts: {"fp": pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))}, "fp bigint")


def _syndromes() -> np.ndarray:
    """The 7-bit syndrome of each single-bit error in 22 bits: bits 0 to 14 [15,11], 15 to 21 [7,4]."""
    return np.array([i + 1 for i in range(15)] + [(i + 1) << 4 for i in range(7)], np.uint32)


def errors(radius: int) -> list[np.ndarray]:
    """For each syndrome, the error patterns of at most radius bits: v ^ e are the anchors so near to v."""
    s, out = _syndromes(), [[] for _ in range(128)]
    for k in range(radius + 1):
        for at in combinations(range(22), k):
            x = 0
            for i in at:
                x ^= int(s[i])
            out[x].append(sum(1 << i for i in at))
    return [np.array(x, np.uint32) for x in out]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (segment and anchor), the fingerprints replicated there, and whether it is their home."""
    share = threshold // len(SEGMENTS)
    near, s, bits = errors(RADIUS + share), _syndromes(), fps.view(np.uint64)
    keys, who, homes = [], [], []
    for k, (low, width) in enumerate(SEGMENTS):
        v = ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        syn = np.zeros(len(v), np.uint32)
        for i in range(width):
            syn ^= np.where((v >> np.uint32(i)) & np.uint32(1), s[i], np.uint32(0))
        for x in np.unique(syn):
            own = np.flatnonzero(syn == x)
            to = v[own][:, None] ^ near[x][None, :]
            keys.append((to.astype(np.int64) | (k << 22)).ravel())
            who.append(np.repeat(fps[own], to.shape[1]))
            homes.append(np.tile(np.arange(to.shape[1]) == 0, len(own)))  # patterns go by weight: the first is the home
    return np.concatenate(keys), np.concatenate(who), np.concatenate(homes)


def groups_at(fps: np.ndarray, home: np.ndarray, threshold: int, block: int = 1 << 21) -> np.ndarray:
    """For each fingerprint of an anchor, the place of the first one of its local group."""
    label, bits, own = np.arange(len(fps)), fps.view(np.uint64), np.flatnonzero(home)
    step = max(1, block // max(1, len(fps)))
    for i in range(0, len(own), step):
        rows = own[i : i + step]
        near = np.bitwise_count(bits[rows][:, None] ^ bits[None, :]) <= threshold
        for r in np.flatnonzero(near.sum(axis=1) > 1):
            found = np.unique(label[near[r]])
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
    return label


def links(distinct: DataFrame, threshold: int = 4, partitions: int | None = None) -> DataFrame:
    """u and v: stars that connect the distinct fingerprints fp that links connect, with no link within them lost."""
    spark = distinct.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, anchors(b.column(0).to_numpy(), threshold))), ["at", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        for b in batches:
            at, fp, home = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if rest:
                at, fp, home = (np.concatenate(x) for x in zip(rest, (at, fp, home), strict=True))
            cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1]) if len(at) else [0]
            rest = at[cut[-1] :], fp[cut[-1] :], home[cut[-1] :]
            yield stars(fp, home, [*cut])
        if rest:
            yield stars(rest[1], rest[2], [0, len(rest[1])])

    def stars(fp: np.ndarray, home: np.ndarray, cut: list[int]) -> pa.RecordBatch:
        u, v = [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1 and home[i:j].any():
                label = groups_at(fp[i:j], home[i:j], threshold)
                if len(far := np.flatnonzero(label != np.arange(j - i))):
                    u.append(fp[i:j][far])
                    v.append(fp[i:j][label[far]])
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or empty)), pa.array(np.concatenate(v or empty))], ["u", "v"])

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").mapInArrow(replicate, "at bigint, fp bigint, home boolean")
    found = spread.repartition(n, "at").sortWithinPartitions("at").mapInArrow(compare, "u bigint, v bigint")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def least_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label, where each place names a smaller one of its group or itself, after the edges u, v join groups: the smallest of each."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


#: Up to so many edges (4 MB) are joined by the driver, which takes no rounds; more stay distributed.
LOCAL = 1 << 18


def components(edges: DataFrame, most: int = 60, local: int = LOCAL) -> DataFrame:
    """node and root (the smallest node it reaches) for every node of the edges u, v, once each: star contraction.

    Each round turns every node to its smallest neighbour, first among the larger ones, then among the
    smaller. Rounds go to the shared folder; they end when a round changes nothing. A hot node's rows
    are counted map-side and its join can be split, so that no task must hold them all. Few edges take no rounds.
    """
    edges = stored(edges.select("u", "v"))
    if edges.count() <= local:
        got = edges.toArrow()
        ends = np.stack([got[c].to_numpy() for c in ("u", "v")]).astype(np.int64)
        node, at = np.unique(ends, return_inverse=True)
        root = node[least_labels(np.arange(len(node)), *at.reshape(2, -1))]
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node bigint, root bigint")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        edges = stored(small.select(F.col("m").alias("u"), "v").union(small.where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows come out as
    often; a null doc_id counts only where a component has no other. An empty table gives no rows.
    """
    fp = stored(fingerprints(docs, words))
    first = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(links(first, threshold))
    named = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fingerprints of a text in near_copies, which bring texts to anchors.
KINDS = 3
#: Odd multipliers, one for each bit of a text's sketch.
DRAWS = (mixed(np.arange(1, 129, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: The chance that a sketch parts two texts of just the similarity asked for, at most.
PARTED = 1e-12
#: Up to so many texts of an anchor's group are paired at once; larger groups are compared in blocks.
ALL_PAIRS = 6
#: Texts of a block, about.
BLOCK = 512


def hash_of_words(text: bytes) -> int:
    """Of the lower-cased words in order, as a signed long."""
    h = xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)
    return h - (h >> 63 << 64)


def word_sets(text: bytes) -> tuple[int, list[int]]:
    """A hash of the lower-cased words in order, and KINDS fingerprints over the distinct ones."""
    w = text.lower().split()
    own = [*set(w)]
    wide = b"".join([xxhash.xxh128_digest(x, SEED) for x in own] + [xxhash.xxh64_digest(x, SEED + 1) for x in own])
    cut = 16 * len(own)
    planes = np.concatenate([np.frombuffer(wide[:cut], np.uint8).reshape(-1, 16), np.frombuffer(wide[cut:], np.uint8).reshape(-1, 8)], axis=1)
    ones = np.concatenate([np.bincount(planes[:, i], minlength=256) @ BITS for i in range(8 * KINDS)])
    prints = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")
    return xxhash.xxh64_intdigest(b" ".join(w), SEED), prints.view(np.int64).tolist()


def shingles(text: bytes, words: int) -> bytes:
    """Sorted distinct 32-bit hashes of a text's shingles."""
    w = text.lower().split()
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = [0, *(end + 1).tolist()][:n]
    h = xxhash.xxh32_intdigest
    return np.unique(np.array([h(joined[i:j], SEED) for i, j in zip(start, end[words - 1 :].tolist() or [len(joined)], strict=True)], np.uint32)).tobytes()


def sketch(own: np.ndarray, block: int = 256) -> np.ndarray:
    """128 bits as two longs of a set of hashes: one bit of the least hash of each draw. Two sets of similarity s differ in each with chance (1 - s) / 2."""
    x = (mixed(own.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.min([(x[i : i + block] * DRAWS).min(axis=0) for i in range(0, len(x), block)], axis=0)
    return np.packbits((mixed(least.astype(np.uint64)) & np.uint64(1)).astype(bool), bitorder="little").view("<i8")


def sketch_bits(similarity: float, chance: float = PARTED, bits: int = 128) -> int:
    """The fewest differing bits that sketches of sets at least so similar exceed with that chance at most."""
    p, over = (1 - similarity) / 2, 0.0
    for k in range(bits, 0, -1):
        over += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if over > chance:
            return k
    return 0


def candidate_pairs(bits: np.ndarray, size: np.ndarray, home: np.ndarray, t: np.ndarray, similarity: float, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of an anchor's near pairs, and their kind: 0 of a small group, 1 a text of a large one with its leader, 2 a leader with the first one.

    Rows come by ascending size of their shingle sets. Near are those whose sizes allow the similarity, which loses none, and
    whose sketches (two rows of bits) do. In a large group each text not near an earlier leader becomes one, in the order of
    t, and every other that is at home here meets the first leader near it.
    """
    x, most = bits.view(np.uint64), sketch_bits(similarity)
    label, out, own = np.arange(len(t)), [np.zeros((0, 3), np.int64)], np.flatnonzero(home)

    def alike(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[0][i] ^ x[0][j]).astype(np.int16) + np.bitwise_count(x[1][i] ^ x[1][j]) <= most

    low, high = np.searchsorted(size, np.ceil(size[own] * similarity - 1e-9)), np.searchsorted(size, np.floor(size[own] / similarity + 1e-9), side="right")
    step = max(1, block // max(1, int((high - low).max(initial=1))))
    for at in range(0, len(own), step):
        many = (high - low)[at : at + step]
        i = np.repeat(own[at : at + step], many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many - low[at : at + step], many)
        near = alike(i, j) & (i != j)
        label = least_labels(label, i[near], j[near])
    grouped = np.flatnonzero(np.bincount(label, minlength=len(t))[label] > 1)
    grouped = grouped[np.lexsort((t[grouped], label[grouped]))]
    for own in np.split(grouped, np.flatnonzero(np.diff(label[grouped])) + 1) if len(grouped) else ():
        large = len(own) > ALL_PAIRS
        met = np.zeros(len(own), bool)
        for k, i in enumerate(own):
            if large and met[k]:
                continue
            rest = np.flatnonzero(~met[k + 1 :]) + k + 1 if large else np.arange(k + 1, len(own))
            j = own[rest]
            near = alike(i, j) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
            rest, j = rest[near], j[near]
            if large:
                met[rest] = True
                j = j[home[j]]
                if k:
                    out.append(np.array([[own[0], i, 2]]))
            out.append(np.stack([np.full(len(j), i), j, np.full(len(j), int(large))], axis=1))
    u, v, kind = np.concatenate(out).T
    return u, v, kind


def similar_in(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, similarity: float, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts of different roots that are so similar, as stars. side: 0 or 1; of two sides only texts across are compared."""
    n, size = len(sets), np.array(list(map(len, sets)))
    x = np.concatenate(sets)
    found, at, count = np.unique(x, return_inverse=True, return_counts=True)
    who, keep = np.repeat(np.arange(n), size), count[at] > 1
    # Shingles that one text alone has can't be shared.
    at, who = (np.cumsum(count > 1) - 1)[at[keep]], who[keep]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    a, b = (np.flatnonzero(side == k) for k in (0, 1)) if side.any() and not side.all() else (np.arange(n),) * 2
    shared = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, (first, first + width))
        has = np.zeros((n, width), np.float32)
        has[who[i:j], at[i:j] - first] = 1
        shared += has[a] @ has[b].T
    linked = (shared >= similarity * (size[a][:, None] + size[b][None, :] - shared) - 1e-4) & (root[a][:, None] != root[b][None, :])
    label = np.arange(n)
    for k in np.flatnonzero(linked.any(axis=1)):
        own = np.unique(label[np.concatenate([[a[k]], b[linked[k]]])])
        label[np.isin(label, own[1:])] = own[0]
    far = np.flatnonzero(label != np.arange(n))
    return label[far], far


def blockwise(clusters: DataFrame, root: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """u and v: stars that connect the texts t of a cluster c whose sets s are so similar, where roots don't yet.

    A cluster's texts outside its largest root are dealt to blocks by a hash, those of that root to others; each of the former
    meets every block, so that all pairs of different roots are compared, and none of the largest root with itself. A
    task holds two blocks at a time.
    """
    texts = clusters.join(root.withColumnRenamed("node", "t"), "t", "left").select("t", "c", F.coalesce("root", "t").alias("root"))
    count = texts.groupBy("c", "root").agg(F.count("*").alias("k"))
    most = count.groupBy("c").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all")).where("m.k < all")
    most = most.select("c", F.col("m.root").alias("major"), F.ceil((F.col("all") - F.col("m.k")) / block).alias("minors"), F.ceil(F.col("m.k") / block).alias("majors"))
    dealt = texts.join(most, "c").withColumn("is_major", F.col("root") == F.col("major"))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("t", F.lit(SEED)), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    own, minors = F.col("b"), F.col("minors")
    with_minors = F.transform(upto(minors), lambda j: F.when(j < own, pair(j, own, 1)).otherwise(pair(own, j, 0)))
    with_majors = F.transform(upto(F.col("majors")), lambda j: pair(own, minors + j, 0))
    meets = F.when(F.col("is_major"), F.transform(upto(minors), lambda i: pair(i, minors + own, 1))).otherwise(F.concat(with_minors, with_majors))
    met = dealt.select("t", "c", "root", F.explode(meets).alias("p")).select("c", "p.a", "p.b", "p.side", "t", "root").join(sets, "t")
    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != at:
                    yield found(rows)
                    at, rows = r[:3], []
                rows.append(r[3:])
        yield found(rows)

    def found(rows: list[tuple]) -> pa.RecordBatch:
        u = v = np.zeros(0, np.int64)
        if len(rows) > 1:
            side, t, own = (np.array(x) for x in list(zip(*rows, strict=True))[:3])
            i, j = similar_in([np.frombuffer(r[3], np.uint32) for r in rows], own, side, similarity)
            u, v = t[i], t[j]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    met = met.select("c", "a", "b", "side", "t", "root", "s").repartition(n, "c", "a", "b").sortWithinPartitions("c", "a", "b")
    return met.mapInArrow(compare, "u bigint, v bigint").distinct()


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id: documents whose shingle sets are so similar, or whose words are equal, are linked.

    Candidates come from anchor covering over fingerprints of a text's distinct words, which a few edits hardly change; texts
    that meet there are told apart by the sizes and the sketches of their shingle sets, so that unlike ones make no pairs however
    many texts there are. Each pair is then held exactly against the similarity of its shingle sets. Equal word sequences are one text.
    Of a large group each text is first held against its leader. What that links is contracted; then the texts outside the
    largest component of their groups are compared with all of the groups in blocks, which give links only.
    Null and wordless texts are one text, texts of fewer words one shingle. Beside them come t, the hash of the row's words, and
    root, which tells components apart where no row has a doc_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prints(texts: list[bytes]) -> dict:
        own, sets = [word_sets(t) for t in texts], [np.frombuffer(shingles(t, words), np.uint32) for t in texts]
        marks = [p + sketch(x).tolist() for (_, p), x in zip(own, sets, strict=True)]
        return {"t": pa.array(np.array([t for t, _ in own], np.uint64).view(np.int64)), "prints": pa.array(marks, pa.list_(pa.int64())), "size": pa.array([len(x) for x in sets], pa.int32())}

    known = stored(by_text(docs, prints, "t bigint, prints array<bigint>, size int"))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t, p, size = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, KINDS + 2), b.column(2).to_numpy()
                for k in range(KINDS):
                    order = np.argsort(p[:, k], kind="stable")
                    distinct, first, count = np.unique(p[order, k], return_index=True, return_counts=True)
                    at, who, home = anchors(distinct, len(SEGMENTS))
                    place = np.searchsorted(distinct, who)
                    times = count[place]
                    of = order[np.repeat(first[place], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    marked = size[of] << 1 | np.repeat(home, times)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, (np.repeat(at | k << 24, times), marked.astype(np.int32), t[of], p[of, KINDS], p[of, KINDS + 1]))), ["at", "size", "t", "x", "y"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            own = [b.column(i).to_numpy() for i in range(5)]
            if rest:
                own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
            cut = np.concatenate([[0], np.flatnonzero(own[0][1:] != own[0][:-1]) + 1]) if len(own[0]) else np.zeros(1, int)
            rest = [x[cut[-1] :] for x in own]
            yield found(own, cut.tolist())
        if rest:
            yield found(rest, [0, len(rest[0])])

    def found(own: list[np.ndarray], cut: list[int]) -> pa.RecordBatch:
        out = [np.zeros((0, 3), np.int64)]
        home = own[1] & 1 == 1
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1 and home[i:j].any():
                _, size, t, x, y = (c[i:j] for c in own)
                a, b, kind = candidate_pairs(np.stack([x, y]), size >> 1, home[i:j], t, similarity)
                out.append(np.stack([t[a], t[b], kind], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)  # a pair may meet at several anchors of a task
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], ["u", "v", "kind"])

    own = known.select("t", "prints", "size").dropDuplicates(["t"])
    spread = own.mapInArrow(replicate, "at bigint, size int, t bigint, x bigint, y bigint")
    pairs = stored(spread.repartition(n, "at").sortWithinPartitions("at", "size").mapInArrow(compare, "u bigint, v bigint, kind bigint").distinct())
    # Of a large group's leaders a text is held against the first one only, whatever the anchor.
    first = pairs.where("kind = 1").groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    tested = pairs.where("kind = 0").select("u", "v").union(first).distinct()

    def pack(texts: list[bytes]) -> dict:
        z = zstandard.ZstdCompressor(level=1)
        return {"t": pa.array([hash_of_words(t) for t in texts], pa.int64()), "z": pa.array([z.compress(t) for t in texts], pa.binary())}

    # The texts of candidates only, one for each word sequence, whatever the rows' doc_id.
    wanted = pairs.select(F.col("u").alias("t")).union(pairs.select(F.col("v").alias("t"))).distinct()
    texts = by_text(docs, pack, "t bigint, z binary", ()).join(wanted, "t", "left_semi").dropDuplicates(["t"])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            own = [shingles(d.decompress(z), words) for z in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["t", "s"])

    sets = stored(texts.mapInArrow(shingle, "t bigint, s binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("t").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("t").alias("v"), F.col("s").alias("sv")), "v")
        return both.select("u", "v", "su", "sv").mapInArrow(verify, "u bigint, v bigint")

    root = stored(components(verified(tested)).distinct())
    large = pairs.where("kind > 0").select("u", "v")
    if not large.isEmpty():
        links = blockwise(components(large).select(F.col("node").alias("t"), F.col("root").alias("c")).distinct(), root, sets, similarity)
        stars = root.where("node != root").select(F.col("root").alias("u"), F.col("node").alias("v"))
        root = stored(components(stars.union(links)).distinct())
    first = known.groupBy("t").agg(F.min("doc_id").alias("first"))
    named = first.join(root.withColumnRenamed("node", "t"), "t", "left").select("t", "first", F.coalesce("root", "t").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(named.join(least, "root").select("t", "root", "component_id"), "t").select("doc_id", "component_id", "t", "root")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each component: of its smallest doc_id (null only where there is no other), and there of the smallest t.

    Groups of near_copies name texts, so that rows without doc_id, or that share one with another text, stand for themselves.
    Groups without t and root name documents by doc_id alone. Rows that repeat doc_id and words are one; null and wordless texts
    are one text. Other columns keep their values, whatever their names. An empty table gives no rows.
    """
    if "root" not in groups.columns:
        keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
        return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept"]), "left_semi").dropDuplicates(["doc_id"])
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("m"))
    keep = least.select(F.col("m.doc_id").alias("_kept"), F.col("m.t").alias("_text"))
    small_batches(docs.sparkSession)
    own = fresh("t", docs.columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [hash_of_words(t) for t in raw(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(t, pa.int64())], [*b.schema.names[:-1], own])

    named = docs.withColumn(own, F.col("text").cast("string"))
    named = named.mapInArrow(add, StructType([*docs.schema.fields, StructField(own, LongType())]))
    same = (named[own] == keep["_text"]) & named["doc_id"].eqNullSafe(keep["_kept"])
    return named.join(keep, same, "left_semi").dropDuplicates([own]).drop(own)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
