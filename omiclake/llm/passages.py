"""Operator 10: removes every byte covered by a long string that starts anywhere else, by suffix arrays.

No single machine can sort all suffixes, so windows that may be equal are brought together first. Every window of
the shortest length has an anchor, its 96-byte string of the least hash (of equals, the first), and equal windows have equal
anchors in the same place. A text's windows fall into runs of one anchor; a run has the bytes of its longest windows. Where an
anchor occurs in one run only, no window of it repeats, and nothing more is done with it; where all its runs are equal, all do.
The other anchors' distinct runs, with how often each occurs,
are sorted by the suffix array (linear grouping, module suffixes), whose neighbours tell which windows repeat, of every length
asked for. An anchor with very many distinct runs would make one task hold them all; its windows are counted one by one
instead, by their hashes.

Equal texts are one text with a count: what is removed depends on the text alone. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.llm.common import documents, fresh, mixed, prefix_hash, raw, small_batches, stored, window_hash
from omiclake.llm.suffixes import repeated_windows

LENGTH = 400
#: The shortest passage that the pipeline removes, and that the query counts beside its own length: 50 words of four letters and a space.
PASSAGE = 250
ANCHOR = 96
#: Distinct runs of an anchor that one suffix array takes; beyond, windows are counted by hash.
CROWD = 5000
#: Bytes that go into one suffix array, about.
BATCH = 1 << 20

RUN = "h bigint, ctx bigint, th bigint, nb bigint, s0 bigint, s1 bigint, a bigint"


def least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(v)
    x = np.concatenate([v, np.full((-n) % width, ~np.uint64(0))]).reshape(-1, width)
    to = np.minimum.accumulate(x, axis=1).ravel()
    since = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], to[width - 1 : n])


def runs(text: bytes, length: int = LENGTH, anchor: int = ANCHOR, longest: int = 0, block: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """Hash of the anchor, hash of the run's bytes (those of its longest windows), first and last window start, and anchor start, of each run of windows."""
    n = len(text)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    pre = prefix_hash(np.frombuffer(text, np.uint8))
    low = np.uint64((1 << 24) - 1)
    own = []
    for at in range(0, n - length + 1, block):  # window starts at to at + block - 1
        upto = min(n, at + block - 1 + length)
        start = np.arange(at, upto - anchor + 1)
        h = window_hash(pre, start, start + anchor)
        least = least_in_windows((h & ~low) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
        own.append((least & low).astype(np.int64) + at)
    a = np.concatenate(own)
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    s0, s1, a = cut, np.concatenate([cut[1:], [len(a)]]) - 1, a[cut]
    ctx = mixed(window_hash(pre, s0, np.minimum(n, s1 + max(length, longest))) + mixed((a - s0 + ((s1 - s0) << 32)).astype(np.uint64)))
    return window_hash(pre, a, a + anchor), ctx, s0, s1, a


def text_runs(texts: DataFrame, length: int, anchor: int, longest: int) -> DataFrame:
    """The runs of every text. A task gives those of a text that it meets again once more, so that they count as repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        for b in batches:
            parts = []
            for th, nb, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                met[th, nb] = met.get((th, nb), 0) + 1
                if nb >= length and met[th, nb] <= 2:
                    h, ctx, s0, s1, a = runs(t, length, anchor, longest)
                    parts.append([h.view(np.int64), ctx.view(np.int64), np.full(len(h), th), np.full(len(h), nb), s0, s1, a])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["h", "ctx", "th", "nb", "s0", "s1", "a"])

    return texts.select("th", "nb", "text").mapInArrow(run, RUN)


def ranges(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ascending starts, as first start and end of the bytes they cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def zipped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """th, nb, the compressed text z, and the columns keep under names of their own."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("th"), F.octet_length(t).cast("long").alias("nb"), t.alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    more = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([c.compress(t) for t in raw(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z, *b.columns[3:]], ["th", "nb", "z", *b.schema.names[3:]])

    return rows.mapInArrow(run, "th bigint, nb bigint, z binary" + more)


def repeated_ranges(docs: DataFrame, packed: DataFrame, lengths: tuple[int, ...] = (LENGTH,), anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """th, nb and cover, an array of (k, start, end): the bytes of each text that a repeated window of the k-th length covers. Ranges may overlap."""
    length, longest = min(lengths), max(lengths)
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(t).alias("th"), F.octet_length(t).cast("long").alias("nb"), t.alias("text"))
    every = stored(text_runs(texts, length, anchor, longest))
    # Most anchors occur once: their runs go no further. Counts are combined map-side; joins may split a hot anchor, as
    # nothing above them needs its rows together.
    shared = stored(every.groupBy("h").agg(F.count("*").alias("all")).where("all > 1").select("h"))
    own = stored(every.join(shared, "h"))
    each = own.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min("th").alias("first"))
    status = each.join(each.groupBy("h").agg(F.count("*").alias("m")), "h")
    again = own.join(status, ["h", "ctx"])
    ends = F.array(*[F.struct(F.lit(k).alias("k"), (F.least(F.col("s1"), F.col("nb") - x) + x).alias("end"), F.lit(x).alias("x")) for k, x in enumerate(lengths)])
    cover = again.where("n > 1").select("th", "nb", F.col("s0").alias("start"), F.inline(ends)).where("end - start >= x").select("th", "nb", "k", "start", "end")

    # One text stands for all that have an equal run; if it has the run twice, the search takes one of them.
    one = again.where((F.col("m") > 1) & ((F.col("n") == 1) | (F.col("th") == F.col("first"))))
    wanted = one.select("th", "nb", F.struct("h", "ctx", "n", "s0", "s1", "a", (F.col("m") > crowd).alias("crowded")).alias("run"))
    wanted = wanted.groupBy("th", "nb").agg(F.collect_set("run").alias("runs"))
    names = ["h", "ctx", "n", "th", "nb", "s0", "a", "starts", "crowded", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, d = set(), zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for th, nb, z, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (th, nb) not in met:
                    met.add((th, nb))
                    text = d.decompress(z, max_output_size=nb)
                    out += [(r["h"], r["ctx"], r["n"], th, nb, r["s0"], r["a"] - r["s0"], r["s1"] - r["s0"] + 1, r["crowded"], text[r["s0"] : r["s1"] + longest]) for r in own]
            if out:
                kinds = [pa.int64()] * 8 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    pieces = packed.join(wanted, ["th", "nb"]).select("th", "nb", "z", "runs").mapInArrow(cut, ", ".join(f"{c} bigint" for c in names[:8]) + ", crowded boolean, bytes binary")
    pieces = stored(pieces)
    sorted_pieces = pieces.where("not crowded").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "ctx")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and r[:2] == last:
                    continue  # an equal run, from a copy of the text
                if size > BATCH and r[0] != last[0]:
                    yield found(rows)
                    rows, size = [], 0
                last = r[:2]
                rows.append(r)
                size += len(r[-1])
        if rows:
            yield found(rows)

    def found(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for k, (x, every) in enumerate(zip(lengths, repeated_windows([(r[-1], r[6], r[2], r[7]) for r in rows], lengths), strict=True)):
            for r, starts in zip(rows, every, strict=True):
                s, e = ranges(starts, x)
                out.append([np.full(len(s), r[3]), np.full(len(s), r[4]), np.full(len(s), k), s + r[5], e + r[5]])
        th, nb, k, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(th), pa.array(nb), pa.array(k.astype(np.int32)), pa.array(start), pa.array(end)], ["th", "nb", "k", "start", "end"])

    cover = cover.union(sorted_pieces.mapInArrow(search, "th bigint, nb bigint, k int, start bigint, end bigint"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], [], [], []]
            for n, th, nb, s0, starts, data in zip(*(b.column(c).to_pylist() for c in ("n", "th", "nb", "s0", "starts", "bytes")), strict=True):
                for k, x in enumerate(lengths):
                    m = max(0, min(starts, len(data) - x + 1))
                    for o, v in zip(out, ([xxhash.xxh64_intdigest(data[i : i + x]) for i in range(m)], [k] * m, [n] * m, [th] * m, [nb] * m, range(s0, s0 + m)), strict=True):
                        o.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["w", "k", "n", "th", "nb", "start"])

    single = pieces.where("crowded").dropDuplicates(["h", "ctx"]).mapInArrow(windows, "w bigint, k int, n bigint, th bigint, nb bigint, start bigint")
    twice = single.groupBy("k", "w").agg(F.sum("n").alias("n")).where("n > 1").select("k", "w")
    size = F.get(F.array(*map(F.lit, lengths)), F.col("k"))
    cover = cover.union(single.join(twice, ["k", "w"], "left_semi").select("th", "nb", "k", "start", (F.col("start") + size).alias("end")))
    return cover.groupBy("th", "nb").agg(F.collect_set(F.struct("k", "start", "end")).alias("cover"))


def merged(cover: list[dict] | None, k: int = 0) -> list[tuple[int, int]]:
    """Maximal spans of overlapping or touching ranges of the k-th length, ascending."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in cover or () if r["k"] == k):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def with_cover(docs: DataFrame, keep: list[str], lengths: tuple[int, ...], anchor: int, crowd: int) -> DataFrame:
    small_batches(docs.sparkSession)
    packed = zipped(docs, keep)
    return packed.join(repeated_ranges(docs, packed, lengths, anchor, crowd), ["th", "nb"], "left").select("nb", "z", "cover", *[f"_{i}" for i in range(len(keep))])


def removed(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_bytes for every row of docs.

    n_passage_bytes counts the bytes that repeated strings of passage bytes cover; they aren't removed unless length covers them too.
    A null text counts as empty; texts shorter than length keep all. Rows that repeat, and equal texts of different
    rows, are occurrences of their own. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for nb, z, cover in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                spans = merged(cover)
                text = d.decompress(z, max_output_size=nb) if nb else b""
                out.append((nb, sum(e - s for s, e in spans), len(spans), hashlib.sha256(without(text, spans)).hexdigest(), sum(e - s for s, e in merged(cover, 1))))
            if out:
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(3), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_cover(docs, ["doc_id"], (length, passage), anchor, crowd).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint")


def deduplicated(docs: DataFrame, length: int = PASSAGE, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """docs with the kept bytes as text (bytes of cut characters go too) and, where there is such a column, n_chars anew.

    A null text stays null, an empty one empty; texts shorter than length keep all. Rows that repeat, and equal texts of
    different rows, are occurrences of their own. Rows stay, even if nothing of their text does. Other columns keep
    their values, whatever their names. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            texts = []
            for nb, z, cover in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                texts.append(without(d.decompress(z, max_output_size=nb) if nb else b"", merged(cover)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(texts, pa.string())], [*b.schema.names[3:], "text"])

    more = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(names))
    null = fresh("null", docs.columns)
    marked = docs.withColumn(null, F.col("text").isNull())
    out = with_cover(marked, [*names, null], (length,), anchor, crowd).mapInArrow(run, more + f"_{len(names)} boolean, text string")
    text: Column = F.when(F.col(f"_{len(names)}"), F.lit(None).cast("string")).otherwise(F.col("text"))
    back = {c: F.col(f"_{i}") for i, c in enumerate(names)} | {"text": text}
    if "n_chars" in back:
        back["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[back[c].alias(c) for c in docs.columns])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
