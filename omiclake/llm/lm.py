"""Operator 1: scoring texts by online logistic context mixing over bytes.

A text is its lower-cased words, each ended by a space, and one end byte. Every bit is predicted from six hashed
contexts: the last one, two, three, four and six bytes of the word so far, and the whole word so far. Each context's slot
holds counts of both bits; their log odds are mixed by weights of a set that a gate chooses (bit place, and
how much the longest and the middle context have seen), and an adaptive probability map refines the mix. Bits add to
log10 probabilities, so total bits per byte follow.

A document belongs to one of a few classes by its commonest words (k-means over all training documents);
the class is part of each context, and its own probability is part of the score. These contexts don't
reach over a word's start, so within a class a word's spelling costs the same wherever it stands: words are counted over all
documents, costed once for each class, and looked up block by block. Counts come from all training documents
but one tenth, on whose words the weights and the map are then learned online, in the order met; tasks' weights
are averaged. A last gate mixes in the class's plain word frequencies.

Texts are then scored whole and in order (`Order`). A word is predicted by its spelling, by what follows the word before and the
two words before in the corpus, and by the text so far: its words, and what followed the word before in it. Weights follow, word by
word within a text, what each has done so far. Longer contexts: a text falls into passages, which end where two words
say so; a passage that other training documents have as well is also predicted as one. All weights depend on the
text before only, so that probabilities of texts add up to one at most.

The slots are of fixed size; what is gathered (words and passages with counts, and the blocks they occur in) grows with the
corpus and stays distributed.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.llm.common import documents, fold_of, mixed, powers, raw, small_batches, stored, window_hash

ORDERS = (1, 2, 3, 4, 6)
INPUTS = len(ORDERS) + 1
#: Slots of a context's table, as a power of two; slices that the counts travel in.
BITS, SLICES = 20, 64
#: The end of a text as a word of its own; words hold no white space.
END = "\n"
SETS, BINS = 8 * 4 * 4, 33
#: Where the bits before a bit lead within a context's slots.
NODE = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)
#: Level of a slot's confidence: unseen, little, some, much.
LEVEL = np.searchsorted(np.array([1, 10, 24]), np.arange(256), side="right")
#: Words to work on at once, and bytes of them.
WORDS, PIECE = 1 << 15, 1 << 16
FOLDS, HELD_OUT, MIXING = 10, 0, 1
#: A block of documents ends after so many of them, or so many bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 1 << 12, 1 << 23
#: Classes of documents; common words that tell them apart; steps of a vector's values, whole numbers of which sum alike in any order.
CLASSES, COMMON, STEPS = 8, 256, 1 << 14
#: Contexts over word starts: rows of the word before and of the two before, columns of the next; common words have their own, others share.
NEAR, FAR, NEXT = 1 << 11, 1 << 12, 1 << 9
#: Weights before a text's first word: spelling, word before, two before, text so far, and after the same word in it; how many words they count as.
PRIOR, HELD = np.array([0.6, 0.1, 0.05, 0.15, 0.1]), 16
#: A passage ends after a pair of words in so many, or with the text; its weight before a text's first passage, and how many that counts as.
PASSAGE, PASSAGE_PRIOR, PASSAGE_HELD = 32, 0.05, 2
#: Words to score at once, whole texts.
SPAN = 1 << 17
#: Of the C library, if it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory goes back to the system: Python workers stay for later tasks, and both allocators would keep hundreds of MB."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


class Classes:
    """The class of a document by the nearest of some centres, over square roots of its common words' counts."""

    def __init__(self, common: list[bytes]) -> None:
        self.place = {w: i for i, w in enumerate(common)}
        self.centres = np.zeros((CLASSES, COMMON))

    def vectors(self, block: Block) -> np.ndarray:
        """Of unit length, in STEPS; zeros for documents without a common word."""
        at = pc.index_in(block.words, value_set=pa.array(list(self.place), pa.binary())).fill_null(-1).to_numpy()[block.word]
        on = at >= 0
        n = np.bincount(block.doc[on] * COMMON + at[on], block.times[on], len(block.size) * COMMON).astype(float).reshape(-1, COMMON)
        n /= np.maximum(n.sum(axis=1, keepdims=True), 1)
        np.sqrt(n, out=n)
        n *= STEPS
        return np.rint(n, out=n)

    def of(self, block: Block) -> np.ndarray:
        """Products of whole numbers, which are the same however documents lie in blocks."""
        return (self.vectors(block) @ self.centres.T).argmax(axis=1)


class Block:
    """Some documents as counts of numbered words: id, fold, bytes and number of distinct words of each, and the words."""

    def __init__(self, docs: bytes, bags: bytes | tuple[np.ndarray, ...] | None, words: bytes | None = None) -> None:
        docs = unpacked(docs)
        self.ident, self.fold, self.bytes, self.size = docs.column(0), *(docs.column(i).to_numpy() for i in (1, 2, 3))
        if isinstance(bags, bytes):
            bags = self.size, *(unpacked(bags).column(i).to_numpy() for i in (0, 1))
        if bags is not None:
            self.size, self.word, self.times = bags
            self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.words = unpacked(words).column(0) if words is not None else None

    @classmethod
    def whole(cls, docs: bytes, words: bytes, ordered: bytes, bags: bool = True) -> tuple[Block, np.ndarray, np.ndarray]:
        """Of stored cells, in which docs tells each document's words, not its distinct ones; those numbers, and all words in order.

        bags: whether the block gets its documents' counts.
        """
        length, number = unpacked(docs).column(3).to_numpy(), unplaned(ordered)
        return cls(docs, bagged(length, number, unpacked(words).num_rows) if bags else None, words), length, number


def packed(**columns) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def planes(number: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, then the next."""
    return zstandard.ZstdCompressor(level=1).compress(number.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def ordered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts' distinct words, END among them; each text's number of words and then END, and all their numbers in order."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words = found.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy())[some.to_numpy(zero_copy_only=False)]
    words = pa.concat_arrays([words.filter(some), pa.array([END.encode()] * len(texts), pa.binary())]).dictionary_encode()
    length = np.bincount(text, minlength=len(texts)) + 1
    number = np.empty(len(words), np.int64)
    number[np.concatenate([np.arange(len(text)) + text, np.cumsum(length) - 1])] = words.indices.to_numpy()
    return words.dictionary, length, number


def bags(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct words, END among them, and each text's in turn: how many, their numbers and their counts."""
    words, length, number = ordered(texts)
    return words, *bagged(length, number, len(words))


def bagged(length: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair = np.repeat(np.arange(len(length)) * n, length)
    pair += number
    pair.sort()
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    at = np.flatnonzero(new)
    times, pair = np.diff(at, append=len(pair)), pair[at]
    return np.bincount(pair // max(n, 1), minlength=len(length)), pair % max(n, 1), times


def blocks(docs: DataFrame) -> DataFrame:
    """All documents cut into blocks once, stored: _block, and docs, words and ordered of a Block. Texts aren't read again."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, docs, size, n = TaskContext.get().partitionId(), [], 0, 0, 0

        def block() -> pa.RecordBatch:
            ids, folds, lengths, found = zip(*held, strict=True)
            words = pa.concat_arrays([w for w, *_ in found]).dictionary_encode()
            start = np.cumsum([0, *(len(w) for w, *_ in found)])
            cells = [
                packed(doc_id=pa.concat_arrays(ids), fold=np.concatenate(folds), bytes=np.concatenate(lengths), length=np.concatenate([x for _, x, _ in found])),
                packed(word=words.dictionary),
                planes(np.concatenate([words.indices.to_numpy()[i + x] for i, (_, _, x) in zip(start, found, strict=False)])),
            ]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), *(pa.array([x], pa.binary()) for x in cells)], ["_block", "docs", "words", "ordered"])

        for b in batches:
            if b.num_rows:
                ids = b.column(0)
                folds = np.array([fold_of(i, FOLDS) for i in ids.to_pylist()], np.int8)
                lengths = pc.binary_length(b.column(1)).to_numpy().astype(np.int64)
                held.append((ids, folds, lengths, ordered(b.column(1))))
                docs, size = docs + b.num_rows, size + int(lengths.sum())
                if docs >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    held, docs, size, n = [], 0, 0, n + 1
                    give_back()
        if held:
            yield block()
        held = []
        give_back()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return stored(docs.select("doc_id", text).mapInArrow(run, "_block bigint, docs binary, words binary, ordered binary"))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Blocks of rows with _block, docs, words and ordered, one at a time: a block is emptied before the next is read."""
    give_back()
    for b in batches:
        for i in range(b.num_rows):
            at, *cells = (c[i].as_py() for c in b.columns)
            yield at, (block := Block.whole(*cells)[0])
            vars(block).clear()
            give_back()


def classes(docs: DataFrame) -> Classes:
    """Fitted on all training documents."""
    return classes_of(blocks(docs))


def classes_of(found: DataFrame, rounds: int = 20) -> Classes:
    """The words that most training documents have, then k-means, seeded by draws in proportion to the distance.

    found: blocks. Only the common words, a candidate or sums of each task reach the driver; documents' vectors are
    stored, some to a row.
    """
    own = found.select("_block", "docs", "words", "ordered")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in each(batches):
            n = np.bincount(block.word[block.fold[block.doc] != HELD_OUT], minlength=len(block.words))
            on = np.flatnonzero(n)
            words = block.words.take(pa.array(on))
            yield pa.RecordBatch.from_arrays([words, pa.array(n[on])], ["w", "n"])

    common = own.mapInArrow(spread, "w binary, n bigint").where(F.col("w") != F.lit(END.encode())).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(COMMON)
    gate = Classes([bytes(r["w"]) for r in common.collect()])

    def vectors(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for _, block in each(batches):
            x = gate.vectors(block)[block.fold != HELD_OUT].astype(np.int16)
            x = x[x.any(axis=1)]
            for i in range(0, len(x), rows):
                yield pa.RecordBatch.from_arrays([pa.array([z.compress(x[i : i + rows].tobytes())], pa.binary())], ["x"])

    known = stored(own.mapInArrow(vectors, "x binary"))

    def of_all(fn, join):
        """fn of some documents' vectors, joined within tasks and then here; None without any."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = zstandard.ZstdDecompressor()
            some = (np.frombuffer(d.decompress(x), np.int16).reshape(-1, COMMON).astype(float) for b in batches for x in b.column(0).to_pylist())
            for y in [reduce(join, map(fn, some), None)]:
                if y is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(y)], pa.binary())], ["y"])

        return reduce(join, (pickle.loads(r["y"]) for r in known.mapInArrow(run, "y binary").collect()), None)

    centres = np.zeros((0, COMMON))

    def sums(x: np.ndarray) -> np.ndarray:
        nearest = (x @ centres.T).argmax(axis=1) if len(centres) else np.zeros(len(x), int)
        return ((np.arange(CLASSES)[:, None] == nearest).astype(float) @ x).astype(np.int64)

    def seed(x: np.ndarray) -> tuple[float, bytes]:
        far = np.maximum(0, 1 - (x @ centres.T).max(axis=1) / STEPS**2)
        rows = [r.tobytes() for r in x.astype(np.int16)]
        draw = np.array([(xxhash.xxh64_intdigest(r, len(centres)) + 1) / (1 << 64) for r in rows])
        key = np.where(far > 1e-3, -np.log(draw) / np.maximum(far, 1e-3), np.inf)
        return min(zip(key.tolist(), rows, strict=True))

    def least(a: tuple | None, b: tuple) -> tuple:
        return b if a is None else min(a, b)

    def summed() -> np.ndarray:
        out = of_all(sums, lambda a, b: b if a is None else a + b)
        return np.zeros((CLASSES, COMMON), np.int64) if out is None else out

    def unit(x: np.ndarray) -> np.ndarray:
        return np.rint(x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9) * STEPS)

    mean = summed()[:1]
    if mean.any():
        centres = unit(mean)
        while len(centres) < CLASSES and (drawn := of_all(seed, least))[0] < np.inf:
            centres = np.concatenate([centres, unit(np.frombuffer(drawn[1], np.int16).astype(float))[None, :]])
        for _ in range(rounds):
            now = summed()[: len(centres)]
            now = np.where(now.any(axis=1, keepdims=True), unit(now), centres)
            if (now == centres).all():
                break
            centres = now
    gate.centres[: len(centres)] = centres / STEPS
    return gate


def gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows or more, but for the last."""
    held: list[pa.RecordBatch] = []
    give_back()
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            b, held = pa.concat_batches(held), []
            yield b
            give_back()
    if held:
        yield pa.concat_batches(held)
        give_back()


class Tokens:
    """The bytes of many words: for each byte to predict, its word and the six context hashes before it."""

    def __init__(self, words: list[bytes], kinds: np.ndarray) -> None:
        data = np.frombuffer(b"".join([w if w == b"\n" else w + b" " for w in words]), np.uint8)
        size = np.fromiter((len(w) + (w != b"\n") for w in words), np.int64, len(words))
        self.word = np.repeat(np.arange(len(words)), size)
        self.byte = data.astype(np.int64)
        start = np.repeat(np.cumsum(size) - size, size)
        kind = kinds.astype(np.uint64)[self.word] + np.uint64(1)
        place = np.arange(len(data)) - start
        wide = data.astype(np.uint64) + np.uint64(1)
        # Slots are numbered below 2**31.
        self.place = np.empty((INPUTS, len(data)), np.int32)

        def keep(i: int, h: np.ndarray) -> None:
            np.add(h >> np.uint64(64 - BITS), np.uint64(i << BITS), out=self.place[i], casting="unsafe")

        so_far = kind.copy()
        for k in range(1, max(ORDERS) + 1):
            back = np.zeros(len(data), np.uint64)
            back[k:] = wide[:-k]
            back[place < k] = 0
            so_far = so_far * np.uint64(257) + back
            if k in ORDERS:
                keep(ORDERS.index(k), mixed(so_far * np.uint64(8) + np.uint64(k)))
        # Before byte i of a word: the sum over its first i bytes of byte times power of the place within the word.
        total = np.concatenate([[np.uint64(0)], np.cumsum(wide * powers(int(place.max()) + 1 if len(place) else 1)[place])])
        keep(INPUTS - 1, mixed(mixed(total[:-1] - total[start]) + kind))

    def slots(self, bit: int, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot numbers (inputs by bytes), the bits, and the bits before them with a leading one."""
        byte = self.byte[at]
        node = (byte | 256) >> (8 - bit)
        return self.place[:, at] ^ NODE[node], (byte >> (7 - bit)) & 1, node

    def pieces(self) -> Iterator[slice]:
        return (slice(i, i + PIECE) for i in range(0, len(self.byte), PIECE))


class Model:
    """Log odds (1/256ths) and confidence of each slot, mixing weights, and the probability map."""

    def __init__(self, odds: np.ndarray, seen: np.ndarray) -> None:
        self.odds, self.seen = odds, seen
        self.weights = np.full((SETS, INPUTS + 1), 0.3)
        self.weights[:, -1] = 0
        self.map = np.zeros((256, BINS, 2))
        self.plain, self.in_class = 0.0, np.ones(CLASSES)

    def inputs(self, slot: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds (inputs by bytes) and the weight set of each byte."""
        level = lambda k: LEVEL[self.seen[slot[k]]]
        return self.odds[slot] * (1 / 256), (bit * 4 + level(INPUTS - 1)) * 4 + level(INPUTS - 3)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(self.weights.T)
        z = w[INPUTS][gate]
        for k in range(INPUTS):
            z += x[k] * w[k][gate]
        return np.clip(z, -12, 12)

    def learn(self, t: Tokens, times: np.ndarray, rate: float = 0.2, step: int = 1024) -> np.ndarray:
        """Online: each few bytes are predicted with the weights so far, which then follow the error. Returns the mass by set."""
        mass = np.zeros(SETS)
        for i in range(0, len(t.byte), step):
            at = slice(i, i + step)
            m = times[t.word[at]]
            for bit in range(8):
                slot, y, _ = t.slots(bit, at)
                x, gate = self.inputs(slot, bit)
                error = (y - 1 / (1 + np.exp(-self.mix(x, gate)))) * m
                own = np.bincount(gate, m, SETS)
                for k in range(INPUTS + 1):
                    self.weights[:, k] += rate * np.bincount(gate, error * x[k] if k < INPUTS else error, SETS) / np.maximum(own, 1)
                mass += own
        return mass

    def observe(self, t: Tokens, times: np.ndarray) -> None:
        """Counts both bits by the bits before and the mix, for the probability map."""
        for at in t.pieces():
            for bit in range(8):
                slot, y, node = t.slots(bit, at)
                z = self.mix(*self.inputs(slot, bit))
                np.add.at(self.map, (node, self.bin(z), y), times[t.word[at]])

    @staticmethod
    def bin(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(z * 2).astype(np.int64) + BINS // 2, 0, BINS - 1)

    def cost(self, words: list[bytes], kinds: np.ndarray, fit: np.ndarray) -> np.ndarray:
        """log10 of each word's probability in its class, its end included: the bits' and the plain frequency, mixed."""
        return np.log10((1 - self.plain) * 10 ** np.maximum(self.bits(words, kinds), -300) + self.plain * fit / self.in_class[kinds] + 1e-300)

    def bits(self, words: list[bytes], kinds: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """log10 of the product of each word's bit probabilities."""
        out = np.zeros(len(words))
        centre = 1 / (1 + np.exp(-(np.arange(BINS) - BINS // 2) / 2))
        refined = (self.map[:, :, 1] + 8 * centre) / (self.map.sum(axis=2) + 8)
        for i in range(0, len(words), block):
            t = Tokens(words[i : i + block], kinds[i : i + block])
            bits = np.zeros(len(t.byte))
            for bit in range(8):
                slot, y, node = t.slots(bit, slice(None))
                z = self.mix(*self.inputs(slot, bit))
                p = np.clip((1 / (1 + np.exp(-z)) + refined[node, self.bin(z)]) / 2, 1e-6, 1 - 1e-6)
                bits += np.log10(np.where(y == 1, p, 1 - p))
            out[i : i + block] = np.bincount(t.word, bits, len(words[i : i + block]))
        return out


def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal keys stand before each, and a number of each key, below the count of all."""
    n = len(key)
    bits = n.bit_length()
    if n and int(key.max()) < 1 << (62 - bits):
        k = np.sort((key << bits) | np.arange(n))
        at = k & ((1 << bits) - 1)
        k >>= bits
    else:
        at = np.argsort(key, kind="stable")
        k = key[at]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    run, before, number = np.cumsum(new) - 1, np.empty(n, np.int64), np.empty(n, np.int64)
    before[at] = np.arange(n) - np.flatnonzero(new)[run]
    number[at] = run
    return before, number


def word_hashes(words: pa.Array) -> np.ndarray:
    """window_hash of each word's bytes, by powers of the place within the word: no table is longer than the longest word."""
    out = np.empty(len(words), np.uint64)
    for i in range(0, len(words), WORDS):
        some = words[i : i + WORDS]
        size = pc.binary_length(some).to_numpy().astype(np.int64)
        data, start = np.frombuffer(b"".join(raw(some)), np.uint8), np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(start, size)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[place], out=sums[1:])
        out[i : i + WORDS] = mixed(sums[start + size] - sums[start] + size.astype(np.uint64))
    return out


class Order:
    """A block's words as they follow each other: rows and columns of the contexts over word starts, and passages."""

    def __init__(self, block: Block, length: np.ndarray, number: np.ndarray, gate: Classes) -> None:
        self.block, self.length, self.number = block, length, number
        self.end = np.cumsum(self.length)
        own = pa.array([END.encode(), *gate.place], pa.binary())
        at = pc.index_in(block.words, value_set=own).fill_null(-1).to_numpy()
        self.hash = word_hashes(block.words)
        #: By word, and a last one for a text's start, which is row 0.
        rest = self.hash >> np.uint64(8)
        self.row = np.append(np.where(at >= 0, at + 1, COMMON + 2 + (rest % np.uint64(NEAR - COMMON - 2)).astype(np.int64)), 0)
        self.column = np.where(at >= 0, at, COMMON + 1 + (rest % np.uint64(NEXT - COMMON - 1)).astype(np.int64))
        self.last = at == 0

    def spans(self) -> Iterator[Span]:
        """Whole texts, SPAN words or the least more."""
        i = 0
        while i < len(self.length):
            j = max(i + 1, int(np.searchsorted(self.end, self.end[i] - self.length[i] + SPAN, side="right")))
            yield Span(self, i, j)
            i = j


class Span:
    """Some whole texts of a block, word by word."""

    def __init__(self, of: Order, i: int, j: int) -> None:
        self.texts, length = slice(i, j), of.length[i:j]
        self.word = of.number[of.end[i] - of.length[i] : of.end[j - 1]]
        self.text = np.repeat(np.arange(j - i), length)
        start = np.cumsum(length) - length
        self.start = start[self.text]
        self.place = np.arange(len(self.word)) - self.start
        before = np.full(len(self.word), len(of.hash))
        before[1:] = self.word[:-1]
        before[start] = len(of.hash)
        near = of.row[before]
        before = np.zeros(len(near), np.int64)
        before[1:] = near[:-1]
        before[start] = 0
        far = (mixed((before * NEAR + near).astype(np.uint64) + np.uint64(1)) >> np.uint64(52)).astype(np.int64)
        self.column = of.column[self.word]
        #: Cells of both contexts.
        self.near, self.far = near * NEXT + self.column, (NEAR + far) * NEXT + self.column
        # Passages: where they end, and a hash of their words.
        h = of.hash[self.word]
        pair = h.copy()
        pair[1:] += h[:-1] * np.uint64(3)
        pair[start] = h[start]
        self.ends = np.flatnonzero((mixed(pair) % np.uint64(PASSAGE) == 0) | of.last[self.word]) + 1
        self.begins = np.concatenate([[0], self.ends[:-1]])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(len(h)))])
        self.passage = window_hash(sums, self.begins, self.ends)
        self.passage_text = self.text[self.begins]


def in_order(batches: Iterator[pa.RecordBatch], gate: Classes) -> Iterator[tuple[int, Order]]:
    """Of rows with _block, docs, words and ordered; blocks without their documents' counts, each emptied before the next is read."""
    give_back()
    for b in batches:
        for i in range(b.num_rows):
            at, *cells = (c[i].as_py() for c in b.columns)
            yield at, (order := Order(*Block.whole(*cells, bags=False), gate))
            vars(order).clear()
            give_back()


class Follow:
    """Of each context over word starts, how often each column followed in the training documents; how many passages these have."""

    CELLS = (NEAR + FAR) * NEXT

    def __init__(self, n: np.ndarray) -> None:
        self.passages = int(n[-1])
        cells = n[:-1].reshape(-1, NEXT)
        #: Of each column, in all.
        self.all = cells[:NEAR].sum(axis=0).astype(float)
        total = cells.sum(axis=1, keepdims=True)
        self.met = total[:, 0] > 0
        self.share = (cells / np.maximum(total, 1)).astype(np.float32).ravel()


def follow(found: DataFrame, gate: Classes) -> Follow:
    """found: blocks. Counts of all training documents; sums of slices reach the driver."""
    shared, width = found.sparkSession.sparkContext.broadcast(gate), Follow.CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(Follow.CELLS + 1, np.int64)
        for _, order in in_order(batches, shared.value):
            for x in order.spans():
                learned = order.block.fold[x.texts] != HELD_OUT
                on = learned[x.text]
                for cells in (x.near, x.far):
                    np.add.at(n, cells[on], 1)
                n[-1] += int(learned[x.passage_text].sum())
            x = None  # it has a view of the block's words
        for i in range(SLICES + 1):
            if (part := n[i * width : (i + 1) * width]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(n=part)], pa.binary())], ["slice", "n"])

    def total(t: pa.Table) -> pa.Table:
        n = sum(unpacked(x).column(0).to_numpy() for x in t["n"].to_pylist())
        return pa.table({"slice": t["slice"][:1], "n": pa.array([packed(n=n)], pa.binary())})

    n = np.zeros(Follow.CELLS + 1, np.int64)
    own = found.select("_block", "docs", "words", "ordered").mapInArrow(count, "slice int, n binary")
    for r in own.groupBy("slice").applyInArrow(total, "slice int, n binary").collect():
        n[r["slice"] * width : (r["slice"] + 1) * width] = unpacked(bytes(r["n"])).column(0).to_numpy()
    return Follow(n)


PASSAGES = np.dtype([("hash", np.uint64), ("n", np.int64)])


def repeated_passages(found: DataFrame, gate: Classes) -> DataFrame:
    """_block and passages: those of a block that training documents have and that occur twice or more, with their training counts."""
    shared = found.sparkSession.sparkContext.broadcast(gate)
    # Each part of the hashes gets about as much as eight blocks have.
    parts = max(8, found.count() // 8)
    entry = np.dtype([("hash", np.uint64), ("n", np.int32), ("all", np.int32)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for name, order in in_order(batches, shared.value):
            got = [(x.passage, order.block.fold[x.texts][x.passage_text] != HELD_OUT) for x in order.spans()]
            h, at, n = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True, return_counts=True)
            out = np.empty(len(h), entry)
            out["hash"], out["n"], out["all"] = h, np.bincount(at, np.concatenate([x for _, x in got])), n
            part = (h % np.uint64(parts)).astype(np.int64)
            out = out[np.argsort(part, kind="stable")]
            names, n = np.unique(part, return_counts=True)
            rows = [z.compress(x.tobytes()) for x in np.split(out, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(rows), name)), pa.array(rows, pa.binary())], ["part", "_block", "passages"])

    def meet(t: pa.Table) -> pa.Table:
        out = met(t)
        give_back()
        return out

    def met(t: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        rows = [np.frombuffer(d.decompress(x), entry) for x in t["passages"].to_pylist()]
        x, block = np.concatenate(rows), np.repeat(t["_block"].to_numpy(), [len(r) for r in rows])
        h, at = np.unique(x["hash"], return_inverse=True)
        n, every = np.bincount(at, x["n"]).astype(np.int64), np.bincount(at, x["all"])
        on = np.flatnonzero(((n > 0) & (every > 1))[at])
        on = on[np.argsort(block[on], kind="stable")]
        out = np.empty(len(on), PASSAGES)
        out["hash"], out["n"] = x["hash"][on], n[at[on]]
        names, start = np.unique(block[on], return_index=True)
        return pa.table({"_block": pa.array(names, pa.int64()), "passages": pa.array([x.tobytes() for x in np.split(out, start[1:])][: len(names)], pa.binary())})

    rows = found.select("_block", "docs", "words", "ordered").mapInArrow(spread, "part bigint, _block bigint, passages binary")
    return rows.groupBy("part").applyInArrow(meet, "_block bigint, passages binary")


def before(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums along the last axis of what stands before each place, from its start on."""
    sums = np.zeros((*x.shape[:-1], x.shape[-1] + 1))
    np.cumsum(x, axis=-1, out=sums[..., 1:])
    return sums[..., :-1] - sums[..., start]


def word_scores(x: Span, spelled: np.ndarray, known: np.ndarray, follow: Follow) -> np.ndarray:
    """log10 of each word's probability after those before it. spelled: of its spelling; known: its training count."""
    share = known / np.maximum(follow.all[x.column], 1)
    n, number = ranks(x.text * (int(x.word.max()) + 1) + x.word)
    since = np.zeros(len(n), np.int64)
    since[1:] = n[:-1]
    since[x.place == 0] = 0
    pair = number.copy()
    pair[1:] += number[:-1] * len(n)
    pair[x.place == 0] = len(n) * len(n) + x.text[x.place == 0]
    again = ranks(pair)[0]
    p = np.empty((5, len(n)))
    met = np.ones((5, len(n)), bool)
    p[0] = spelled
    for k, cell in ((1, x.near), (2, x.far)):
        p[k], met[k] = follow.share[cell] * share, follow.met[cell // NEXT]
    p[3], met[3] = n / np.maximum(x.place, 1), x.place > 0
    p[4], met[4] = again / np.maximum(since, 1), since > 0
    p *= met
    # What each has done so far in the text, where it had something to say.
    weight = p * PRIOR[:, None]
    weight /= np.maximum(weight.sum(axis=0), 1e-300)
    for k in range(5):
        weight[k] = (HELD * PRIOR[k] + before(weight[k], x.start)) / (HELD + before(met[k], x.start)) * met[k]
    p *= weight
    return np.log10(np.maximum(p.sum(axis=0) / weight.sum(axis=0), 1e-300))


def passage_scores(x: Span, own: np.ndarray, learned: np.ndarray, repeated: np.ndarray, passages: int) -> np.ndarray:
    """log10 of each passage's probability: its words' (own), or as one that other training documents have.

    learned: by text, whether it is a training document, whose own passages are taken off the counts.
    """
    start = np.flatnonzero(np.diff(x.passage_text, prepend=-1))[x.passage_text]
    at = np.minimum(np.searchsorted(repeated["hash"], x.passage), max(len(repeated) - 1, 0))
    n = np.where(repeated["hash"][at] == x.passage, repeated["n"][at], 0) if len(repeated) else np.zeros(len(at), np.int64)
    train = learned[x.passage_text]
    some = np.flatnonzero((n > 0) & train)
    _, back, times = np.unique(x.passage_text[some] * len(repeated) + at[some], return_inverse=True, return_counts=True)
    n[some] -= times[back]
    total = passages - np.where(train, np.bincount(x.passage_text)[x.passage_text], 0)
    with np.errstate(divide="ignore"):
        whole = np.log(np.maximum(n, 0) / np.maximum(total, 1))
    own = own * np.log(10)
    part = np.exp(np.log(PASSAGE_PRIOR) + whole - np.logaddexp(np.log1p(-PASSAGE_PRIOR) + own, np.log(PASSAGE_PRIOR) + whole))
    weight = (PASSAGE_HELD * PASSAGE_PRIOR + before(part, start)) / (PASSAGE_HELD + np.arange(len(start)) - start)
    return np.logaddexp(np.log1p(-weight) + own, np.log(weight) + whole) / np.log(10)


def block_words(found: DataFrame, gate: Classes) -> DataFrame:
    """Each block's distinct words by class, with their counts in the counting and the mixing part and their number there."""
    shared = found.sparkSession.sparkContext.broadcast(gate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in each(batches):
            kinds, fold = shared.value.of(block)[block.doc], block.fold[block.doc]
            for kind in np.unique(kinds):
                own, n = kinds == kind, len(block.words)
                fit, mix = own & (fold != HELD_OUT) & (fold != MIXING), own & (fold == MIXING)
                at = np.flatnonzero(np.bincount(block.word[own], minlength=n))
                counts = [np.bincount(block.word[on], block.times[on], n)[at].astype(np.int64) for on in (fit, mix)]
                same = [pa.array(np.full(len(at), x, t)) for x, t in ((kind, np.int32), (name, np.int64))]
                yield pa.RecordBatch.from_arrays([block.words.take(pa.array(at)).cast(pa.string()), *map(pa.array, counts), *same, pa.array(at.astype(np.int32))], ["word", "fit", "mix", "kind", "_block", "at"])

    return found.select("_block", "docs", "words", "ordered").mapInArrow(run, "word string, fit bigint, mix bigint, kind int, _block bigint, at int")


def by_class(found: DataFrame) -> DataFrame:
    """word, kind, fit, mix, c, blocks and ats: a word's counts in a class, its training count in all, and where it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                places = b.column(1)
                fit, mix, kind, block, number = (places.flatten().field(i).to_numpy() for i in range(5))
                word = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
                c = np.bincount(word, fit + mix, b.num_rows).astype(np.int64)
                pair, at, n = np.unique(word * CLASSES + kind, return_inverse=True, return_counts=True)
                order, ends = np.argsort(at, kind="stable"), np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (block, number)]
                sums = [pa.array(np.bincount(at, x, len(pair)).astype(np.int64)) for x in (fit, mix)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair // CLASSES)), pa.array((pair % CLASSES).astype(np.int32)), *sums, pa.array(c[pair // CLASSES]), *lists], ["word", "kind", "fit", "mix", "c", "blocks", "ats"])

    places = found.groupBy("word").agg(F.collect_list(F.struct("fit", "mix", "kind", "_block", "at")).alias("places"))
    return places.mapInArrow(run, "word string, kind int, fit bigint, mix bigint, c bigint, blocks array<bigint>, ats array<int>")


def train(words: DataFrame) -> Model:
    """words: word, kind, fit, mix. Counts are summed slice by slice; only slots, weights and maps reach the driver.

    Weights, map and share of plain frequencies are learned on the mixing part over counts without it, by each word's
    whole count; the slots that score then count both parts.
    """
    spark = words.sparkSession
    width = (INPUTS << BITS) // SLICES

    def own(b: pa.RecordBatch) -> tuple[Tokens, np.ndarray]:
        return Tokens(raw(b.column(0)), b.column(1).to_numpy()), b.column(2).to_numpy().astype(float)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, INPUTS << BITS), np.float32)
        for b in gathered(batches):
            if b.num_rows:
                t, times = own(b)
                for at in t.pieces():
                    weight = times[t.word[at]]
                    for bit in range(8):
                        slot, y, _ = t.slots(bit, at)
                        for side in (0, 1):
                            on = y == side
                            np.add.at(n[side], slot[:, on].ravel(), np.tile(weight[on], INPUTS).astype(np.float32))
        z = zstandard.ZstdCompressor(level=1)
        for i in range(SLICES):
            part = n[:, i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], ["slice", "n"])

    def total(t: pa.Table) -> pa.Table:
        d, n = zstandard.ZstdDecompressor(), np.zeros((2, width), np.float64)
        for x in t["n"].to_pylist():
            n += np.frombuffer(d.decompress(x), np.float32).reshape(2, width)
        odds = np.clip(np.rint(np.log((n[1] + 0.4) / (n[0] + 0.4)) * 256), -3000, 3000).astype(np.int16)
        seen = np.minimum(255, np.floor(4 * np.log2(1 + n.sum(axis=0)))).astype(np.uint8)
        z = zstandard.ZstdCompressor(level=1).compress(n.astype(np.float32).tobytes())
        return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int32()), "odds": pa.array([odds.tobytes()]), "seen": pa.array([seen.tobytes()]), "n": pa.array([z])})

    def counted(times: str) -> DataFrame:
        return words.select("word", "kind", F.col(times).alias("times")).where("times > 0").mapInArrow(count, "slice int, n binary")

    def slots_of(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        odds, seen = np.zeros(INPUTS << BITS, np.int16), np.zeros(INPUTS << BITS, np.uint8)
        for r in sums.select("slice", "odds", "seen").collect():
            at = slice(r["slice"] * width, (r["slice"] + 1) * width)
            odds[at], seen[at] = np.frombuffer(r["odds"], np.int16), np.frombuffer(r["seen"], np.uint8)
        return odds, seen

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("slice").applyInArrow(total, "slice int, odds binary, seen binary, n binary")

    fit = stored(summed(counted("fit")))
    odds, seen = slots_of(fit)
    model = Model(odds, seen)
    in_class = words.groupBy("kind").agg(F.sum("fit").alias("fit"), F.sum(F.col("fit") + F.col("mix")).alias("all")).collect()
    for r in in_class:
        model.in_class[r["kind"]] = max(1, r["fit"])
    shared = spark.sparkContext.broadcast((odds, seen))
    part = words.where("mix > 0").select("word", "kind", "mix")
    # Weights learn from long runs of words: a task takes a hundred thousand or more.
    # In an order of their own, whichever way the words lie in files.
    part = part.coalesce(max(1, part.count() // 100_000)).sortWithinPartitions(F.xxhash64("word", "kind"), "word", "kind")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mass = Model(*shared.value), np.zeros(SETS)
        for b in gathered(batches):
            if b.num_rows:
                mass += m.learn(*own(b))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([mass.tobytes()])], ["weights", "mass"])

    got = part.mapInArrow(learn, "weights binary, mass binary").collect()
    got = sorted((bytes(r["weights"]), bytes(r["mass"])) for r in got)
    mass = np.array([np.frombuffer(m) for _, m in got]).reshape(-1, SETS)
    weights = np.array([np.frombuffer(w) for w, _ in got]).reshape(-1, SETS, INPUTS + 1)
    met = mass.sum(axis=0) > 0
    model.weights[met] = ((weights * mass[:, :, None]).sum(axis=0) / np.maximum(mass.sum(axis=0), 1e-9)[:, None])[met]
    mixer = spark.sparkContext.broadcast(model.weights)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        m.weights = mixer.value
        for b in gathered(batches):
            if b.num_rows:
                m.observe(*own(b))
        yield pa.RecordBatch.from_arrays([pa.array([m.map.tobytes()])], ["map"])

    for r in part.mapInArrow(observe, "map binary").collect():
        model.map += np.frombuffer(r["map"]).reshape(model.map.shape)
    model.plain = plain_share(words, model)
    # What the mixing part was kept apart for is learned: its words count as well now.
    model.odds, model.seen = slots_of(summed(fit.select("slice", "n").union(counted("mix"))))
    for r in in_class:
        model.in_class[r["kind"]] = max(1, r["all"])
    return model


def plain_share(words: DataFrame, model: Model, rounds: int = 12) -> float:
    """The weight of plain frequencies that makes the mixing part's words likeliest, by expectation and maximisation.

    Words go to a grid of the two probabilities' log ratio, so that one pass gives all that the rounds need.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = np.zeros(129), shared.value
        for b in gathered(batches):
            if b.num_rows:
                kinds, fit, mix = (b.column(i).to_numpy() for i in (1, 2, 3))
                gap = np.log10(np.maximum(fit / m.in_class[kinds], 1e-300)) - m.bits(raw(b.column(0)), kinds)
                n += np.bincount(np.clip(np.rint(gap * 8) + 64, 0, 128).astype(int), mix, 129)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], ["n"])

    n = sum((np.frombuffer(r["n"]) for r in words.where("mix > 0").select("word", "kind", "fit", "mix").mapInArrow(run, "n binary").collect()), np.zeros(129))
    ratio, share = 10 ** ((np.arange(129) - 64) / 8), 0.5
    ratio[0] = 0
    for _ in range(rounds if n.sum() else 0):
        share = float((n * share * ratio / (share * ratio + 1 - share)).sum() / n.sum())
    return min(max(share, 0.01), 0.99) if n.sum() else 0.0


def released(spark: SparkSession) -> None:
    """Spark deletes shuffle files that no plan refers to any more when the driver collects its garbage, which may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every whole text.

    A null text counts as empty and has the end token only; a null doc_id belongs to the fold of the empty text; rows that
    repeat are counted and scored each. Without training documents all slots are even.
    """
    spark = docs.sparkSession
    cut = blocks(docs)
    gate = classes_of(cut)
    words = stored(by_class(block_words(cut, gate)))
    released(spark)
    # Each word's training count once: a word has a row for each class, its c in all of them.
    once = F.col("fit") + F.col("mix")
    sums = words.agg(F.sum(once).alias("n"), F.sum(F.when((once > 0) & (F.col("c") > 0), once / F.col("c"))).alias("v")).first()
    n, v = sums["n"] or 0, round(sums["v"] or 0)
    kinds_of = {r["kind"]: r["n"] for r in words.where(F.col("word") == END).groupBy("kind").agg(F.sum(once).alias("n")).collect()}
    prior = np.log10(np.array([kinds_of.get(k, 0) + 0.5 for k in range(CLASSES)]) / (sum(kinds_of.values()) + 0.5 * CLASSES))
    model = spark.sparkContext.broadcast(train(words))
    released(spark)
    shared, after = spark.sparkContext.broadcast(gate), spark.sparkContext.broadcast(follow(cut, gate))

    entry = np.dtype([("kind", np.int32), ("at", np.int32), ("c", np.int64), ("cost", np.float64)])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            if b.num_rows:
                cost = model.value.cost(raw(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy())
                places = b.column(4)
                of = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
                block = places.flatten().to_numpy()
                out = np.empty(len(of), entry)
                out["kind"], out["at"], out["c"], out["cost"] = b.column(1).to_numpy()[of], b.column(5).flatten().to_numpy(), b.column(3).to_numpy()[of], cost[of]
                order = np.argsort(block, kind="stable")
                names, start = np.unique(block[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in np.split(out[order], start[1:])], pa.binary())], ["_block", "entries"])

    priced = words.select("word", "kind", once.alias("fit"), "c", "blocks", "ats").mapInArrow(price, "_block bigint, entries binary")
    repeated = repeated_passages(cut, gate).select("_block", F.lit(None).cast("binary").alias("entries"), "passages")
    looked_up = priced.withColumn("passages", F.lit(None).cast("binary")).unionByName(repeated)
    least = np.log10(n + 0.1 * (v + 1))

    def look_up(docs: pa.Table, words: pa.Table) -> pa.Table:
        out = rows_of(docs, words)
        give_back()
        return out

    def rows_of(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = Order(*Block.whole(*(docs[x][0].as_py() for x in ("docs", "words", "ordered"))), shared.value)
        block = order.block
        of, wide, learned = shared.value.of(block), len(block.words), block.fold != HELD_OUT
        # Of each word in each class, where its count and cost are; most words occur in few classes.
        place, entries = np.zeros(CLASSES * wide, np.int32), words["entries"].drop_null()
        c, cost = np.zeros(1, np.int64), np.full(1, np.nan)
        if len(entries):
            x = np.frombuffer(b"".join(entries.to_pylist()), entry)
            place[x["kind"].astype(np.int64) * wide + x["at"]] = np.arange(1, len(x) + 1)
            c, cost = np.append(c, x["c"]), np.append(cost, x["cost"])
        passages = np.concatenate([np.empty(0, PASSAGES), *(np.frombuffer(x, PASSAGES) for x in words["passages"].drop_null().to_pylist())])
        passages = passages[np.argsort(passages["hash"])]
        np.power(10, cost, out=cost)
        score = prior[of]
        for x in order.spans():
            own = place[of[x.texts][x.text] * wide + x.word]
            found = word_scores(x, cost[own], c[own], after.value)
            found = passage_scores(x, np.add.reduceat(found, x.begins), learned[x.texts], passages, after.value.passages)
            score[x.texts] += np.bincount(x.passage_text, found, len(score[x.texts]))
        known, total = c[place[of[block.doc] * wide + block.word]], lambda x: np.bincount(block.doc, x * block.times, len(of))
        whole = [total(x).astype(np.int64) for x in (np.ones(len(known)), known > 0)]
        out = [pa.array(~learned), *map(pa.array, whole), pa.array(np.full(len(of), n, np.int64))]
        out += map(pa.array, (total(np.log10(known + 0.1) - least), score, -score * np.log2(10) / (block.bytes + 1)))
        return pa.table([block.ident, *out], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return cut.groupBy("_block").cogroup(looked_up.groupBy("_block")).applyInArrow(look_up, schema)


def op1_context_mixing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
