"""Every operator on a small hard table: nulls in every column, empty and long texts, ties, repeated rows, columns of clashing names."""

import base64
import collections
import gc
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from omiclake.llm import bpe, cws, gbt, hashtree, lm, mixing, passages, rules, simhash, suffixes, tokenfile
from omiclake.llm.common import small_batches
from omiclake.llm.textstats import Text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, h bigint, size int, kept boolean"


def texts():
    rng = random.Random(4)
    syllables = ["ta", "ré", "the", "of", "ion", "ß", "mo", "日本", "x"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(150)
    out = [None, "", " \n\t ", "one", "A a", "same same same same", base, base, base.upper(), base + " end", prose(80) + "\n" + base[:700] + "\n" + prose(30)]
    out += [prose(40) + base[100:690] + prose(20), "ab" * 3000, "x" * 450, "y" * 399, prose(4000), "|| $$ !! " * 30, "line\nline\nother\n\nline"]
    return out + [prose(rng.randint(30, 120)) for _ in range(25)]


def rows():
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, None, "f", None, i, None) for i, t in enumerate(texts())]
    out.append(out[8])  # a repeated row
    out.append((None, "a null id with words of its own", "en", "s1", None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    kind = "doc_id bigint, quality int, toxic int"
    return spark.createDataFrame([(i, None if i % 11 == 0 else int("|" not in (t or "")), 0) for i, t in enumerate(texts())] + [(None, 1, 0)], kind)


def by_text(df, docs):
    """(doc_id, rows) of a result."""
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    assert collections.Counter(r["doc_id"] for r in docs.collect()) == {k: len(v) for k, v in out.items()}
    return out


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_lm_counts_match_brute_force_and_order_does_not_matter(docs, empty):
    got = by_text(lm.scored(docs), docs)
    data = docs.collect()
    train = collections.Counter()
    for r in data:
        if zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10:
            train.update([*words(lower(r["text"])), "\n"])
    n, v = sum(train.values()), len(train)
    for r in data:
        own = [*words(lower(r["text"])), "\n"]
        g = got[r["doc_id"]][0]
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert g["base_score"] == pytest.approx(want, rel=1e-9)
        assert g["score"] < 0
    again = by_text(lm.scored(docs.repartition(5)), docs)
    assert all(again[k][0]["score"] == pytest.approx(got[k][0]["score"], rel=0.05) for k in got)
    assert lm.scored(empty).collect() == []


def test_lm_probabilities_of_words_do_not_exceed_one():
    model = lm.Model(np.zeros(lm.INPUTS << lm.BITS, np.int16), np.zeros(lm.INPUTS << lm.BITS, np.uint8))
    short = [bytes([a]) for a in range(256) if a not in (32, *range(9, 14))] + [b"\n"]
    assert (10 ** model.bits(short, np.zeros(len(short), np.int64))).sum() <= 1


def test_lm_counts_the_mixing_part_whole_and_in_its_slots(spark):
    rows = [("both", 0, 500, 3000), ("counted", 0, 70, 0), ("mixonly", 0, 0, 900), ("\n", 0, 20, 65)]
    model = lm.train(spark.createDataFrame(rows, "word string, kind int, fit bigint, mix bigint"))
    t = lm.Tokens([w.encode() for w, *_ in rows], np.zeros(len(rows), np.int64))
    assert model.map.sum() == 8 * sum(rows[w][3] for w in t.word)
    assert all((model.seen[t.slots(bit, slice(None))[0]] > 0).all() for bit in range(8))
    assert model.in_class[0] == sum(r[2] + r[3] for r in rows)


def reference_fingerprint(t):
    import xxhash

    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(docs, empty):
    got = by_text(simhash.near_duplicates(docs), docs)
    data = docs.collect()
    fp = {r["doc_id"]: reference_fingerprint(r["text"]) for r in data}
    reach = {i: {j for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4} for i in fp}
    for i in fp:
        assert {g["fingerprint"] for g in got[i]} == {f"{fp[i]:016x}"}
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in reach[j] if k not in seen and not seen.add(k)]
        assert {g["component_id"] for g in got[i]} == {min((j for j in seen if j is not None), default=None)}
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs)).collect()
    assert len(kept) == len({r["doc_id"] for r in kept}) == len({g[0]["component_id"] for g in got.values()})
    assert kept[0].asDict().keys() == docs.collect()[0].asDict().keys()


def test_near_copies_match_brute_force(spark, docs, empty):
    rng = random.Random(8)
    data = []
    for g in range(12):
        base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 250))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                own[rng.randrange(len(own))] = "edited" + str(rng.randint(0, 99))
            data.append(" ".join(own))
    rng.shuffle(data)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in data]
    root = list(range(len(data)))
    for _ in data:
        for i in range(len(data)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    table = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table).collect()}
    assert sum(got[i] != root[i] for i in got) <= 0.05 * len(data)
    assert all(root[i] == root[c] for i, c in got.items())
    by_text(simhash.near_copies(docs), docs)
    assert simhash.near_copies(empty).collect() == []


def edited_families(rng, families=3, copies=60, words=200, edits=4):
    """Texts of families, the original among its copies: 0.81 from it to each copy, about 0.66 between copies."""
    out = []
    for f in range(families):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(words)]
        out.append(" ".join(base))
        for c in range(copies):
            own = list(base)
            for i in rng.sample(range(4, words - 4, 5), edits):
                own[i] = f"new{f}x{c}x{i}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_near_copies_link_families_through_texts_that_are_no_leaders(spark):
    data = edited_families(random.Random(3))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in data]
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) == 3
    table = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table).collect()} == dict(enumerate(root))


def test_one_of_each_keeps_texts_that_share_a_doc_id_or_have_none(spark):
    rng = random.Random(6)
    base = [["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)] for _ in range(6)]
    own = [" ".join(b) for b in base]
    near = " ".join(base[1][:60] + ["edited"] + base[1][61:])
    data = [(None, own[0]), (None, own[1]), (None, near), (None, own[0].upper()), (3, own[2]), (3, own[3]), (3, own[3]), (4, own[4]), (None, own[4]), (None, own[5]), (5, own[5] + " end"), (6, None), (None, " ")]
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash.one_of_each(table, simhash.near_copies(table)).collect()))
    one_of = {(0, own[0]), (0, own[0].upper())}, {(0, own[1]), (0, near)}, {(3, own[2])}, {(3, own[3])}, {(4, own[4])}, {(5, own[5] + " end")}, {(6, "")}
    assert len(kept) == len(one_of)
    assert all(len(x & set(kept)) == 1 for x in one_of)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(0, 2**32))
def test_anchors_bring_all_links_together(base, seed):
    rng = random.Random(seed)
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base]
    fps = np.unique(np.array([*base, *near], np.uint64)).view(np.int64)
    at, who, home = simhash.anchors(fps, 4)
    own = collections.defaultdict(list)
    for k, f, h in zip(at.tolist(), who.tolist(), home.tolist(), strict=True):
        own[k].append((f, h))
    met = {frozenset((x, y)) for m in own.values() for x, h in m if h for y, _ in m if x != y}
    values = [int(x) for x in fps]
    for i, x in enumerate(values):
        for y in values[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
                assert frozenset((x, y)) in met


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 150))


def test_gbt_learns_and_scores_alike(docs, empty, labels):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(gbt.FEATURES)))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.5)).astype(float)
    trees = gbt.fit(x[:400], y[:400])
    p = trees.score(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9
    one = np.array([trees.score(r[None])[0] for r in x[400:420]])
    assert np.allclose(one, p[:20])
    got = by_text(gbt.scored(docs, gbt.train(docs, labels)), docs)
    for i, rs in got.items():
        for r in rs:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
            assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0)
    assert gbt.scored(empty, gbt.train(empty, labels)).collect() == []


def jaccard(a, b):
    a, b = collections.Counter(words(a)), collections.Counter(words(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_weighted_fingerprints(docs, empty):
    got = cws.fingerprinted(docs).collect()
    data = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    want = []
    errors = []
    for k, (known, i, t) in enumerate(data):
        nxt = data[(k + 1) % len(data)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, nxt)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for r, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert tuple(r)[:3] == w[:3]
        errors += [r["near_edited"] - w[3], r["near_next"] - w[4]]
    assert np.sqrt(np.mean(np.square(errors))) < 0.08
    by = collections.defaultdict(set)
    for r in got:
        by[next(t for known, i, t in data if (i if known else None) == r["doc_id"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert cws.fingerprinted(empty).collect() == []
    one = cws.fingerprinted(docs.where("doc_id = 6")).first()
    assert one["near_next"] == 1.0


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_rank_library(docs, empty):
    import public_tokenizers as P

    path, enc = P.path("byte_bpe_50k.tiktoken"), tiktoken_encoding()
    got = by_text(bpe.encoded(docs, path, P.PATTERN, with_ids=True), docs)
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]][0]
        assert (g["n_tokens"], list(g["ids"])) == (len(ids), ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encoded(empty, path, P.PATTERN).collect() == []
    coder, rng = bpe.Coder(path, P.PATTERN), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "日", "1", "!", "　", "\x85", "the", "aaaa", "😀", "\x00", "<|endoftext|>", "▁"]
    for _ in range(800):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert coder.encode(t).tolist() == enc.encode_ordinary(t)


def test_quality_counts_match_brute_force(docs, empty, labels):
    model = rules.train(docs, labels)
    got = by_text(rules.judged(docs, model), docs)
    for r in docs.collect():
        t, w = r["text"] or "", words(r["text"])
        lines = [x for x in t.split("\n") if words(x)]
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        near = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(near))
        g = got[r["doc_id"]][0]
        assert tuple(g)[1:6] == want
        assert g["base_failed"] == (len(w) < 50 or 100 * len(near) > 50 * len(w))
        assert not (g["kept"] and g["base_failed"])
    kept = rules.kept_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for v in got.values() for r in v)
    assert rules.judged(empty, rules.train(empty, labels)).collect() == []


def test_regression_separates_symbols_and_is_calibrated():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "and", "word", "text"]) for _ in range(60)) for _ in range(120)]
    bad = [" | ".join(rng.choice(["the", "of", "and", "word", "text"]) for _ in range(60)) for _ in range(60)]
    data = [(Text(t.encode()), 1) for t in good] + [(Text(t.encode()), 0) for t in bad]
    rng.shuffle(data)
    model = rules.fit([(*rules.sparse(t), y) for t, y in data[:140]])
    p = np.array([model.probability(t) for t, _ in data[140:]])
    y = np.array([y for _, y in data[140:]])
    assert ((p >= rules.KEEP) == (y == 1)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(256, 65535), st.integers(65536, 2**32 - 1)), max_size=1500), st.randoms())
def test_codes_round_trip_and_random_access(ids, rng):
    codes = tokenfile.pack(np.array(ids, np.uint32))
    assert tokenfile.unpack(codes).tolist() == ids
    parts = tokenfile.levels(codes)
    for i in rng.sample(range(len(ids)), min(20, len(ids))):
        assert tokenfile.token_at(parts, i) == ids[i]


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    tokenfile.write_tokens(docs, f"{tmp_path}/a", path, tokens=500, partitions=3)
    got = sorted(tokenfile.read_tokens(spark, f"{tmp_path}/a", with_ids=True).collect(), key=lambda r: r["start"])
    data = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    stream, start = [], 0
    for r, (known, i, t) in zip(got, data, strict=True):
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (i if known else None, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        stream += ids
    places = [0, 1, len(stream) // 2, len(stream) - 1]
    assert tokenfile.read_at(spark, f"{tmp_path}/a", places) == {p: stream[p] for p in places}
    tokenfile.write_tokens(empty, f"{tmp_path}/b", path)
    assert tokenfile.read_tokens(spark, f"{tmp_path}/b").collect() == []
    parts = ["a", " ", "  ", "\n", "'s", "é", "日", "1", "!", "　", "the", " word", "ª", "ſ", "İ", "😀", "\x00", "́", "²", "\x85", "\xa0", "\x1c", "ɏ", "ɐ"]
    for literal in (False, True):
        own.encode_special_tokens = literal
        coder, rng = tokenfile.Tokenizer(path, literal), random.Random(3)
        for k in range(1200):
            t = "".join(rng.choice(parts if k % 3 else [*parts, "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))
            assert np.frombuffer(coder.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_sharding_law(spark, docs, empty):
    t = hashtree.tree(40)
    got = hashtree.sharded(docs, t, hashtree.grown(t)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["grown_shard"] in (40, r["shard"]) and r["law"] == "key" and 0 <= r["shard"] < 40
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    same = collections.defaultdict(set)
    for r in got:
        same[r["doc_id"]].add(r["shard"])
    assert all(len(v) == 1 for k, v in same.items() if k is not None)
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    for r in docs.collect():
        b = (r["text"] or "").encode()
        assert sizes[r["doc_id"]] == (len(b) + 16, zlib.crc32(b))
    assert hashtree.sharded(empty, t, hashtree.grown(t)).collect() == []


def test_rows_move_only_into_subtrees_that_grow_and_by_weight(spark):
    keys = spark.range(20000).select(F.col("id").alias("k"))
    a = [[[(0, 1.0), (1, 2.0)], [(2, 1.0)]], [[(3, 4.0)]]]
    b = [[[(0, 1.0), (1, 2.0)], [(2, 1.0)]], [[(3, 8.0)]]]
    got = hashtree.with_shard(hashtree.with_shard(keys, "k", a, "old"), "k", b, "new").groupBy("old", "new").count().collect()
    assert all(r["new"] == r["old"] or r["new"] == 3 for r in got)
    share = {s: sum(r["count"] for r in got if r["old"] == s) / 20000 for s in range(4)}
    assert [round(share[s], 1) for s in range(4)] == [0.1, 0.2, 0.1, 0.5] or all(abs(share[s] - w / 8) < 0.02 for s, w in zip(range(4), (1, 2, 1, 4), strict=True))


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 60))
def test_apportionment_takes_highest_quotients(goal, seats):
    got = mixing.apportion([float(g) for g in goal], seats)
    if not sum(goal):
        assert got == [0] * len(goal)
        return
    want = [0] * len(goal)
    for _ in range(seats):
        best = max(range(len(goal)), key=lambda i: (goal[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert sum(got) == seats
    quotients = lambda q: sorted(goal[i] / (2 * k + 1) for i in range(len(goal)) for k in range(q[i]))
    assert quotients(got) == pytest.approx(quotients(want))


def test_mixing(docs, empty):
    got = mixing.mixed_words(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_words(docs.repartition(2)).collect()), key=str)
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = mixing.targets([sizes[s] for s in names], [[1, 2, 3][i % 3] for i in range(len(names))])
    assert sum(goal) == pytest.approx(sum(sizes.values()))
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[names.index(r["source"])])
        taken[r["source"]] += r["taken"]
    assert len(got) == docs.count()
    for s, g in zip(names, goal, strict=True):
        assert abs(taken[s] - g) <= 64
    assert mixing.mixed_words(empty).collect() == []
    assert mixing.mixed_documents(docs).columns == docs.columns
    clashing = docs.select("doc_id", "text", "source", F.lit(77).alias("_copy"), F.lit("x").alias("_times"), F.lit(3).alias("taken"), F.lit(4).alias("_source"))
    out = mixing.mixed_documents(clashing).collect()
    assert out and all((r["_copy"], r["_times"], r["taken"], r["_source"]) == (77, "x", 3, 4) for r in out)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 50), max_size=60)))
def test_suffix_array(s):
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_spans(data, length):
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        mark = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        out.append(np.cumsum(mark)[: len(t)] > 0)
    return out


@pytest.mark.parametrize(("length", "anchor", "crowd", "passage"), [(400, 96, 5000, 250), (400, 128, 1, 300), (60, 20, 5000, 40), (60, 20, 2, 60), (40, 16, 3, 90)])
def test_passages_match_brute_force(docs, empty, length, anchor, crowd, passage):
    got = collections.Counter(map(tuple, passages.removed(docs, length, anchor, crowd, passage).collect()))
    data = docs.collect()
    bits, shorter = (brute_spans([(r["text"] or "").encode() for r in data], n) for n in (length, passage))
    want = collections.Counter()
    for r, m, p in zip(data, bits, shorter, strict=True):
        b = np.frombuffer((r["text"] or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], m.astype(np.int8)])) == 1).sum())
        want[(r["doc_id"], len(b), int(m.sum()), spans, hashlib.sha256(b[~m].tobytes()).hexdigest(), int(p.sum()))] += 1
    assert got == want
    assert passages.removed(empty, length, anchor, crowd, passage).collect() == []


def test_deduplicated_documents_keep_their_columns(docs):
    out = passages.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["text"] is None and rows[6]["text"] == "" and rows[6]["n_chars"] == 0 and rows[6]["fp"] == "f"
    clashing = docs.select("doc_id", "text", F.lit(True).alias("_null"), F.lit("x").alias("th"), F.lit(7).alias("_0"), F.lit(8).alias("cover"))
    out = passages.deduplicated(clashing).collect()
    assert all(r["_null"] and (r["th"], r["_0"], r["cover"]) == ("x", 7, 8) for r in out) and len(out) == docs.count()


def test_runs_of_long_texts_do_not_depend_on_blocks():
    t = bytes(random.Random(5).choices(b"abc ", k=5000))
    for whole, cut in zip(passages.runs(t), passages.runs(t, block=700), strict=True):
        assert (whole == cut).all()


def test_queries_are_registered():
    from omiclake.llm.registry import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert json.dumps(sorted(QUERIES))


def test_blocks_link_all_similar_texts_of_different_roots(spark):
    rng = random.Random(9)
    base = rng.sample(range(10**6), 60)
    sets = [sorted({*rng.sample(base, 60 - k % 9), *rng.sample(range(10**6, 2 * 10**6), k % 9)}) for k in range(90)]
    root = [min(k, 5 * (k % 3)) for k in range(90)]
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    packed = [(k, np.array(s, np.uint32).tobytes()) for k, s in enumerate(sets)]
    got = simhash.blockwise(table([(k, 7) for k in range(90)], "t bigint, c bigint"), table(list(enumerate(root)), "node bigint, root bigint"), table(packed, "t bigint, s binary"), 0.8, block=16).collect()
    similar = {(i, j) for i in range(90) for j in range(i + 1, 90) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}

    def labels(edges):
        label = list(range(90))
        for a, b in [*edges, *enumerate(root)]:
            a, b = sorted((label[a], label[b]))
            label = [a if x == b else x for x in label]
        return label

    assert similar and labels([(r["u"], r["v"]) for r in got]) == labels(similar)


def test_sketches_part_unlike_sets_and_no_similar_ones():
    rng, most = np.random.default_rng(2), simhash.sketch_bits(0.8)
    differ = lambda a, b: int(np.bitwise_count(simhash.sketch(a).view(np.uint64) ^ simhash.sketch(b).view(np.uint64)).sum())
    near, far = [], []
    for n in (9, 90, 900):
        for _ in range(200):
            x = rng.integers(0, 2**32, n + n // 9, dtype=np.uint32)
            near.append(differ(x[:n], x[n // 9 :]))  # similarity 0.8
            far.append(differ(x[:n], rng.integers(0, 2**32, n, dtype=np.uint32)))
    assert max(near) <= most and sum(f <= most for f in far) <= 2


def test_texts_of_an_anchor_that_are_unlike_make_no_pairs():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**32, int(n), dtype=np.uint32) for n in np.sort(rng.integers(150, 400, 300))]
    sets[200] = np.concatenate([sets[199][10:], sets[200][:10]])
    sets.sort(key=len)
    copies = [k for k, s in enumerate(sets) for z in sets if s is not z and len(np.intersect1d(s, z)) > 100]
    bits = np.array([simhash.sketch(s) for s in sets]).T
    u, v, kind = simhash.candidate_pairs(bits, np.array(list(map(len, sets))), np.ones(300, bool), np.arange(300), 0.8)
    assert {frozenset(p) for p in zip(u.tolist(), v.tolist(), strict=True)} == {frozenset(copies)} and kind.tolist() == [0]


def test_near_copies_take_candidates_by_the_likeness_of_their_shingles(spark, monkeypatch):
    rng = random.Random(12)
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    data = [" ".join(rng.sample(common, 80)) for _ in range(60)]  # equal words, unlike shingles
    seen, kept = [], simhash.stored

    def spy(df):
        out = kept(df)
        if "kind" in df.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", spy)
    table = spark.createDataFrame(list(enumerate([*data, data[7] + " end"])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table).collect()}
    assert got == {k: k for k in range(60)} | {60: 7} and seen == [1]


def test_components_joined_by_the_driver_and_by_rounds_agree(spark):
    rng = random.Random(13)
    table = spark.createDataFrame([tuple(rng.sample(range(400), 2)) for _ in range(230)], "u bigint, v bigint")
    few, rounds = (sorted(map(tuple, simhash.components(table, local=n).collect())) for n in (simhash.LOCAL, 0))
    assert few == rounds and len(few) == len({k for k, _ in few})


def test_rules_hold_packed_features_that_give_the_same_fit():
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    data = [(" ".join(rng.choices(words[: 150 + 150 * (k % 2)], k=120)).encode(), k % 2) for k in range(60)]
    rows = [(*rules.sparse(Text(t)), y) for t, y in data]
    rows = [(a, v.astype(np.float32), y) for a, v, y in rows]
    small = rules.Packed([(rules.packed(a, v), y) for a, v, y in rows])
    assert sum(len(z) for z, _ in small.rows) < 0.6 * sum(4 * len(a) + 4 * len(v) for a, v, _ in rows)
    whole, got = rules.fit(rows), rules.fit(small)
    assert (whole.weights == got.weights).all() and (whole.bias, whole.a, whole.b) == (got.bias, got.a, got.b)


def test_classes_are_fitted_on_all_training_documents(spark):
    rng = random.Random(15)
    tokens = [f"w{i:03d}" for i in range(200) for _ in range(20 + i)]
    rng.shuffle(tokens)
    data = [(i, " ".join(tokens[6 * i : 6 * i + 6])) for i in range(len(tokens) // 6)]
    data.append((1, " ".join(f"w{i:03d}" for i in range(200))))
    spread = collections.Counter(w for i, t in data if zlib.crc32(str(i).encode()) % 10 for w in set(t.split()))
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    gate, again = lm.classes(table.repartition(2)), lm.classes(table.repartition(3))
    assert [w.decode() for w in gate.place] == sorted(spread, key=lambda w: (-spread[w], w))
    assert gate.place == again.place and (gate.centres == again.centres).all() and gate.centres.any(axis=1).all()


def test_lm_reads_texts_once_and_scores_alike_in_blocks_of_any_size(spark, docs, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    whole = by_text(lm.scored(docs.mapInArrow(counted, docs.schema)), docs)
    assert read.value == docs.count()
    monkeypatch.setattr(lm, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    monkeypatch.setattr(lm, "BLOCK_DOCS", 5)
    parts = by_text(lm.scored(docs), docs)
    small_batches(spark)
    for k, rows in whole.items():
        for a, b in zip(rows, parts[k], strict=True):
            assert (a["n_tokens"], a["n_known"], a["train_tokens"], a["held_out"]) == (b["n_tokens"], b["n_known"], b["train_tokens"], b["held_out"])
            assert b["base_score"] == pytest.approx(a["base_score"], rel=1e-9) and b["score"] == pytest.approx(a["score"], rel=0.05)


def test_bags_of_words_match_brute_force():
    texts = ["  a B\tc\x0b d\x0c\r\nE  a ", "", "   ", "\xc9 x  y \xc9", "\x1c\x1d a\x85b", "a a a"]
    named, sizes, numbers, times = lm.bags(pa.array(texts))
    named, at = named.to_pylist(), 0
    for t, n in zip(texts, sizes, strict=True):
        own = dict(zip((named[i] for i in numbers[at : at + n]), times[at : at + n], strict=True))
        assert own == collections.Counter([*(w.encode() for w in words(lower(t))), b"\n"])
        at += n


def test_blocks_without_common_words_are_of_the_first_class():
    docs = lm.packed(doc_id=[1, 2], fold=np.ones(2, np.int8), bytes=np.zeros(2, np.int64), size=np.ones(2, np.int64))
    block = lm.Block(docs, lm.packed(word=np.zeros(2, np.int32), times=np.ones(2, np.int32)), lm.packed(word=pa.array([b"\n"])))
    gate = lm.Classes([b"x"])
    assert not gate.vectors(block).any() and gate.of(block).tolist() == [0, 0]


def order_of(texts, common=(), folds=None):
    """The texts as one block of documents of fold 1, or of folds, in order."""
    words, length, number = lm.ordered(pa.array(texts, pa.string()))
    folds = np.array([1] * len(texts) if folds is None else folds, np.int8)
    docs = lm.packed(doc_id=np.arange(len(texts)), fold=folds, bytes=np.zeros(len(texts), np.int64), length=length)
    return lm.Order(*lm.Block.whole(docs, lm.packed(word=words), lm.planes(number)), lm.Classes(list(common)))


def learned(order):
    n = np.zeros(lm.Follow.CELLS + 1, np.int64)
    for x in order.spans():
        for cells in (x.near, x.far):
            np.add.at(n, cells, 1)
        n[-1] += len(x.passage)
    return lm.Follow(n)


def test_words_keep_their_order_in_a_block(monkeypatch):
    got = ["  b A\tc\x0bb", "", "a", None and "", "c c b " * 50, "z"]
    order = order_of([t or "" for t in got])
    names = order.block.words.to_pylist()
    want = [[*(w.encode() for w in words(lower(t))), b"\n"] for t in got]
    assert [names[i] for i in order.number] == sum(want, []) and order.length.tolist() == [len(w) for w in want]
    whole = list(order.spans())
    monkeypatch.setattr(lm, "SPAN", 3)
    parts = list(order.spans())
    assert len(whole) == 1 and len(parts) > 3
    for name in ("word", "near", "far", "passage"):
        assert (np.concatenate([getattr(x, name) for x in parts]) == getattr(whole[0], name)).all()


def test_word_scores_match_a_loop_over_the_text_so_far():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(9)]
    order = order_of(texts, (b"a", b"b"))
    x, follow = next(order.spans()), learned(order_of([*texts[:5], "a q"], (b"a", b"b")))
    counts = np.bincount(order.number[: order.end[4]], minlength=len(order.hash))
    spelled = np.array([rng.uniform(0.01, 0.1) for _ in order.hash])
    got = lm.word_scores(x, spelled[x.word], counts[x.word], follow)
    cell = 0
    for i, end in enumerate(order.end):
        text, done, met = order.number[end - order.length[i] : end].tolist(), np.zeros(5), np.zeros(5)
        for k, w in enumerate(text):
            p, on, pairs = np.zeros(5), np.ones(5), list(zip(text[:k], text[1:k], strict=False))
            p[0] = spelled[w]
            for j, at in ((1, x.near[cell]), (2, x.far[cell])):
                p[j], on[j] = follow.share[at] * counts[w] / max(follow.all[order.column[w]], 1), follow.met[at // lm.NEXT]
            p[3], on[3] = text[:k].count(w) / max(k, 1), k > 0
            seen = sum(u == text[k - 1] for u, _ in pairs) if k else 0
            p[4], on[4] = pairs.count((text[k - 1], w)) / max(seen, 1) if k else 0, seen > 0
            p *= on
            weight = (lm.HELD * lm.PRIOR + done) / (lm.HELD + met) * on
            assert got[cell] == pytest.approx(math.log10((weight * p).sum() / weight.sum()), abs=1e-9)
            done += lm.PRIOR * p / (lm.PRIOR * p).sum()
            met += on
            cell += 1


def test_word_scores_of_all_next_words_do_not_exceed_one():
    start = "a b a c a b b d a"
    names = ["a", "b", "c", "d", "e", "rare"]
    order = order_of([f"{start} {w}" for w in names] + [start])
    follow = learned(order)
    counts = np.bincount(order.number, minlength=len(order.hash))
    x = next(order.spans())
    got = lm.word_scores(x, np.full(len(x.word), 1 / (len(names) + 1)), counts[x.word], follow)
    last = [i for i in range(len(x.word)) if x.place[i] == len(start.split())]
    assert len(last) == len(names) + 1 and (10 ** got[last]).sum() == pytest.approx(1, abs=1e-6)


def test_passages_are_predicted_by_other_documents_only(monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(90)) for i in range(4)]
    order = order_of([*texts, texts[1], texts[2]], folds=[1, 1, 0, 1, 1, 1])
    x = next(order.spans())
    training = order.block.fold[x.passage_text] != lm.HELD_OUT
    h, n = np.unique(x.passage[training], return_counts=True)
    rows = np.zeros(len(h), lm.PASSAGES)
    rows["hash"], rows["n"] = h, n
    own = np.full(len(x.passage), -200.0)
    got = lm.passage_scores(x, own, order.block.fold != lm.HELD_OUT, rows, int(training.sum()))
    by = [got[x.passage_text == i] for i in range(6)]
    # Of its words: a text that no other training document has; its copies' only passages are those that are nowhere else.
    assert all((by[i] < -200).all() for i in (0, 3, 5)) and all((by[i] > -10).all() for i in (1, 2, 4))


def test_lm_scores_depend_on_the_order_of_words_and_on_copies(spark):
    rng = random.Random(31)
    pairs = [(f"left{i}", f"right{i}") for i in range(30)]
    data = [(i, " ".join(w for p in rng.choices(pairs, k=60) for w in p)) for i in range(120)]
    own = [w for p in rng.choices(pairs, k=60) for w in p]
    straight, mingled, alone, copy = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    data += [(straight, " ".join(own)), (mingled, " ".join(rng.sample(own, len(own))))]
    lone, twice = (" ".join(f"{s}{rng.randrange(10**9)}" for _ in range(100)) for s in "st")
    data += [(alone, lone), (2002, twice), (copy, twice)]
    got = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect()}
    assert (got[straight]["n_tokens"], got[straight]["n_known"]) == (got[mingled]["n_tokens"], got[mingled]["n_known"])
    assert got[straight]["score"] > 0.7 * got[mingled]["score"]
    assert got[copy]["bits_per_byte"] < 0.5 * got[alone]["bits_per_byte"]


def test_lm_a_worker_holds_one_block_and_gives_its_memory_back():
    from omiclake.llm import common

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    texts = [" ".join(f"w{(i * 7919 + j * j) % 200_003}" for j in range(1500)) for i in range(300)]
    words, length, number = lm.ordered(pa.array(texts, pa.string()))
    docs = lm.packed(doc_id=np.arange(len(texts)), fold=np.ones(len(texts), np.int8), bytes=np.zeros(len(texts), np.int64), length=length)
    row = pa.RecordBatch.from_arrays([pa.array([5]), *(pa.array([x], pa.binary()) for x in (docs, lm.packed(word=words), lm.planes(number)))], ["_block", "docs", "words", "ordered"])
    gate, n = lm.Classes([b"w1"]), len(number)
    common._powers.clear()
    gc.collect()
    lm.give_back()
    began = held()
    for read, kept in ((lm.in_order, "hash"), (lambda rows, _: lm.each(rows), "word")):
        last = None
        for at, block in read(iter([row] * 3), gate):
            assert at == 5 and hasattr(block, kept) and not (last is not None and vars(last)), "the block before is still held"
            assert sum(len(x.word) for x in block.spans()) == n if kept == "hash" else block.times.sum() == n
            last = block
    assert max(map(len, common._powers.values())) <= 1 << 18  # of a span or a word, not of all words of a block
    assert held() - began < 8 + n * 8 / 1e6
    data, ends = np.frombuffer(b"".join(lm.raw(words)), np.uint8), np.cumsum([0, *map(len, lm.raw(words))])
    assert (lm.word_hashes(words) == common.window_hash(common.prefix_hash(data), ends[:-1], ends[1:])).all()
    assert len(lm.word_hashes(words[:0])) == 0


def test_lm_counts_of_pieces_are_those_of_all(monkeypatch):
    words = [f"word{i * i}".encode() for i in range(300)] + [b"\n"]
    t, times = lm.Tokens(words, np.arange(301) % 8), np.arange(301.0)
    maps = []
    for piece in (1 << 16, 100):
        monkeypatch.setattr(lm, "PIECE", piece)
        m = lm.Model(*(np.random.default_rng(7).integers(0, 200, lm.INPUTS << lm.BITS).astype(x) for x in (np.int16, np.uint8)))
        m.observe(t, times)
        maps.append(m.map)
        assert sum(x.stop - x.start for x in t.pieces()) >= len(t.byte) and t.place.nbytes == 4 * lm.INPUTS * len(t.byte)
    assert (maps[0] == maps[1]).all() and maps[0].sum() == 8 * times[t.word].sum()
