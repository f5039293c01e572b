"""Operator 4: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its distinct words (by 64-bit hash) and their counts. For each word and each of 64
samples r and c are Gamma(2, 1) and b uniform in (0, 1), fixed by the hash. A word of weight w draws t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1); a sample keeps the word and t of the least a. Two texts agree in a
sample with a probability equal to the generalised Jaccard similarity of their weighted words.

r, c and b of a word come from three tables of fixed size (32,768 rows of 64 floats, 8 MB each, broadcast) by three different
parts of its hash, 15 bits each, so that two words have all three alike only by equal 45 bits. Documents are shuffled once, to
buckets of neighbouring ids; words are counted, sampled and compared within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omiclake.llm.common import documents

#: Rows of a table, as a power of two, and the lowest bit of a word's hash that names the row in each.
TABLE, PARTS = 15, {"r": 49, "lc": 34, "b": 19}
SAMPLES = 64
#: Fixed-point scale of ln a, and the bits below it that tell word and t.
SCALE, LOW = float(1 << 26), 31
#: Buckets of the first level, and of the second in each, at most.
COARSE, FINE = 256, 1024


def _uniform(name: str, sample: Column) -> Column:
    h = F.xxhash64(F.lit(name), F.col("id"), sample)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def gammas(spark: SparkSession, name: str, samples: int = SAMPLES) -> DataFrame:
    """_name, the row's number, and the array r, lc (ln c) or b of one number for each sample."""
    ks = F.sequence(F.lit(0), F.lit(samples - 1))
    gamma = lambda name, k: -(F.log(_uniform(f"{name}1", k)) + F.log(_uniform(f"{name}2", k)))
    draw = {"r": lambda k: gamma("r", k), "lc": lambda k: F.log(gamma("c", k)), "b": lambda k: _uniform("b", k)}[name]
    return spark.range(0, 1 << TABLE, 1, 8).select(F.col("id").cast("int").alias(f"_{name}"), F.transform(ks, lambda k: draw(k).cast("float")).alias(name))


def signatures(texts: DataFrame, keys: list[str], carry: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, the long columns carry, and sig, an array of ints that encode word and t; null for texts without words.

    texts must be partitioned by (some of) keys already, or is shuffled; keys name a text, and carry goes with them.
    """
    spark = texts.sparkSession
    words = texts.select(*keys, *carry, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("_w"))
    kept = [F.max(c).alias(c) for c in carry]
    drawn = words.withColumn("_h", F.when(F.col("_w") != "", F.xxhash64("_w"))).groupBy(*keys, "_h").agg(F.count("*").alias("n"), *kept)
    for name, low in PARTS.items():
        row = F.shiftrightunsigned("_h", low).bitwiseAND(F.lit((1 << TABLE) - 1)).cast("int")
        drawn = drawn.withColumn(f"_{name}", row).join(F.broadcast(gammas(spark, name, samples)), f"_{name}", "left").drop(f"_{name}")
    drawn = drawn.withColumn("lw", F.log(F.col("n").cast("double")))
    mask, least = F.lit((1 << LOW) - 1), []
    for k in range(samples):
        r, lc, b = (F.get(F.col(c), F.lit(k)) for c in PARTS)
        t = F.floor(F.col("lw") / r + b)
        a = ((lc - r * (t - b + 1)) * SCALE).cast("long")
        least.append(F.min(F.shiftleft(a, LOW).bitwiseOR(F.col("_h").bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(mask))).alias(f"m{k}"))
    sig = F.array(*[F.col(f"m{k}").bitwiseAND(mask).cast("int") for k in range(samples)])
    return drawn.groupBy(*keys).agg(*kept, *least).select(*keys, *carry, F.when(F.col("m0").isNotNull(), sig).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are like each other only."""
    n = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(n)


def hexed(sig: Column, samples: int = SAMPLES) -> Column:
    """Four hex digits for each sample; zeros for a text without words."""
    digits = F.transform(sig, lambda x: F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(x), F.lit(65536)))), 4, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit("0000" * samples))


def with_bucket(docs: DataFrame, rows: int = 512) -> DataFrame:
    """docs with _bucket: about so many rows of neighbouring ids, numbered in ascending order; null ids are in the first.

    Ids are cut at quantiles, and each part again at its own; only first ids of buckets reach the driver, COARSE * FINE at
    most. Beyond that buckets grow, and their windows spill.
    """
    ident = F.col("doc_id").cast("long")
    k = max(1, -(-docs.count() // rows))
    upper = min(k, COARSE)
    cut = lambda n: F.percentile_approx("_id", [i / n for i in range(1, n)], 20 * n)
    place = lambda cuts: F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("_id"))), F.lit(0))
    ids = docs.select(ident.alias("_id"))
    first = (ids.agg(cut(upper)).first()[0] or []) if upper > 1 else []
    coarse = place(F.lit(sorted(set(first)))) if first else F.lit(0)
    docs = docs.withColumn("_id", ident).withColumn("_part", F.when(F.col("_id").isNull(), F.lit(0)).otherwise(coarse).cast("int"))
    lower = min(FINE, -(-k // COARSE))
    if lower == 1:
        return docs.withColumn("_bucket", F.col("_part")).drop("_id", "_part")
    fine = ids.withColumn("_part", coarse.cast("int")).groupBy("_part").agg(F.array_distinct(cut(lower)).alias("_cuts"))
    docs = docs.join(F.broadcast(fine), "_part", "left")
    return docs.withColumn("_bucket", (F.col("_part") * lower + F.when(F.col("_id").isNull(), F.lit(0)).otherwise(place(F.col("_cuts")))).cast("int")).drop("_id", "_part", "_cuts")


def with_next(docs: DataFrame) -> DataFrame:
    """_bucket, _at, doc_id, text, next and extra: every row with the text of the next by ascending doc_id; the last's is the first.

    Rows go by doc_id, null first, then by text. Each bucket also holds the first row of the next one, marked extra.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = with_bucket(docs.select("doc_id", text))
    # The smallest id of each bucket, and whose bucket it closes; ids only.
    first = rows.groupBy(F.col("_bucket").alias("b")).agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("null"))
    found = sorted((r["b"], None if r["null"] else r["id"]) for r in first.collect())
    if not found:
        return rows.select("_bucket", F.lit(0).alias("_at"), "doc_id", "text", F.col("text").alias("next"), F.lit(False).alias("extra"))
    to = [(ident, b, found[i - 1][0]) for i, (b, ident) in enumerate(found)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    close = F.broadcast(docs.sparkSession.createDataFrame(to, f"_first {kind}, _own int, _before int"))
    extra = rows.join(close, rows["doc_id"].eqNullSafe(close["_first"]) & (rows["_bucket"] == close["_own"]))
    extra = extra.groupBy("_before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("_before").alias("_bucket"), F.lit(True).alias("extra"))
    every = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    w = Window.partitionBy("_bucket").orderBy("extra", "doc_id", "text")
    return every.select("_bucket", F.row_number().over(w).alias("_at"), "doc_id", "text", F.lead("text").over(w).alias("next"), "extra")


def edited_rows(docs: DataFrame) -> DataFrame:
    """with_next's rows and the edited text: the last half of the characters replaced by the first as many (or all) of next."""
    rows = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.char_length("text") - half).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    return rows.withColumn("edited", F.when(F.col("extra"), F.lit("")).otherwise(edited))


def edits(rows: DataFrame) -> DataFrame:
    """doc_id, n_chars and edited_sha256 of edited_rows' own rows; no words are taken apart."""
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    return rows.where(~F.col("extra")).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), digest.alias("edited_sha256"))


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    Null texts count as empty; wordless texts have a fingerprint of zeros, like each other only. A single row is its own
    next. Rows that repeat follow one another. An empty table gives no rows.
    """
    rows, n = edited_rows(docs), F.char_length("text")
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    parts = [F.conv(F.substring("_sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"_s{i}") for i in range(4)]
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    carry = ["_id", "n_chars", "_extra", *(f"_s{i}" for i in range(4))]
    own = rows.select("_bucket", "_at", F.col("doc_id").cast("long").alias("_id"), n.cast("long").alias("n_chars"), F.col("extra").cast("long").alias("_extra"), digest.alias("_sha"), kinds.alias("_t"))
    own = own.select("_bucket", "_at", "_id", "n_chars", "_extra", *parts, "_t.kind", "_t.text")
    sig = signatures(own, ["_bucket", "_at", "kind"], carry, samples)
    own = [F.max(F.when(F.col("kind") == k, F.col("sig"))).alias(c) for k, c in enumerate(("own", "changed"))]
    out = sig.groupBy("_bucket", "_at").agg(*[F.max(c).alias(c) for c in carry], *own)
    following = F.lead("own").over(Window.partitionBy("_bucket").orderBy("_at"))
    out = out.withColumn("following", following).where("_extra = 0")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"_s{i}")), 16, "0") for i in range(4)])
    return out.select(
        F.col("_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_chars", sha.alias("edited_sha256"), hexed(F.col("own"), samples).alias("fingerprint"), hexed(F.col("changed"), samples).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))
