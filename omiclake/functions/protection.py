"""Authenticated encryption of rows, and digests. Keys are Columns or literals of 16, 24 or 32 bytes; keep them out of plans you log."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def channel_aad(dataset_id: Column, au_sequence: Column, channel: Column) -> Column:
    """Little-endian u16 dataset, u32 sequence, then the channel's name."""
    little = lambda c, n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)]))
    return F.concat(little(dataset_id, 2), little(au_sequence, 4), channel.cast("binary"))


def sealed(data: Column, key: Column, iv: Column, aad: Column) -> Column:
    """Struct of iv (12 bytes), ciphertext and tag (16 bytes) of AES-GCM."""
    box = F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)
    n = F.octet_length(box)
    return F.struct(F.substring(box, F.lit(1), F.lit(12)).alias("iv"), F.substring(box, F.lit(13), n - 28).alias("ciphertext"), F.substring(box, n - 15, F.lit(16)).alias("tag"))


def opened(box: Column, key: Column, aad: Column) -> Column:
    """The plain bytes; a segment with an empty iv is clear. A wrong key, tag or AAD raises."""
    whole = F.concat(box["iv"], box["ciphertext"], box["tag"])
    return F.when(F.octet_length(box["iv"]) == 0, box["ciphertext"]).otherwise(F.aes_decrypt(whole, key, F.lit("GCM"), F.lit("DEFAULT"), aad))


def sealed_by_region(segments: DataFrame, keys: DataFrame, iv: Column) -> DataFrame:
    """box of each segment (dataset_id, au_sequence, channel, chromosome, data) under its chromosome's key; without one it stays clear."""
    own = segments.join(keys.select("chromosome", "key"), "chromosome", "left")
    aad = channel_aad(F.col("dataset_id"), F.col("au_sequence"), F.col("channel"))
    empty = F.lit(b"")
    clear = F.struct(empty.alias("iv"), F.col("data").alias("ciphertext"), empty.alias("tag"))
    return own.withColumn("box", F.when(F.col("key").isNull(), clear).otherwise(sealed(F.col("data"), F.coalesce("key", F.lit(bytes(16))), iv, aad))).drop("key", "data")


def signed(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """hmac: hex HMAC-SHA-256 of a binary column, in Arrow batches."""

    def run(batches):
        for b in batches:
            out = [None if x is None else hmac.new(key, x, hashlib.sha256).hexdigest() for x in b.column(column).to_pylist()]
            yield b.append_column("hmac", pa.array(out, pa.string()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("hmac", StringType())]))
