"""Operator 5: byte-level BPE through a sentencepiece model made from the vocabulary.

The model is serialised here, field by field, from the rank file: each rank's bytes are mapped to one
character each, a piece's score is its negative rank, the normaliser is the identity. sentencepiece
merges the best-scored pair first, leftmost of equals, which is the rank order. Pre-tokens come from
the pattern, each is encoded once and remembered; the ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from omiclake.llm.common import Once, by_text, documents

#: Remembered chunks and pre-tokens of a worker; forgotten together when there are so many.
REMEMBERED = 400_000
#: Fixed value: the byte-level pattern. Below LATIN all libraries agree on what letters are.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = "\u0250"


def byte_characters() -> list[str]:
    """A character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, data: bytes | int) -> bytes:
    return _varint(number << 3) + _varint(data) if isinstance(data, int) else _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """A ModelProto: piece i + 1 is token i (piece 0 is unknown), its score -i; BPE; identity normalisation."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(chars[b] for b in t), float(-i), 1) for i, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes texts to the ids of a rank file and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.chars = byte_characters()
        self.pattern = regex.compile(pattern)
        self.cuttable = pattern == PATTERN
        self.odd = re.compile(r" \s")
        self.known: dict[str, bytes] = {}  # what follows a space
        self.pieces: dict[str, bytes] = {}  # pre-tokens

    def _encode(self, pieces: list[str]) -> None:
        """Remembers the ids of new pre-tokens."""
        mapped = ["".join([self.chars[b] for b in p.encode()]) for p in pieces]
        for p, ids in zip(pieces, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            if 0 in ids:
                raise ValueError("the vocabulary lacks a byte")
            self.pieces[p] = struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])

    def _joined(self, texts: list[str]) -> list[bytes]:
        parts = [[t] if t[:1] == " " and t[1:].isalpha() and max(t) < LATIN and self.cuttable else self.pattern.findall(t) for t in texts]
        self._encode(list({p for ps in parts for p in ps if p not in self.pieces}))
        return [b"".join([self.pieces[p] for p in ps]) for ps in parts]

    def encode(self, text: str) -> np.ndarray:
        """Matches of the usual pattern never reach over a space that follows or precedes a word, so a text is cut there.

        Only a space between two white-space characters may lie within a match; such texts, and other patterns', go uncut.
        """
        if len(self.known) + len(self.pieces) > REMEMBERED:
            self.known.clear()
            self.pieces.clear()
        if not self.cuttable or self.odd.search(text):
            return np.frombuffer(self._joined([text])[0], "<u4")
        cut = text.split(" ")
        out = list(map(self.known.get, cut))
        out[0] = None
        new = list({c for c, ids in zip(cut, out, strict=True) if ids is None} - {cut[0]}) if None in out[1:] else []
        new += [cut[0]] if cut[0] in cut[1:] and cut[0] not in self.known else []
        first, *rest = self._joined([cut[0], *[" " + c for c in new]])
        self.known.update(zip(new, rest, strict=True))
        out = list(map(self.known.get, cut)) if new else out
        out[0] = first
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: the whole text's tokens.

    A null or empty text has no tokens. Rows are coded one by one, so repeated rows give repeated rows,
    and other columns of docs don't matter.
    """
    coder = Once(Coder, path, pattern)

    def run(texts: list[bytes]) -> dict:
        c = coder()
        n, digest, back, all_ids = [], [], [], []
        for t in texts:
            ids = c.encode(t.decode()).tolist()
            n.append(len(ids))
            digest.append(hashlib.sha256(" ".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(ids)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest), "decoded_sha256": pa.array(back)}
        return out | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {})

    return by_text(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
