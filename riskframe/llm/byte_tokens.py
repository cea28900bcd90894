"""Token ids of whole texts by a byte-level BPE file (ranks and special tokens are read from it)."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from riskframe.llm.common import worker_cache
from riskframe.llm.segment import byte_alphabet

# fixed value: the pattern that byte-level BPE files of this kind cut by
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file is on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_file(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file (a few MB, read on the driver) for all tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class ByteEncoder:
    """encode(text): the ids of a text, special tokens in it included, as an array of unsigned 32-bit integers."""

    def __init__(self, spec: bytes):
        import tiktoken

        data = json.loads(spec)
        of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(of[c] for c in token): rank for token, rank in data["model"]["vocab"].items()}
        specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def encode(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all")


def byte_encoder(spec: bytes) -> ByteEncoder:
    """The worker's encoder for a tokenizer file."""
    cache, key = worker_cache(), hashlib.md5(spec).hexdigest()
    if key not in cache:
        cache[key] = ByteEncoder(spec)
    return cache[key]
