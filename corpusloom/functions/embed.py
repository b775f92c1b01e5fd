"""Text embedders: a hashing embedder without any model, and the protocol that a model would fill."""

from __future__ import annotations

import hashlib
import importlib.util
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingError
from ..staging import split_repeated


KNOWN_TOKENS = 1 << 17  # places of tokens that a task remembers before it starts anew
ROWS_AT_ONCE = 256  # vectors that a task makes at a time


class Embedder(Protocol):
    """Turns ``id, text`` rows into ``id, embedding`` rows of unit (or zero) vectors."""

    name: str
    dim: int
    signature: str

    def encode(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


def _bucket_of(vocabulary: DataFrame, dim: int) -> DataFrame:
    """``token, bucket, sign`` by BLAKE2b, on distinct tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for t in batch["token"]]
            yield pd.DataFrame({"token": batch["token"], "bucket": [x % dim for x in v], "sign": [1.0 if x >> 63 else -1.0 for x in v]})

    return vocabulary.mapInPandas(run, "token string, bucket int, sign double")


def md5_bucket(token: Column, dim: int) -> tuple[Column, Column]:
    """(bucket, sign) by MD5, in built-in functions: what a SQL engine can repeat."""
    value = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return F.pmod(value, F.lit(dim)).cast("int"), F.when(value >= (1 << 31), 1.0).otherwise(-1.0)


def sparse_embedding(rows: DataFrame, id_col: str, text_col: str, dim: int, hasher: str = "blake2b") -> DataFrame:
    """``id, bucket, weight``: signed token counts by bucket, scaled to unit length; texts without tokens have no rows.  A text's
    tokens are counted where it lies; only texts whose id repeats, which are one, are shuffled."""
    alone, repeated = split_repeated(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    embedder = HashingEmbedder(dim, hasher)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, float]] = {}
        for part in (batch.iloc[at : at + ROWS_AT_ONCE] for batch in batches for at in range(0, len(batch), ROWS_AT_ONCE)):
            if len(known) > KNOWN_TOKENS:
                known.clear()
            vectors = np.array([embedder.encode_one(t or "", known) for t in part["text"]])
            row, bucket = np.nonzero(vectors)
            yield pd.DataFrame({"id": part["id"].to_numpy()[row], "bucket": bucket.astype(np.int32), "weight": vectors[row, bucket]})

    placed = alone.mapInPandas(run, f"id {alone.schema['id'].dataType.simpleString()}, bucket int, weight double")
    return placed if repeated is None else placed.unionByName(_sparse_by_shuffle(repeated, dim, hasher))


def _sparse_by_shuffle(rows: DataFrame, dim: int, hasher: str) -> DataFrame:
    """``sparse_embedding`` of ``id, text``, whichever rows an id's tokens are in."""
    tokens = rows.select("id", F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    counts = tokens.groupBy("id", "token").agg(F.count("*").alias("n"))
    if hasher == "md5":
        bucket, sign = md5_bucket(F.col("token"), dim)
        placed = counts.select("id", bucket.alias("bucket"), (sign * F.col("n")).alias("v"))
    else:
        vocabulary = _bucket_of(counts.select("token").distinct(), dim)
        placed = counts.join(vocabulary, "token").select("id", "bucket", (F.col("sign") * F.col("n")).alias("v"))
    sums = placed.groupBy("id", "bucket").agg(F.sum("v").alias("v")).where("v != 0")
    norms = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).select("id", "bucket", (F.col("v") / F.col("norm")).alias("weight"))


class HashingEmbedder:
    """Signed bucket counts of tokens; related only by shared words, but needs no model."""

    name = "hashing"

    def __init__(self, dim: int = 512, hasher: str = "blake2b"):
        if dim <= 0:
            raise EmbeddingError(f"dim must be positive, not {dim}")
        self.dim, self.hasher, self.signature = dim, hasher, f"hashing:{dim}" + ("" if hasher == "blake2b" else f":{hasher}")

    def _place(self, token: str) -> tuple[int, float]:
        """(bucket, sign) of a token; by MD5 as ``md5_bucket`` has it."""
        if self.hasher == "md5":
            v = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")
            return v % self.dim, 1.0 if v >> 31 else -1.0
        v = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        return v % self.dim, 1.0 if v >> 63 else -1.0

    def encode_one(self, text: str, known: dict[str, tuple[int, float]] | None = None) -> np.ndarray:
        """``known`` holds the places of tokens that were met before, and takes up new ones."""
        known, out = {} if known is None else known, np.zeros(self.dim)
        for token, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
            place = known.get(token)
            if place is None:
                place = known[token] = self._place(token)
            out[place[0]] += place[1] * n
        norm = np.linalg.norm(out)
        return out / norm if norm else out

    def encode(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """One Arrow pass; a text's vector needs nothing but the text, so nothing is shuffled."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, tuple[int, float]] = {}
            for part in (batch.iloc[at : at + ROWS_AT_ONCE] for batch in batches for at in range(0, len(batch), ROWS_AT_ONCE)):
                if len(known) > KNOWN_TOKENS:
                    known.clear()
                yield pd.DataFrame({"id": part["id"], "embedding": [self.encode_one(t or "", known).astype(np.float32) for t in part["text"]]})

        base = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return base.mapInPandas(run, f"id {base.schema['id'].dataType.simpleString()}, embedding array<float>")


class ModelEmbedder:
    """A sentence-embedding model, loaded once per worker when first used; needs its library installed.  ``dim`` is the
    model's width, so that the driver need not load it; vectors of another width are refused when they are stored."""

    name = "sentence-transformers"

    def __init__(self, model: str = "sentence-transformers/all-MiniLM-L6-v2", batch_size: int = 64, dim: int = 384):
        if importlib.util.find_spec("sentence_transformers") is None:
            raise EmbeddingError("the sentence-transformers library is not installed; use provider: hashing")
        self.model, self.batch_size, self.signature = model, batch_size, f"sentence-transformers:{model}"
        self.dim = dim

    def encode(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        name, size = self.model, self.batch_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name, device="cpu")
            for batch in batches:
                vectors = model.encode(batch["text"].fillna("").tolist(), batch_size=size, normalize_embeddings=True)
                yield pd.DataFrame({"id": batch["id"], "embedding": list(vectors)})

        base = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return base.mapInPandas(run, f"id {base.schema['id'].dataType.simpleString()}, embedding array<float>")


def make_embedder(config: Mapping[str, object] | None = None) -> Embedder:
    """By ``provider`` (hashing, hash or test; sentence-transformers, st or local); hosted services are refused."""
    config = config or {}
    provider = str(config.get("provider", "hashing")).lower()
    if provider in ("hashing", "hash", "test"):
        return HashingEmbedder(int(config.get("dim", 512)))
    if provider in ("sentence-transformers", "st", "local"):
        return ModelEmbedder(str(config.get("model", "sentence-transformers/all-MiniLM-L6-v2")), int(config.get("batch_size", 64)), int(config.get("dim", 384)))
    raise EmbeddingError(f"unknown embedding provider {provider!r}; embeddings are computed locally, by hashing or sentence-transformers")
