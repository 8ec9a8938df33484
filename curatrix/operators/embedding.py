"""Embedding as a pluggable step with a persistent cache, and a hashing embedder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import prepared
from curatrix.session import stored

Embedder = Callable[[list[str]], np.ndarray]
CACHE_SCHEMA = "text_hash string, model string, vec array<float>"


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of lower-case words, of length 1; equal texts get equal vectors everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                row[h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)

    return embed


def cache_model(model: str, dim: int | None = None) -> str:
    return model if dim is None else f"{model}:dim={dim}"


def cache_split(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with vec, misses) of texts(..., text) in the cache of one model."""
    keyed = texts.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    mine = cache.where(F.col("model") == model).select("text_hash", "vec")
    return keyed.join(mine, "text_hash"), keyed.join(mine.select("text_hash"), "text_hash", "left_anti")


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """cache with rows(text_hash, model, vec) added; a new row replaces the old one of its key."""
    new = rows.groupBy("text_hash", "model").agg(F.max("vec").alias("vec"))
    return cache.join(new.select("text_hash", "model"), ["text_hash", "model"], "left_anti").unionByName(new)


def cache_clear(cache: DataFrame, model: str) -> DataFrame:
    return cache.where(~F.col("model").eqNullSafe(F.lit(model)))


def embedded(texts: DataFrame, embed: Embedder, model: str = "hashing", cache: DataFrame | None = None, genericize: bool = False, batch: int = 64, transform=None) -> tuple[DataFrame, DataFrame]:
    """(texts with vec, the enlarged cache): every distinct prepared text is embedded once, null texts as empty ones.

    The cache keeps vectors as the model gave them; transform (a Whitening) is applied afterwards.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("_p", prepared(F.coalesce("text", F.lit("")), genericize)).withColumn("text_hash", F.sha2("_p", 256))
    cache = spark.createDataFrame([], CACHE_SCHEMA) if cache is None else cache
    known = cache.where(F.col("model") == model).select("text_hash")
    todo = keyed.select("text_hash", "_p").distinct().join(known, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"text_hash": part.text_hash, "model": model, "vec": list(np.asarray(embed(part._p.tolist()), np.float32))})

    # Written once: both results read it, and the model runs only once.
    full = cache_put(cache, stored(todo.mapInPandas(run, CACHE_SCHEMA), "vectors"))
    out = keyed.join(full.where(F.col("model") == model).select("text_hash", "vec"), "text_hash").drop("_p", "text_hash")
    return (out if transform is None else transform.apply(out)), full
