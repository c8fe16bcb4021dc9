"""Embedders: anything that turns a text column into a float vector column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import WORD_RE, truncate_for_embedding


class Embedder(Protocol):
    dimensions: int

    def embed(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        """The chunks with a column ``embedding``."""


class HashingEmbedder:
    """Deterministic feature hashing of the words of the first 1000 characters, L2-normalised.

    Null and blank texts get a null vector, so search falls back to the keyword score.
    """

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def vector(self, text: str | None) -> list[float] | None:
        out = np.zeros(self.dimensions)
        for word in WORD_RE.findall((text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = float(np.sqrt((out * out).sum()))
        return (out / norm).tolist() if norm else None

    def column(self, text: Column) -> Column:
        vector = self.vector

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(vector)

        return run(truncate_for_embedding(text))

    def embed(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        return chunks.withColumn("embedding", self.column(F.col(text)))


class TableEmbedder:
    """Vectors that were computed elsewhere, joined by key; chunks without one get null."""

    def __init__(self, vectors: DataFrame, dimensions: int, key: str = "chunk_id", vector: str = "embedding") -> None:
        self.dimensions = dimensions
        self.vectors = vectors.select(F.col(key).alias("chunk_id"), F.col(vector).alias("embedding"))

    def embed(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        return chunks.join(self.vectors, "chunk_id", "left")


#: Models that this Python process has loaded, by their files.
_models: dict[tuple[str, str], tuple] = {}


def load_model(model_path: str, tokenizer_path: str) -> tuple:
    """(tokenizer, session, input names) of an ONNX model, loaded once per Python process, whatever the number of its tasks."""
    key = model_path, tokenizer_path
    if key not in _models:
        import onnxruntime
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.enable_padding()
        model = onnxruntime.InferenceSession(model_path)
        _models[key] = tok, model, {i.name for i in model.get_inputs()}
    return _models[key]


class OnnxEmbedder:
    """A sentence model in ONNX form with its tokenizer file: mean-pooled and L2-normalised. Null and empty texts get null."""

    def __init__(self, model_path: str, tokenizer_path: str, dimensions: int, batch: int = 128) -> None:
        self.model_path, self.tokenizer_path, self.dimensions, self.batch = model_path, tokenizer_path, dimensions, batch

    def embed(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        paths, size = (self.model_path, self.tokenizer_path), self.batch

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tok, model, names = load_model(*paths)
            for batch in batches:
                out: list = [None] * len(batch)
                given = [i for i, t in enumerate(batch) if t]
                for at in range(0, len(given), size):
                    rows = given[at : at + size]
                    enc = tok.encode_batch([batch.iloc[i] for i in rows])
                    mask = np.array([e.attention_mask for e in enc], dtype=np.int64)
                    feed = {"input_ids": np.array([e.ids for e in enc], dtype=np.int64), "attention_mask": mask}
                    if "token_type_ids" in names:
                        feed["token_type_ids"] = np.zeros_like(mask)
                    hidden = model.run(None, {k: v for k, v in feed.items() if k in names})[0]
                    pooled = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
                    for i, v in zip(rows, pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)):
                        out[i] = v.astype(np.float32).tolist()
                yield pd.Series(out)

        return chunks.withColumn("embedding", run(truncate_for_embedding(F.col(text))))
