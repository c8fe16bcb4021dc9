"""The query client over a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.operators.search import hybrid_search, hybrid_search_batch
from pagelode.sources.store import IndexStore, Manifest, read_flat_index


class SearchClient:
    """Loads an index, all of it or batch by batch, and answers queries."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, IndexStore(spark, path)
        self._manifest: Manifest | None = None
        self._chunks: DataFrame | None = None
        self._vectors: DataFrame | None = None
        self.loaded = 0

    def load(self, batches: int | None = None, on_batch_loaded: Callable[[int, int], None] | None = None) -> SearchClient:
        """Opens the index as of its last run; with ``batches`` only that many of its batches.

        ``on_batch_loaded`` is told (batches loaded, batches in all) after the first batch and
        after each further one; queries in between see what is loaded so far. An older flat
        index counts as one batch.
        """
        manifest = self.store.manifest()
        if manifest is None and self.store.is_flat():
            self._chunks, self._vectors, head = read_flat_index(self.spark, self.store.path)
            self._manifest = Manifest(head["model"] or "", head["dimensions"] or 0, status="complete", batch_count=1, run=1)
            self.loaded = 1
            if on_batch_loaded:
                on_batch_loaded(1, 1)
            return self
        if manifest is None:
            raise FileNotFoundError(f"no index in {self.store.path}")
        self._manifest = manifest
        every = self.store.chunks(manifest), self.store.vectors(manifest)
        most = manifest.batch_count if batches is None else min(batches, manifest.batch_count)
        for self.loaded in range(1, most) if on_batch_loaded else ():
            self._chunks, self._vectors = (d.where(F.col("batch_id") < self.loaded) for d in every)
            on_batch_loaded(self.loaded, manifest.batch_count)
        self.loaded = most
        self._chunks, self._vectors = (d.where(F.col("batch_id") < most) for d in every)
        if on_batch_loaded and most:
            on_batch_loaded(most, manifest.batch_count)
        return self

    @property
    def ready(self) -> bool:
        return self._chunks is not None and self.loaded > 0

    def progress(self) -> tuple[int, int]:
        return self.loaded, self._manifest.batch_count if self._manifest else 0

    def chunk_count(self) -> int:
        return self._chunks.count() if self._chunks is not None else 0

    def _need(self) -> tuple[DataFrame, DataFrame]:
        if self._chunks is None or self._vectors is None:
            raise RuntimeError("the index is not loaded; call load() first")
        return self._chunks, self._vectors

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(score, kw, chunk columns) of the k best chunks, best first; ties go to the earlier chunk."""
        chunks, vectors = self._need()
        top = hybrid_search(chunks, vectors, query, k, "chunk_id", "text", "vector")
        rows = top.join(chunks, "chunk_id").select("score", "kw", "chunk_id", "file", "heading", "text", "range")
        return rows.orderBy(F.desc("score"), F.desc("kw"), F.asc("chunk_id"))

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        chunks, vectors = self._need()
        return hybrid_search_batch(chunks, vectors, queries, k, "chunk_id", "text", "vector")
