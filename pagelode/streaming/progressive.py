"""Documents arrive as files, every micro-batch becomes searchable, and a restart neither skips nor repeats one."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelode.operators.chunking import chunk_in_order
from pagelode.plans.build import quantized
from pagelode.plans.embed import Embedder, HashingEmbedder
from pagelode.sources.store import IndexStore, Manifest, compression_type

#: A micro-batch's chunks are numbered from its id shifted by so many bits.
BATCH_BITS = 32


def progressive_index(
    spark: SparkSession, source: str, schema, store: IndexStore, checkpoint: str, size: int = 256, overlap: int = 32,
    embedder: Embedder | None = None, key: str = "doc_id", files_per_trigger: int = 1, model: str = "",
) -> StreamingQuery:
    """Chunks, embeds and quantizes parquet documents batch by batch into ``store``, whose file names are the keys.

    Micro-batch ``i`` is run ``i`` + 1 and batch ``i`` of the store. It counts once the
    manifest names it, and is searchable from then on; one that is replayed after a failure
    writes the same folders anew. The manifest says ``indexing`` until ``finish`` is called.
    The query ends when all present files are read.
    """
    embedder = embedder or HashingEmbedder()
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch_id + 1
        before = store.manifest() or Manifest()
        if before.run >= run:
            return  # it counted before the stream could note that
        cut = chunk_in_order(batch.select(F.col(key).cast("string").alias("file"), "text"), "file", "text", size, overlap)
        chunks = cut.withColumn("chunk_id", F.col("chunk_id") + F.lit(batch_id << BATCH_BITS)).withColumn("batch_id", F.lit(batch_id))
        total = chunks.count()
        store.bury(run, chunks.limit(0).select("chunk_id"))
        store.write_chunks(run, chunks)
        store.write_vectors(run, quantized(chunks, embedder), embedder.dimensions, compression_type(total))
        files = chunks.select("file").distinct().count()
        store.save_manifest(dataclasses.replace(
            before, model=model, dimensions=embedder.dimensions, status="indexing", run=run, batch_count=batch_id + 1,
            total_files=before.total_files + files, indexed_files=before.indexed_files + files, total_chunks=before.total_chunks + total,
        ))

    return (
        docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def finish(store: IndexStore) -> Manifest:
    """Marks a progressively written index as complete."""
    return store.update_manifest(status="complete")


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of each micro-batch so far."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
