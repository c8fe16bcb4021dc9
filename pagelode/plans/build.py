"""Building and refreshing an index from a table of documents or a folder."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.config import SearchConfig, load_project_config, load_user_config, resolve_config
from pagelode.functions.vectors import quantize, quantize_params
from pagelode.operators.chunking import chunk_in_order
from pagelode.operators.incremental import changed_files, deleted_files, detect_changes, is_current, parse_git_status, upsert_manifest
from pagelode.operators.nav import first_headings, nav_nodes, nav_order
from pagelode.plans.embed import Embedder
from pagelode.session import cut_lineage
from pagelode.sources.files import git_status, list_files, read_texts
from pagelode.sources.store import IndexStore, Manifest, compression_type

Progress = Callable[[str, int, int], None]
Read = Callable[[DataFrame], DataFrame]


def quantized(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """The chunks with ``vector``, the codes of their embedding, null where there is none."""
    dims = embedder.dimensions
    codes = quantize(F.col("embedding"), quantize_params(F.col("embedding"), dims), dims)
    return embedder.embed(chunks).withColumn("vector", F.when(F.col("embedding").isNotNull(), codes)).drop("embedding")


def build_index(
    spark: SparkSession, documents: DataFrame, store: IndexStore, embedder: Embedder,
    config: SearchConfig | None = None, progress: Progress | None = None, read: Read | None = None, changed: DataFrame | None = None,
) -> Manifest:
    """Brings the store up to date with ``documents`` (path, mtime, size, and text unless ``read`` adds it to the rows it is given).

    New and modified files are chunked, embedded, quantized and written as a new run of
    batches; chunks of modified or vanished files are buried by that run. All of it counts
    from the one write of the manifest at the end: until then readers keep what they had,
    and a run that died is done again from the last state that counted, under the same
    names. A changed model, or ``incremental`` switched off, builds all files anew.
    ``changed`` (path) replaces the comparison of mtime and size.
    """
    config = config or SearchConfig()
    tell = progress or (lambda phase, done, total: None)
    before = store.manifest()
    base = before or Manifest()
    fresh = base.run == 0 or base.model != config.model or base.dimensions != embedder.dimensions or not config.incremental
    listing = documents.select("path", "mtime", "size")
    stored = store.files(base)
    previous = stored.limit(0) if fresh else stored
    todo = changed_files(listing, previous).select("path") if fresh or changed is None else changed.select("path")
    gone = deleted_files(listing, previous)
    if not fresh and is_current(todo.unionByName(gone), base.status):
        return base
    run = base.run + 1
    store.save_manifest(dataclasses.replace(base, status="indexing"))
    tell("chunking", 0, 0)
    rows = documents.join(todo, "path", "left_semi")
    chunks = chunk_in_order(read(rows) if read else rows, "path", "text", config.chunk_size, config.chunk_overlap)
    start = 0 if fresh else base.batch_count
    chunks = chunks.select(
        (F.col("chunk_id") + start * 256).alias("chunk_id"), F.col("path").alias("file"), "heading", "text", "range",
        (F.col("batch_id") + start).alias("batch_id"),
    )
    total = chunks.count()
    tell("saving", 0, total)
    store.write_chunks(run, chunks)
    old = store.chunks(base).select("chunk_id", "file")
    stale = todo.unionByName(gone).withColumnRenamed("path", "file")
    store.bury(run, (old.limit(0) if fresh else old.join(stale, "file", "left_semi")).select("chunk_id"))
    tell("embedding", 0, total)
    store.write_vectors(run, quantized(chunks, embedder), embedder.dimensions, compression_type(total))
    store.write_files(run, upsert_manifest(previous, listing))
    done = dataclasses.replace(
        base, model=config.model, dimensions=embedder.dimensions, status="complete", run=run,
        first_run=run if fresh else base.first_run, batch_count=start + (total + 255) // 256,
    )
    now = store.chunks(done)
    heads = first_headings(now).withColumnRenamed("file", "path").withColumnRenamed("heading", "title")
    store.write_navigation(run, nav_order(nav_nodes(listing.select("path").join(heads, "path", "left"))))
    files = listing.select("path").distinct().count()
    done = dataclasses.replace(done, total_files=files, indexed_files=files, total_chunks=now.count())
    store.save_manifest(done)
    tell("complete", total, total)
    return done


def index_directory(
    spark: SparkSession, root: str, store: IndexStore, embedder: Embedder, config: SearchConfig | None = None,
    progress: Progress | None = None, use_git: bool = False,
) -> Manifest:
    """Crawl, chunk, embed, quantize and store a folder of documents; only changed files are read.

    Without ``config`` the settings come from the project's and the user's files. With
    ``use_git`` the files that git names are taken where it names any listed one, and new
    files besides; else, and where git cannot tell, mtime and size decide.
    """
    config = config or resolve_config(load_project_config(root), load_user_config(os.path.expanduser("~")))
    (progress or (lambda phase, done, total: None))("crawling", 0, 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listing = cut_lineage(list_files(spark, root, list(config.include), list(config.exclude)))
    changed = None
    before = store.manifest()
    lines = git_status(spark, root) if use_git and before and before.status == "complete" else None
    if lines is not None:
        known = store.files(before)
        added = listing.join(known, "path", "left_anti").select("path")
        changed = cut_lineage(detect_changes(listing, known, parse_git_status(lines)).union(added).distinct())
    # The files to read are dealt out before they are opened.
    return build_index(
        spark, listing, store, embedder, config, progress, lambda rows: read_texts(rows.repartition(tasks, "path"), root), changed
    )
