"""The index store: chunks, vectors, files and navigation as parquet by run, and a small manifest.

Every run writes folders of its own (``chunks/run=R``, ``vectors/run=R``, ``buried/run=R``,
``files/run=R``, ``navigation/run=R``), and one rename of ``manifest.json`` makes them
count. Readers only see runs that the manifest names, so a run that died leaves nothing
behind but folders that its retry writes anew. Chunks are never rewritten: a run buries
the ids that it replaces, and burying concerns the rows of earlier runs only.

Batches of 256 chunks are a column, not folders; rows are written in chunk order, so the
row groups' bounds let a filter on ``batch_id`` skip the rest.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions.vectors import PQ_AT, TERNARY_AT, ternary_pack, ternary_unpack
from pagelode.schemas import CHUNK, FILE_RECORD, NAV_NODE
from pagelode.sources.fs import SharedFolder

STORED_CHUNK = T.StructType([*CHUNK.fields, T.StructField("batch_id", T.IntegerType())])
STORED_VECTOR = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("dimensions", T.IntegerType()),
    T.StructField("compression", T.StringType()),
    T.StructField("codes", T.ArrayType(T.ByteType())),
    T.StructField("packed", T.BinaryType()),
    T.StructField("batch_id", T.IntegerType()),
])
BURIED = T.StructType([T.StructField("chunk_id", T.LongType())])
#: The folders of a run.
PARTS = ("chunks", "vectors", "buried", "files", "navigation")


@dataclass(frozen=True)
class Manifest:
    """The stored header. ``run`` is the last run that counts, ``first_run`` the first one since the last rebuild."""

    model: str = ""
    dimensions: int = 0
    version: int = 1
    status: str = "indexing"
    total_files: int = 0
    indexed_files: int = 0
    total_chunks: int = 0
    batch_count: int = 0
    run: int = 0
    first_run: int = 1

    def __post_init__(self) -> None:
        if self.status not in ("indexing", "complete"):
            raise ValueError(f"unknown status {self.status}")


def compression_type(chunks: int) -> str:
    """The codec for that many chunks."""
    return "pq" if chunks >= PQ_AT else "ternary" if chunks >= TERNARY_AT else "none"


class IndexStore:
    """Reads and writes one index folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = SharedFolder(spark, self.path)

    # ---- the manifest

    def manifest(self) -> Manifest | None:
        """None where it is missing or cannot be read."""
        got = self.folder.read_json("manifest.json")
        try:
            return None if got is None else Manifest(**got)
        except (TypeError, ValueError):
            return None

    def save_manifest(self, manifest: Manifest) -> None:
        self.folder.write_json("manifest.json", dataclasses.asdict(manifest))

    def update_manifest(self, **changes) -> Manifest:
        """Merges into the stored manifest, or into an empty one."""
        merged = dataclasses.replace(self.manifest() or Manifest(), **changes)
        self.save_manifest(merged)
        return merged

    def is_flat(self) -> bool:
        """True for an older index of one JSON and one binary file."""
        return not self.folder.exists("manifest.json") and self.folder.exists("search-index.json")

    def searchable(self) -> bool:
        """True as soon as a first run counts, or where a flat index lies."""
        manifest = self.manifest()
        return self.is_flat() if manifest is None else manifest.run > 0 and manifest.batch_count > 0

    # ---- writing

    def _write(self, name: str, run: int, rows: DataFrame, schema: T.StructType) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        typed.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

    def write_chunks(self, run: int, chunks: DataFrame) -> None:
        self._write("chunks", run, chunks, STORED_CHUNK)

    def write_vectors(self, run: int, vectors: DataFrame, dims: int, compression: str) -> None:
        """Stores (chunk_id, vector, batch_id); null vectors are left out."""
        packed = compression != "none"
        rows = vectors.where(F.col("vector").isNotNull()).select(
            "chunk_id", F.lit(dims).alias("dimensions"), F.lit(compression).alias("compression"),
            (F.lit(None) if packed else F.col("vector")).cast("array<tinyint>").alias("codes"),
            (ternary_pack(F.col("vector")) if packed else F.lit(None)).cast("binary").alias("packed"), "batch_id",
        )
        self._write("vectors", run, rows, STORED_VECTOR)

    def bury(self, run: int, chunk_ids: DataFrame) -> None:
        """Rows of these ids that runs before ``run`` wrote are gone once ``run`` counts."""
        self._write("buried", run, chunk_ids, BURIED)

    def write_files(self, run: int, files: DataFrame) -> None:
        """The whole file table as of that run."""
        self._write("files", run, files, FILE_RECORD)

    def write_navigation(self, run: int, nodes: DataFrame) -> None:
        """The whole navigation tree as of that run, as an adjacency table."""
        self._write("navigation", run, nodes, NAV_NODE)

    def save_batches(self, chunks: DataFrame, vectors: DataFrame, dims: int, compression: str) -> Manifest:
        """Writes the batches that the rows name by ``batch_id`` as a run of their own; those batches are replaced, others stay."""
        before = self.manifest() or Manifest(dimensions=dims)
        run = before.run + 1
        batches = chunks.select(F.col("batch_id").cast("int")).distinct()
        old = self.view("chunks", STORED_CHUNK, before).select("chunk_id", "batch_id").join(batches, "batch_id", "left_semi")
        self.bury(run, old.select("chunk_id"))
        self.write_chunks(run, chunks.sortWithinPartitions("batch_id", "chunk_id"))
        self.write_vectors(run, vectors.sortWithinPartitions("batch_id", "chunk_id"), dims, compression)
        last = batches.agg(F.max("batch_id")).first()[0]
        after = dataclasses.replace(before, run=run, batch_count=max(before.batch_count, -1 if last is None else last + 1, 0))
        after = dataclasses.replace(after, total_chunks=self.chunks(after).count())
        self.save_manifest(after)
        return after

    def save_whole(self, chunks: DataFrame, vectors: DataFrame, model: str, dims: int) -> Manifest:
        """A finished index written as the single batch 0, in place of what was stored."""
        run = (self.manifest() or Manifest()).run + 1
        total = chunks.count()
        zero = F.lit(0).alias("batch_id")
        self.bury(run, chunks.limit(0).select("chunk_id"))
        self.write_chunks(run, chunks.drop("batch_id").select("*", zero).sortWithinPartitions("chunk_id"))
        self.write_vectors(run, vectors.drop("batch_id").select("*", zero).sortWithinPartitions("chunk_id"), dims, compression_type(total))
        files = chunks.select("file").distinct().count()
        done = Manifest(model, dims, status="complete", total_files=files, indexed_files=files, total_chunks=total, batch_count=1, run=run, first_run=run)
        self.save_manifest(done)
        return done

    def vacuum(self) -> None:
        """Deletes what runs before the last rebuild wrote; readers that opened the index before it must be gone."""
        manifest = self.manifest()
        for run in range(1, manifest.first_run if manifest else 1):
            for name in PARTS:
                self.folder.delete(f"{name}/run={run}")

    # ---- reading

    def view(self, name: str, schema: T.StructType, manifest: Manifest) -> DataFrame:
        """A part's rows as of a manifest: of its runs only, without the buried."""
        own = T.StructType([*schema.fields, T.StructField("run", T.IntegerType())])
        if manifest.run < manifest.first_run or not self.folder.exists(name):
            return self.spark.createDataFrame([], own)
        runs = (F.col("run") >= manifest.first_run) & (F.col("run") <= manifest.run)
        rows = self.spark.read.schema(own).parquet(f"{self.path}/{name}").where(runs)
        if name == "buried" or "chunk_id" not in schema.names:
            return rows
        gone = self.view("buried", BURIED, manifest).toDF("_gone", "_by")
        return rows.join(gone, (F.col("chunk_id") == F.col("_gone")) & (F.col("run") < F.col("_by")), "left_anti")

    def _known(self, manifest: Manifest | None) -> Manifest:
        manifest = manifest or self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no index in {self.path}")
        return manifest

    def chunks(self, manifest: Manifest | None = None) -> DataFrame:
        return self.view("chunks", STORED_CHUNK, self._known(manifest)).drop("run")

    def vectors(self, manifest: Manifest | None = None) -> DataFrame:
        """(chunk_id, batch_id, vector) as a reader sees them, packed ones unpacked."""
        v = self.view("vectors", STORED_VECTOR, self._known(manifest))
        codes = F.when(F.col("compression") == "none", F.col("codes")).otherwise(ternary_unpack(F.col("packed"), F.col("dimensions")))
        return v.select("chunk_id", "batch_id", codes.alias("vector"))

    def batch(self, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """One batch; the filter reaches the scan."""
        return self.chunks().where(F.col("batch_id") == batch_id), self.vectors().where(F.col("batch_id") == batch_id)

    def batches_upto(self, loaded: int) -> DataFrame:
        """The chunks that a client has after ``loaded`` batches."""
        return self.chunks().where(F.col("batch_id") < loaded)

    def batch_meta(self) -> DataFrame:
        """(batch_id, dimensions, compression, vectorcount) of every batch with vectors."""
        v = self.view("vectors", STORED_VECTOR, self._known(None))
        return v.groupBy("batch_id", "dimensions", "compression").agg(F.count("*").alias("vectorcount"))

    def _latest(self, name: str, schema: T.StructType, manifest: Manifest | None) -> DataFrame:
        """A part that every build writes whole: of the last run that has it."""
        manifest = manifest or self.manifest() or Manifest()
        for run in range(manifest.run, manifest.first_run - 1, -1):
            if self.folder.exists(f"{name}/run={run}"):
                return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/run={run}")
        return self.spark.createDataFrame([], schema)

    def files(self, manifest: Manifest | None = None) -> DataFrame:
        return self._latest("files", FILE_RECORD, manifest)

    def navigation(self, manifest: Manifest | None = None) -> DataFrame:
        return self._latest("navigation", NAV_NODE, manifest)

    def export_navigation(self) -> list[dict]:
        """The tree nested as in ``navigation.json``, which is written beside the index. It is one file, so the tree is held by the driver."""
        from pagelode.operators.nav import nested_tree

        tree = nested_tree(self.navigation())
        self.folder.write_json("navigation.json", {"tree": tree})
        return tree


def size_stats(chunks: DataFrame, dims: int) -> DataFrame:
    """(chunks, meta_kb, vector_kb): UTF-16 units of the chunks' JSON array and bytes of their codes, in KB.

    An empty table has the two brackets of its array.
    """
    span = F.when(F.col("range").isNotNull(), F.array("range.start", "range.end"))
    row = F.to_json(F.struct("file", "heading", "text", span.alias("range")))
    units = F.length(row) + F.regexp_count(row, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    n = F.count("*")
    whole = F.coalesce(F.sum(units), F.lit(0)) + F.greatest(n - 1, F.lit(0)) + 2
    return chunks.agg(n.alias("chunks"), (whole / 1024).alias("meta_kb"), (n * dims / 1024).alias("vector_kb"))


def read_flat_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """A flat single-file index: ``search-index.json`` (header and chunks) and ``search-index.bin`` (int8 codes, row by row)."""
    schema = T.StructType([
        T.StructField("version", T.IntegerType()), T.StructField("model", T.StringType()),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("chunks", T.ArrayType(T.StructType([
            T.StructField("file", T.StringType()), T.StructField("heading", T.StringType()),
            T.StructField("text", T.StringType()), T.StructField("range", T.ArrayType(T.LongType())),
        ]))),
    ])
    head = spark.read.schema(schema).json(f"{folder}/search-index.json", multiLine=True)
    info = head.select("version", "model", "dimensions").first()
    if info is None:
        raise FileNotFoundError(f"no index in {folder}")
    dims = info["dimensions"]
    chunks = head.select(F.posexplode("chunks").alias("chunk_id", "c")).select(
        F.col("chunk_id").cast("long"), "c.file", "c.heading", "c.text",
        F.struct(F.col("c.range")[0].alias("start"), F.col("c.range")[1].alias("end")).alias("range"),
    )

    def cut(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                codes = np.frombuffer(content, dtype=np.int8)
                codes = codes[: len(codes) // dims * dims].reshape(-1, dims)
                for at in range(0, len(codes), 4096):
                    part = codes[at : at + 4096]
                    yield pd.DataFrame({"chunk_id": np.arange(at, at + len(part)), "vector": list(part)})

    blob = spark.read.format("binaryFile").load(f"{folder}/search-index.bin").select("content")
    return chunks, blob.mapInPandas(cut, "chunk_id bigint, vector array<tinyint>"), info.asDict()
