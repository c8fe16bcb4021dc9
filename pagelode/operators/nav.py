"""Navigation: titles, first headings and the directory tree as an adjacency table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import file_title, slug_title


def first_headings(chunks: DataFrame) -> DataFrame:
    """(file, heading): the heading of each file's first chunk that has one, else ''."""
    has = F.when(F.col("heading").isNotNull(), F.col("chunk_id"))
    return chunks.groupBy("file").agg(F.coalesce(F.min_by("heading", has), F.lit("")).alias("heading"))


def nav_nodes(files: DataFrame) -> DataFrame:
    """(path, parent_path, title, is_dir, depth) of every file and directory of (path, title)."""
    parts = F.split("path", "/")
    named = files.select("path", "title").where(F.col("path").isNotNull()).dropDuplicates(["path"])
    leaf = named.select(
        "path",
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("parent_path"),
        file_title(F.col("title"), F.col("path")).alias("title"),
        F.lit(False).alias("is_dir"),
        (F.size(parts) - 1).alias("depth"),
    )
    folders = (
        leaf.select(F.col("parent_path").alias("path")).where(F.col("path").isNotNull()).distinct()
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
        .distinct()
        .select(
            "path",
            F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("parent_path"),
            slug_title(F.element_at(parts, -1)).alias("title"),
            F.lit(True).alias("is_dir"),
            (F.size(parts) - 1).alias("depth"),
        )
    )
    return leaf.unionByName(folders)


def nav_order(nodes: DataFrame) -> DataFrame:
    """Nodes in locale order of their paths."""
    return nodes.orderBy(F.collate("path", "UNICODE"), "path")


def nested_tree(nodes: DataFrame) -> list[dict[str, Any]]:
    """The tree as nested objects for an export file. It walks the nodes one at a time, never all rows at once on Spark's side."""
    roots: list[dict[str, Any]] = []
    dirs: dict[str, dict[str, Any]] = {}
    for row in nav_order(nodes).toLocalIterator():
        node: dict[str, Any] = {"title": row["title"], "path": row["path"]}
        if row["is_dir"]:
            node = dirs.setdefault(row["path"], node | {"children": []}) | {}
            dirs[row["path"]] |= {"title": row["title"]}
            node = dirs[row["path"]]
        parent = row["parent_path"]
        if parent is None:
            roots.append(node)
        else:
            dirs.setdefault(parent, {"title": "", "path": parent, "children": []})["children"].append(node)
    return roots
